import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import documents_frame, some_documents
from tokenizers import Tokenizer

from starscan.llm import alignment
from starscan.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MORE = [
    (910_001, " leading space"),
    (910_002, "trailing space "),
    (910_003, "two  spaces and   three, <s> </s> <unk> <0x41> <|endoftext|>"),
    (910_004, "a literal ▁ lower block"),
    (910_005, "ﬁ ﬂ é é Ａ ｶﾞ 😀 𝒳 中文 한국어"),
    (910_006, "line\nbreaks\n\nand\ttabs\r\n"),
    (910_007, " "),
    (910_008, "unspaced" * 400),
]


def loaded():
    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


def token_bytes(a, b):
    """By the libraries' own decoding of each token, where that is whole."""
    alphabet = alignment.byte_level_alphabet()
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return of_a, of_b


def spans(ids, content):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(content(i))))
        at = out[-1][2]
    return out


def by_hand(rows):
    """Every token against every token."""
    a, b = loaded()
    of_a, of_b = token_bytes(a, b)
    found, held = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelled = (" " + (text or "")).encode()
        if any(b"".join(map(of, ids)) != spelled for of, ids in ((of_a, ids_a), (of_b, ids_b))) or not text:
            ids_a, ids_b = [], []
        left, right = spans(ids_a, of_a), spans(ids_b, of_b)
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups = []
        for start, end in zip([0, *ends], ends):
            inside = [[str(i) for i, s, e in side if start <= s and e <= end] for side in (left, right)]
            groups.append("|".join(map(",".join, inside)))
        links, at = [], 0
        for i, s, e in left:
            while at < len(right) and right[at][2] <= s:
                at += 1
            links += [(i, j) for j, t, f in right[at : at + (e - s) + 1] if t < e and s < f]
        held.update(set(links))
        found.append((doc_id, len(ids_a), len(ids_b), groups, links))
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return Counter(
        (
            doc_id, n_a, n_b, len(groups), len(links),
            sum(held[link] == highest[link[0]] for link in links),
            sum(held[link] for link in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for doc_id, n_a, n_b, groups, links in found
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# with few frequent pairs most of them are joined in a shuffle
@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_against_brute_force(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT_PAIRS", frequent)
    rows = some_documents(sf_dir, 60) + MORE
    rows = [(d, t[:9000] if t else t) for d, t in rows]
    found = alignment.align_documents(spark, documents_frame(spark, rows), vocabulary(A), vocabulary(B))
    assert Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == by_hand(rows)


def test_empty_table(spark):
    found = alignment.align_documents(spark, documents_frame(spark, [], 1), vocabulary(A), vocabulary(B))
    assert found.columns == COLUMNS and found.collect() == []


def test_words_as_whole_texts():
    """Encoding by words gives what the library gives for the whole text."""
    pick = random.Random(3)
    words = ["a", "über", "don't", "x\ny", "", "12", "\t", "😀", "ab.c,", "▁", "中文", "\x00"]
    texts = [" ".join(pick.choices(words, k=pick.randrange(9))) for _ in range(400)] + [""]
    _, encode = alignment.piece_encoder(vocabulary(B))
    lists = alignment.encode_by_spaces(pa.array(texts), encode)
    found = [lists.ids[s : s + n].tolist() for s, n in zip(lists.starts, lists.lengths)]
    assert found == loaded()[1].encode(texts)


@pytest.mark.parametrize("remembered", [0, 30, 10_000])
def test_every_overlap_is_a_link(monkeypatch, remembered):
    """Windows of random cuts, again and again, with a memo that is full, half full or large."""
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", remembered)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 9)
    pick = random.Random(5)
    # ids name their lengths
    side = alignment._side([b" " + b"x" * (i - 1) for i in range(40)])
    memo = alignment.Memo(side, side)
    for _ in range(20):
        keys, want = [], []
        for _ in range(25):
            size = pick.randrange(1, 9) if pick.random() < 0.5 else pick.randrange(1, 30)
            cuts = [sorted({size, *pick.choices(range(1, size + 1), k=pick.randrange(9))}) for _ in range(2)]
            a, b = ([e - s for s, e in zip([0, *ends], ends)] for ends in cuts)
            key = np.array([*a, -1, *b], np.int32).tobytes()
            if key in keys:
                continue
            keys.append(key)
            links = [(x, y) for x, e in zip(a, cuts[0]) for y, f in zip(b, cuts[1]) if e - x < f and f - y < e]
            shared = sorted(set(cuts[0]) & set(cuts[1]))
            groups = ";".join(
                "|".join(
                    ",".join(str(x) for x, e in zip(ids, ends) if low < e <= high)
                    for ids, ends in ((a, cuts[0]), (b, cuts[1]))
                )
                for low, high in zip([0, *shared], shared)
            )
            want.append((groups.encode(), len(shared), links))
        aligned, place = memo(keys)
        start = np.cumsum(aligned.n_links) - aligned.n_links
        found = [
            (
                aligned.groups[i],
                aligned.n_groups[i],
                [(v >> 32, v & 0xFFFFFFFF) for v in aligned.links[start[i] :][: aligned.n_links[i]].tolist()],
            )
            for i in place.tolist()
        ]
        assert found == want
    assert len(memo.known) <= remembered
