import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from fixtures import documents_frame, some_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from starscan.llm import bpe, queries

PATH = queries.vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(PATH).ranks, special_tokens={}
    )


def test_query(spark, sf_dir, library):
    rows = some_documents(sf_dir)
    expected = Counter()
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        joined = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected[doc_id, len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    found = queries.encode_and_decode(documents_frame(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert queries.encode_and_decode(documents_frame(spark, [], 1)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=20))
def test_any_text(library, texts):
    encode = bpe.replay_encoder(PATH, public_tokenizers.PATTERN)
    encode.known.clear()
    pieces = encode([*texts, *texts])
    for i, text in enumerate(texts):
        start = pieces.starts[i]
        assert pieces.ids[start : start + pieces.lengths[i]].tolist() == library.encode_ordinary(text)


def test_lower_rank_after_a_merge(tmp_path):
    """Ranks out of order: a merge makes a pair that comes before it."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab", b"aa", b"aaa", b"bb", b"abb"]
    file = tmp_path / "ranks"
    file.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    vocabulary = bpe.Vocabulary(str(file))
    own = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    words = [b"abc", b"abcab", b"aaaaa", b"cababab", b"abbabcaaab", b"", b"bbbbb"]
    ids, counts = bpe.replay(words, vocabulary)
    at = 0
    for word, n in zip(words, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.encode_ordinary(word.decode())
        at += n
