import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents_frame, some_documents

from starscan.llm import lm
from starscan.llm.queries import QUERIES


def words_by_hand(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update([*words_by_hand(text), None])
    n, v = counts.total(), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = [*words_by_hand(text), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((doc_id, held_out(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4)))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_base_and_counts(spark, sf_dir, small):
    sizes = {"frequent_words": 20, "own_words": 15, "buckets": 8} if small else {}
    rows = some_documents(sf_dir)
    found = lm.score_texts(spark, documents_frame(spark, rows), **sizes).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)
    assert got == base_by_hand(rows)
    assert all(r.score < 0 for r in found)


def test_words():
    texts = ["A b\tÄ\x0bC\x1cd ", None, "", " \n", "İ x"]
    words = lm.split_words(pa.array(texts))
    flat = words.distinct.take(pa.array(words.which)).to_pylist()
    assert flat == [w for t in texts for w in words_by_hand(t)]
    assert words.per_text.tolist() == [len(words_by_hand(t)) for t in texts]


def test_bucket_expression(spark):
    words = ["a", "abc", "xyzé", "😀bc", "longer", "é"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = {r.word: r.b for r in frame.select("word", lm.bucket_column("word", 256).alias("b")).collect()}
    assert found == {w: lm.bucket_of(w, 256) for w in words}


def test_a_bucket_is_found_once_an_ending(monkeypatch):
    words = [f"w{i}{end}" for i in range(500) for end in ("ing", "xyé", "😀bc")] + ["a", "é", "ing"]
    lexicon = lm.Lexicon(words[:5], [1] * 5, 1 + 8 + 2, 8)
    want = [1 + 8 + i if i < 2 else lm.bucket_of(w, 8) for i, w in enumerate(words)]
    asked = []
    monkeypatch.setattr(lm, "bucket_of", lambda word, n, found=lm.bucket_of: asked.append(word) or found(word, n))
    at, classes = lexicon.place(pa.array(words))
    assert classes.tolist() == want and at.tolist() == [0, 1, 2, 3, 4] + [-1] * (len(words) - 5)
    assert len(asked) == 5
    assert [a.tolist() for a in lexicon.place(pa.array([], pa.string()))] == [[], []]


def test_bigrams_of_several_chunks_are_counted_together(monkeypatch):
    arrays = [np.array(a, np.int64) for a in ([3, 1, 3], [3], [], [1, 9], [3])]
    found = [b.to_pydict() for b in lm.count_pairs(iter(arrays))]
    assert found == [{"pair": [1, 3, 9], "n": [2, 4, 1]}]
    monkeypatch.setattr(lm, "HELD_TOKENS", 4)
    found = [b.to_pydict() for b in lm.count_pairs(iter(arrays))]
    assert found == [{"pair": [1, 3], "n": [1, 3]}, {"pair": [1, 3, 9], "n": [1, 1, 1]}]
    assert list(lm.count_pairs(iter([]))) == []


def test_training_approaches_the_bigrams():
    rng = np.random.default_rng(0)
    # two groups of classes that follow each other only within the group
    group = np.arange(40) % 2
    true = np.where(group[:, None] == group[None, :], 1.0, 0.02) * rng.dirichlet(np.ones(40), 1)
    true /= true.sum(1, keepdims=True)
    bigrams = np.round(true * 50_000)
    pairs = np.flatnonzero(bigrams)
    model = lm.train(lm.Bigrams(pairs, bigrams.reshape(-1)[pairs], bigrams.sum(0)))
    logs = model.log_probabilities(np.arange(40))
    assert np.allclose(np.exp(logs).sum(1), 1)
    unigram = bigrams.sum(0) / bigrams.sum()
    gain = (bigrams * (logs - np.log(unigram + 1e-12)[None, :])).sum() / bigrams.sum()
    best = (bigrams * (np.log(true) - np.log(unigram + 1e-12)[None, :])).sum() / bigrams.sum()
    assert gain > 0.8 * best


def test_probabilities_sum_to_one(spark):
    """All texts of one word, known or not, and the empty text: their probabilities sum to one step."""
    kept = [i for i in range(1, 60) if not held_out(i)]
    words = ["aa", "bb", "cc", "ab", "ba", "ca", "dd", "ee"]
    learn = [(i, f"{words[i % 8]} {words[i % 3]}") for i in kept]
    # an unseen word of each bucket stands for all unseen words of the bucket
    unseen = {}
    for i in range(1000):
        unseen.setdefault(lm.bucket_of(f"zz{i}", 4), f"zz{i}")
    probe_ids = [i for i in range(10_000, 20_000) if held_out(i)]
    probes = list(zip(probe_ids, ["", *words, *unseen.values()]))
    frame = documents_frame(spark, learn + probes)
    found = {r.doc_id: r for r in lm.score_texts(spark, frame, frequent_words=3, own_words=2, buckets=4).collect()}
    # P(word, end) = P(word | start) P(end | class of the word): divide by the second factor
    model_rows = [(t, found[i].score) for i, t in probes]
    assert len(unseen) == 4
    total = 10 ** dict(model_rows)[""]
    model, lexicon, logs = model_by_hand(learn, 2, 4)
    for text, score in model_rows[1:]:
        own = int(lexicon.place(pa.array([text]))[1][0])
        total += 10 ** (score - logs[own, 0])
    assert abs(total - 1) < 1e-6


def model_by_hand(learn, own_words, buckets):
    """The model, lexicon and log10 probabilities of the classes, from plain counts of all bigrams."""
    counts = Counter(w for _, t in learn for w in words_by_hand(t))
    top = sorted((-c, w) for w, c in counts.items())[:own_words]
    lexicon = lm.Lexicon([w for _, w in top], [-c for c, _ in top], 1 + buckets + own_words, buckets)
    n, bigrams, occurs = lexicon.classes, Counter(), np.zeros(1 + buckets + own_words)
    for _, text in learn:
        classes = lexicon.place(pa.array(words_by_hand(text), pa.string()))[1].tolist() + [0]
        bigrams.update(h * n + w for h, w in zip([0, *classes], classes))
        np.add.at(occurs, classes, 1)
    pairs = np.array(sorted(bigrams))
    model = lm.train(lm.Bigrams(pairs, np.array([float(bigrams[p]) for p in pairs.tolist()]), occurs))
    return model, lexicon, model.log_probabilities(np.arange(n)) / math.log(10)


def test_scores_text_by_text(spark, sf_dir):
    """Every score is the sum over its tokens of class probability and share in the bucket."""
    rows = [(d, t[:800] if t else t) for d, t in some_documents(sf_dir, 50)]
    learn = [(d, t) for d, t in rows if not held_out(d)]
    model, lexicon, logs = model_by_hand(learn, 30, 8)
    counts = Counter(w for _, t in learn for w in words_by_hand(t))
    kind = lambda w: int(lexicon.place(pa.array([w]))[1][0])
    mass = Counter()
    for w, c in counts.items():
        mass[kind(w)] += c + 1
    want = []
    for doc_id, text in rows:
        score, before = 0.0, 0
        for word in words_by_hand(text):
            score += logs[before, kind(word)]
            if kind(word) <= 8:
                score += math.log10((counts[word] + 1) / (mass[kind(word)] + 1))
            before = kind(word)
        want.append((str(doc_id), score + logs[before, 0]))
    frame = documents_frame(spark, rows)
    found = lm.score_texts(spark, frame, frequent_words=40, own_words=30, buckets=8).collect()
    got = sorted((str(r.doc_id), r.score) for r in found)
    for (doc_id, score), (other_id, other) in zip(got, sorted(want), strict=True):
        assert doc_id == other_id and score == pytest.approx(other, abs=1e-6)


def test_a_threshold_sample_keeps_the_weights(spark, sf_dir, monkeypatch):
    """Frequent bigrams are kept with their counts, of the others some, with more than their own."""
    rows = [(d, t) for d, t in some_documents(sf_dir, 100)]
    counts = Counter(w for _, t in rows for w in words_by_hand(t))
    top = sorted((-c, w) for w, c in counts.items())[:200]
    lexicon = lm.Lexicon([w for _, w in top], [-c for c, _ in top], 209, 8)
    frame = documents_frame(spark, rows)
    whole = lm.class_bigrams(spark, frame, lexicon, np.zeros(209))
    monkeypatch.setattr(lm, "SAMPLE", 1500)
    monkeypatch.setattr(lm, "SAMPLE_PER_CLASS", 0)
    some = lm.class_bigrams(spark, frame, lexicon, np.zeros(209))
    assert 500 < len(some.pairs) < 1700 < len(whole.pairs)
    assert some.weights.sum() == pytest.approx(whole.weights.sum(), rel=0.1)
    at = dict(zip(whole.pairs.tolist(), whole.weights.tolist()))
    share = whole.weights.sum() / 1500
    assert all(w == max(at[p], share) for p, w in zip(some.pairs.tolist(), some.weights.tolist()))
    assert {p for p, c in at.items() if c > share} <= set(some.pairs.tolist())


def test_every_bigram_is_trained_on(spark, sf_dir, monkeypatch):
    """No sample, however small, has a say in the scores."""
    frame = documents_frame(spark, [(d, t) for d, t in some_documents(sf_dir, 50)])
    sizes = {"frequent_words": 40, "own_words": 30, "buckets": 8}
    scores = lambda: sorted((str(r.doc_id), r.score) for r in lm.score_texts(spark, frame, **sizes).collect())
    whole = scores()
    monkeypatch.setattr(lm, "SAMPLE", 20)
    monkeypatch.setattr(lm, "SAMPLE_PER_CLASS", 0)
    assert [s for _, s in scores()] == pytest.approx([s for _, s in whole], abs=1e-6)


def test_training_by_tasks_equals_training_here(spark, monkeypatch):
    """Blocks of four rows, some without any bigram."""
    monkeypatch.setattr(lm, "BLOCK", 4)
    monkeypatch.setattr(lm, "ROUNDS", 2)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (30, 30))
    counts[1::8], counts[:, 1::8] = 0, 0
    # as many contexts as classes
    counts = counts + counts.T
    pairs = np.flatnonzero(counts)
    times, occurs = counts.reshape(-1)[pairs], counts.sum(0).astype(float)
    here = lm.train(lm.Bigrams(pairs, times.astype(float), occurs))
    table = spark.createDataFrame(list(zip(pairs.tolist(), times.tolist())), "pair long, n long")
    there = lm.train_all(spark, table, occurs)
    for name in ("context", "scale", "target", "bias"):
        assert np.allclose(getattr(here, name), getattr(there, name), atol=1e-9)


def test_better_than_base_on_held_out_texts(spark):
    found = QUERIES["op2_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in found)
    assert sum(r.score - r.base_score for r in found) / tokens > 0.1


def test_empty(spark):
    assert lm.score_texts(spark, documents_frame(spark, [], 1)).collect() == []
