import math
import re
from collections import Counter

import pytest
from fixtures import documents_frame, some_documents

from starscan.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    counted = [(d, Counter(t)) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    once = {}
    for item, text in sorted(items, key=lambda r: (r[1] is None, r[1])):
        once.setdefault(item, text)
    for item, text in once.items():
        scores = []
        for doc_id, tf in counted:
            m = 75 + 25 * tf.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in terms(text)
                if tf[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        best = sorted(scores)[:k]
        out.update((item, i + 1, doc_id, -s) for i, (s, _, doc_id) in enumerate(best))
    return out


ITEMS = [
    (1, "the And of THE"),
    (2, "w1 word3 中文 é nothing"),
    (3, None),
    (4, ""),
    (5, "..."),
    (6, "x" * 5000),
    (6, "the"),
    (None, "some words"),
    (7, "w1 " * 300 + "w2"),
    (8, "w1 word3 中文 é nothing"),
]


def items_frame(spark, rows):
    frame = spark.createDataFrame(rows, "item_id long, text string")
    return frame.selectExpr("*", "7 AS doc_id", "7 AS times", "7 AS term")


@pytest.mark.parametrize(
    "changed", [{}, {"BLOCK_POSTINGS": 5}, {"CELLS": 1, "ADDITIONS": 1}, {"SLICE_BYTES": 3}]
)
def test_against_brute_force(spark, sf_dir, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(lexical, name, value)
    rows = some_documents(sf_dir, 40)
    rows += [(920_000 + i, "the same words in every copy w1") for i in range(9)]
    found = lexical.rank_documents(spark, documents_frame(spark, rows), items_frame(spark, ITEMS), k=5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == by_hand(rows, ITEMS, 5)


@pytest.mark.parametrize("rows, items", [([], ITEMS), (some_documents, []), ([(1, None), (2, "...")], ITEMS)])
def test_nothing_to_find(spark, sf_dir, rows, items):
    docs = documents_frame(spark, rows(sf_dir, 3) if callable(rows) else rows, 1)
    assert lexical.rank_documents(spark, docs, items_frame(spark, items)).collect() == []


def test_sums_beyond_doubles(spark, monkeypatch):
    """An item with very many repeats is summed in 64-bit integers."""
    docs = [(1, "rare"), (2, "rare rare other"), (3, "other")]
    items = [(1, "rare " * 100_000)]
    found = lexical.rank_documents(spark, documents_frame(spark, docs, 1), items_frame(spark, items), k=2)
    assert Counter(tuple(r) for r in found.collect()) == by_hand(docs, items, 2)


def test_lengths_beyond_64_bits():
    corpus = lexical.Corpus(10**17, 10**20, None)
    n = lexical.np.array([1, 10**3, 10**6], lexical.np.int64)
    assert lexical.length_factors(n, corpus).tolist() == [75 + 25 * x // 1000 for x in n.tolist()]
