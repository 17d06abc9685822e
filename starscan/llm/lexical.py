"""Ranked lexical search, reversed: the documents stream through an inverted index of the items.

An item is a query: a short text. The terms of all items make the index, which is sent to every task; a
document meets it once and leaves its length and the counts of the index's terms behind. From that
table Spark counts how many documents hold each term. Then the counts stream through the index again:
the postings of a document's terms add up its score for every item at once, and a task keeps the best
``k`` documents of each item, so that an item has ``k`` rows per task left to be merged.

The index is sent in blocks of about ``BLOCK_POSTINGS`` postings, dealt by item; more items mean more
blocks, each of which meets all documents.

Defined results. Null, empty or termless text: not counted as a document, never found. Very long texts:
cut between terms. Null doc_id: found like any other, behind equal scores. Rows that repeat a doc_id: a
document each. Items without terms: no row. Rows that repeat an item_id: one item, the smallest text
counts. Empty tables: no row. Other columns of either input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import ranges, stage, text_chunks
from starscan.operators.topk import top_k_per_group

#: Postings (term, item) that are sent to tasks at once: some 60 bytes each.
BLOCK_POSTINGS = 500_000
#: Bytes of a text that are cut into terms at once.
SLICE_BYTES = 1 << 20
#: Scores (document, item), and additions to them, that a task holds at once.
CELLS = 1 << 21
ADDITIONS = 1 << 22

# letters and digits of ASCII and all of UTF-8's longer sequences make terms; A-Z are lower-cased
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8 in order, a slice at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE_BYTES:
            end = at + SLICE_BYTES
            # a term never goes on behind a byte that is no part of one
            while end < len(text) and _TERM_BYTES[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


class Index(NamedTuple):
    """Postings by term: those of term ``t`` are ``items[starts[t]:starts[t + 1]]``, ``times`` each."""

    number: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    ids: list

    def entries(self) -> np.ndarray:
        return np.diff(self.starts)


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item_id, term, times) of the distinct items."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            for key, text in zip(*(chunk.column(c).to_pylist() for c in ("item_id", "text")), strict=True):
                found = Counter(t for part in terms((text or "").encode()) for t in part)
                columns = [[key] * len(found), list(found), list(found.values())]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    once = items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id")
    return once.agg(F.min("text").alias("text")).mapInArrow(counted, "item_id long, term binary, times long")


def make_index(postings: pa.Table) -> Index:
    """The index of rows (item_id, term, times)."""
    vocabulary = postings.column("term").combine_chunks().dictionary_encode()
    term = vocabulary.indices.to_numpy()
    keys = postings.column("item_id").to_pylist()
    numbered = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    item = np.fromiter((numbered[key] for key in keys), np.int64, len(keys))
    order = np.argsort(term, kind="stable")
    words = vocabulary.dictionary.to_pylist()
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
    times = postings.column("times").to_numpy()
    return Index(
        {word: i for i, word in enumerate(words)}, starts, item[order], times[order], list(numbered)
    )


COUNTS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))]
)
COUNTS_DDL = "doc_id long, n long, terms array<int>, tf array<long>"


def term_counts(docs: DataFrame, index) -> DataFrame:
    """Rows (doc_id, n: all terms, terms: numbers in the broadcast index, tf: their counts)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.number.get
        for chunk in text_chunks(batches):
            rows: list[tuple] = []
            texts = chunk.column("text").cast(pa.binary())
            for key, text in zip(chunk.column("doc_id"), texts, strict=True):
                n, found = 0, Counter()
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    found.update(map(number, part))
                found.pop(None, None)
                if n:
                    rows.append((key.as_py(), n, list(found), list(found.values())))
            columns = list(zip(*rows, strict=True)) or [[]] * len(COUNTS)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=COUNTS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(counted, COUNTS_DDL)


class Corpus(NamedTuple):
    """What a score needs of the whole corpus: documents, their terms, the weight of each index term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def corpus_of(counted: DataFrame, n_index_terms: int) -> Corpus:
    """Counted over all documents in the staged table ``counted``."""
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most one row for each term of a block of the index
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(n_index_terms, np.int64)
    for row in held.toArrow().to_pylist():
        df[row["term"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return Corpus(n_docs, n_terms, np.array(weights, np.int64))


def length_factors(n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """100 - 25 + 25 * n * N div L, also where the product leaves 64 bits."""
    if 25 * int(n.max(initial=0)) * corpus.n_docs < 1 << 63:
        return 75 + 25 * n * corpus.n_docs // corpus.n_terms
    return np.array([75 + 25 * x * corpus.n_docs // corpus.n_terms for x in n.tolist()], np.int64)


class Heaps:
    """The best ``k`` documents of every item so far, by score, then id; documents without id last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        #: a document below this score is not among the best of the item
        self.least = np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = (item, scores[doc, item], missing[doc], ids[doc])
        rows = [np.concatenate(pair) for pair in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [column[order] for column in rows]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(order)) - first
        self.rows = [column[place < self.k] for column in rows]
        last = place == self.k - 1
        self.least[rows[0][last]] = rows[1][last]


HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def best_of_tasks(counted: DataFrame, index, corpus: Corpus, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score): the best ``k`` documents of each item within each task."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        n_items, entries = len(known.ids), known.entries()
        # sums of doubles are exact below 2^53; a term adds less than 10^6 times its weight
        most = np.zeros(n_items)
        np.add.at(most, known.items, known.times * np.repeat(corpus.weights, entries) * 1e6)
        exact = most.max(initial=0) < 2**53
        at_once = max(1, min(CELLS // max(n_items, 1), ADDITIONS // max(len(known.items), 1)))
        heaps = Heaps(n_items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                lists = part.column("terms")
                per_doc = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy()
                tf = part.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(per_doc)), per_doc)
                factor = length_factors(part.column("n").to_numpy(), corpus)
                add = corpus.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * factor[doc]))
                posting = ranges(known.starts[term], entries[term])
                cell = np.repeat(doc * n_items, entries[term]) + known.items[posting]
                add = np.repeat(add, entries[term]) * known.times[posting]
                size = len(per_doc) * n_items
                if exact:
                    sums = np.bincount(cell, add, size).astype(np.int64)
                else:
                    sums = np.zeros(size, np.int64)
                    np.add.at(sums, cell, add)
                ids = part.column("doc_id")
                heaps.offer(
                    sums.reshape(len(per_doc), n_items),
                    ids.fill_null(0).to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                )
        item, score, missing, ids = heaps.rows
        columns = [
            pa.array([known.ids[i] for i in item], pa.int64()),
            pa.array(ids, pa.int64(), mask=missing > 0),
            pa.array(score),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=HITS)

    return counted.mapInArrow(scored, "item_id long, doc_id long, score long")


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    postings = stage(spark, item_terms(items), "postings")
    blocks = -(-postings.count() // BLOCK_POSTINGS)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        # about ``BLOCK_POSTINGS`` rows
        dealt = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        index = make_index(postings.where(dealt).toArrow())
        sent = spark.sparkContext.broadcast(index)
        counted = stage(spark, term_counts(docs, sent), "term_counts")
        corpus = corpus_of(counted, len(index.number))
        found = found.unionByName(best_of_tasks(counted, sent, corpus, k))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = top_k_per_group(found, ["item_id"], order, k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
