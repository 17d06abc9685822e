"""Quality as graded ratings: ordinal regression with cumulative links over hashed text features.

A label of quality 0 is grade 0; quality 1 is grade 2, or grade 1 if it is toxic. One weight vector
scores a text, ``s = w . x``, and ordered thresholds cut the score into grades: ``P(grade > j) =
sigmoid(s - t_j)``. The expected grade is the sum of these, the probability of the top grade selects.
Features are whether a hashed word occurs, and the shares of word shapes, of repeats and of
different words, so that a single insult counts in a long text and decoration in any.

The weights are fitted on a bounded sample: for each grade the ``SAMPLE_ROWS`` labelled documents
with the smallest hash of their id. All documents are scored, whole.

Defined results. Null, empty or wordless text: expected grade and probability 0, rejected. Very long
texts: scored whole. Null doc_id: scored, never labelled. Repeated rows: scored each. Labels without
quality are ignored, a null toxic is 0, of repeated labels the smallest grade counts. Without any label
nothing is rejected but wordless texts. Empty table: no row. ``select`` keeps all columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import text_chunks

#: Labelled documents of a grade that the weights are fitted on, at most.
SAMPLE_ROWS = 1_500
GRADES = 3
WORDS = 1 << 17
STEMS = (4, 5)
SHAPES = 1 << 10
#: Columns: words, shapes, then share of repeats and share of different words.
COLUMNS = WORDS + SHAPES + 2
ROUNDS = 600
#: Plain, different words that every text is taken to have besides its own, in shares.
SMOOTH = 10
RATE = 0.15
PENALTY = 1e-3
START = 1e-3
#: Least probability of the top grade for a document to be kept.
LEAST = 0.5

def word_features(word: str) -> tuple[int, ...]:
    """Hashed columns of a word's letters, its two stems and its shape (runs of A, a, 0 and signs)."""
    letters = "".join(c for c in word if c.isalnum()).lower()
    shape = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return (
        zlib.crc32(letters.encode()) % WORDS,
        *(zlib.crc32(f"{letters[:n]}-".encode()) % WORDS for n in STEMS),
        WORDS + zlib.crc32("".join(shape).encode()) % SHAPES,
    )


@dataclass
class Features:
    """Sparse rows: ``value[i]`` in column ``column[i]`` of text ``row[i]``; words of each text."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    words: np.ndarray


def features(texts: pa.Array) -> Features:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(full))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = np.diff(ends)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = [word_features(w) for w in coded.dictionary.to_pylist()]
    of_word = np.array(pairs, np.int64).reshape(-1, 2 + len(STEMS))
    n = len(words)
    text = np.repeat(np.arange(n), words)
    # so the shares of short texts are drawn towards those of plain ones
    share = 1 / (words + SMOOTH)

    distinct = np.unique(text * max(1, len(of_word)) + which)
    owner, word = np.divmod(distinct, max(1, len(of_word)))
    present = np.unique((owner[:, None] * WORDS + of_word[word, :-1]).reshape(-1))
    shape, times = np.unique(text * SHAPES + of_word[which, -1] - WORDS, return_counts=True)
    again = np.zeros(len(which), bool)
    again[1:] = (which[1:] == which[:-1]) & (text[1:] == text[:-1])
    plain = word_features("plain")[-1]
    some = np.flatnonzero(words)
    return Features(
        np.concatenate([present // WORDS, shape // SHAPES, some, some, some]),
        np.concatenate(
            [
                present % WORDS,
                WORDS + shape % SHAPES,
                np.full(len(some), plain),
                np.full(len(some), COLUMNS - 2),
                np.full(len(some), COLUMNS - 1),
            ]
        ),
        np.concatenate(
            [
                np.ones(len(present)),
                8 * times * share[shape // SHAPES],
                8 * SMOOTH * share[some],
                8 * (np.bincount(text, again, n) * share)[some],
                8 * ((np.bincount(owner, minlength=n) + SMOOTH) * share)[some],
            ]
        ),
        words,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, found: Features) -> np.ndarray:
        """P(grade > j) for j = 0, 1, ... of each text; 0 for texts without words."""
        scores = np.bincount(found.row, self.weights[found.column] * found.value, len(found.words))
        chances = sigmoid(scores[:, None] - self.thresholds[None, :])
        return np.where(found.words[:, None] > 0, chances, 0.0)


def fit(found: Features, grades: np.ndarray) -> Model:
    """Cumulative-link regression with a lasso penalty, by proximal adaptive gradient steps.

    The thresholds stay ordered: each lies a positive gap above the one before.
    """
    n = len(grades)
    weights = np.zeros(COLUMNS)
    base, gaps = np.array(-0.7), np.zeros(GRADES - 2)
    past = np.full(COLUMNS, START)
    past_base, past_gaps = np.array(1e-8), np.full(GRADES - 2, 1e-8)
    # each grade has the same weight, however many labels it has
    share = 1 / np.maximum(1, np.bincount(grades, minlength=GRADES))[grades]
    share /= share.sum()
    rows = np.arange(n)
    for _ in range(ROUNDS):
        cuts = np.append(base, base + np.cumsum(np.exp(gaps)))
        scores = np.bincount(found.row, weights[found.column] * found.value, n)
        # P(y = k) = F(t_k - s) - F(t_{k-1} - s), F the logistic function
        inner = sigmoid(cuts[None, :] - scores[:, None])
        cumulative = np.concatenate([np.zeros((n, 1)), inner, np.ones((n, 1))], axis=1)
        density = cumulative * (1 - cumulative)
        chance = np.maximum(cumulative[rows, grades + 1] - cumulative[rows, grades], 1e-12)
        up, down = density[rows, grades + 1], density[rows, grades]
        slope_score = share * (up - down) / chance
        slope_cut = np.array(
            [(share * ((grades == j + 1) * down - (grades == j) * up) / chance).sum() for j in range(GRADES - 1)]
        )
        slope = np.bincount(found.column, found.value * slope_score[found.row], COLUMNS)
        past += slope * slope
        step = RATE / np.sqrt(past)
        moved = weights - step * slope
        weights = np.sign(moved) * np.maximum(0, np.abs(moved) - step * PENALTY)
        slope_base = slope_cut.sum()
        past_base = past_base + slope_base**2
        base = base - 0.3 * slope_base / np.sqrt(past_base)
        slope_gaps = np.array([slope_cut[j + 1 :].sum() for j in range(GRADES - 2)]) * np.exp(gaps)
        past_gaps = past_gaps + slope_gaps**2
        gaps = gaps - 0.3 * slope_gaps / np.sqrt(past_gaps)
    return Model(weights, np.append(base, base + np.cumsum(np.exp(gaps))))


def graded(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, grade) of labels (doc_id, quality, toxic), one per document."""
    grade = (
        F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 0, GRADES - 1).otherwise(1)
    )
    return (
        labels.where("quality is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )


FEATURES_DDL = "doc_id long, grade int, words long, columns array<int>, values array<float>"


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        found = features(chunk.column("text"))
        order = np.argsort(found.row, kind="stable")
        offsets = pa.array(np.searchsorted(found.row[order], np.arange(chunk.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("grade"),
                pa.array(found.words),
                pa.ListArray.from_arrays(offsets, pa.array(found.column[order].astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(found.value[order].astype(np.float32))),
            ],
            ["doc_id", "grade", "words", "columns", "values"],
        )


def fit_on(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of the labelled documents."""
    grades = graded(labels)
    sample = None
    for grade in range(GRADES):
        part = grades.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    # at most GRADES * sample_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sample), "doc_id"
    )
    rows = texts.mapInArrow(_sample_features, FEATURES_DDL).orderBy("doc_id").toArrow()
    n = rows.num_rows
    columns = rows.column("columns").combine_chunks()
    per_row = np.diff(columns.offsets.to_numpy())
    found = Features(
        np.repeat(np.arange(n), per_row),
        columns.flatten().to_numpy().astype(np.int64),
        rows.column("values").combine_chunks().flatten().to_numpy().astype(np.float64),
        rows.column("words").to_numpy(),
    )
    if not n:
        return Model(np.zeros(COLUMNS), np.full(GRADES - 1, -40.0))
    return fit(found, rows.column("grade").to_numpy().astype(np.int64))


def with_grades(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns ``__expected`` (grade) and ``__top`` (probability of the top grade)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            chances = model.exceed(features(chunk.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*chunk.columns, pa.array(chances.sum(1)), pa.array(chances[:, -1])],
                [*chunk.schema.names, "__expected", "__top"],
            )

    schema = docs.withColumns({c: F.lit(0.0) for c in ("__expected", "__top")}).schema
    return docs.mapInArrow(scored, schema)


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents whose probability of the top grade is at least ``least``, with all columns."""
    scored = with_grades(docs, fit_on(spark, docs, labels))
    return scored.where(F.col("__top") >= least).select(*docs.columns)
