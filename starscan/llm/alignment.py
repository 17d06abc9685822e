"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) cover which of a piece
vocabulary (B).

Every text is encoded whole by both. Token bytes give each token's end; an end that both have, before a
token that both mark with a space, is an anchor. Anchors split a document into windows, a few tokens of
each kind, most of which occur again and again: a window is aligned once for each pair of id tuples
and remembered, and a chunk of text is reduced to its different windows by Arrow's dictionary encoding.

The documents that hold an id pair are counted by Spark. The pairs held by more than one of
``FREQUENT_PAIRS`` equal parts of all (document, pair) rows, so at most that many, are sent to the
tasks; the others are joined in a shuffle in which no key is large.

Defined results. Null or empty text, or one whose tokens do not spell it: no tokens, all zeros, no
digest. Very long texts: as any; windows without anchors are aligned but not remembered. Null doc_id,
rows that repeat a doc_id: a row each, each counted as a document. Empty table: no row. Other columns
of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import ranges, stage, text_chunks
from starscan.llm.tokens import PieceCache, Ragged, encode_texts, library_encoder

#: Pairs whose counts are sent to all tasks, 17 bytes each.
FREQUENT_PAIRS = 1 << 20
#: Windows that a worker remembers, and the tokens of the longest of them.
MEMO_WINDOWS = 200_000
MEMO_TOKENS = 64


class Side(NamedTuple):
    """The bytes of each token id, their number, and whether they begin with a space."""

    content: pa.Array
    lengths: np.ndarray
    spaced: np.ndarray


def _side(tokens: Sequence[bytes]) -> Side:
    return Side(
        pa.array(tokens, pa.binary()),
        np.array([len(t) for t in tokens], np.int64),
        np.array([t[:1] == b" " for t in tokens]),
    )


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else the next from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def byte_level_side(path: str) -> Side:
    """The tokens of a byte-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    alphabet = byte_level_alphabet()
    tokens = {i: bytes(alphabet[c] for c in entry) for entry, i in described["model"]["vocab"].items()
              if all(c in alphabet for c in entry)}
    tokens |= {added["id"]: added["content"].encode() for added in described["added_tokens"]}
    return _side([tokens.get(i, b"") for i in range(max(tokens) + 1)])


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> tuple[Side, PieceCache]:
    """The tokens of a sentencepiece model, and its encoder; one for each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        )
    return _side(tokens), PieceCache(lambda texts: model.encode(texts, num_threads=1))


def encode_by_spaces(texts: pa.Array, encode: PieceCache) -> Ragged:
    """The ids of each text by an encoder that puts a space before it.

    No piece of such a model holds a space behind another character, so words are encoded one by one.
    A text with an empty word (two spaces in a row, one at an end), or with the character that stands for
    a space, is encoded in one piece.
    """
    mask = pc.match_substring_regex(texts, "^ |  | $|▁").to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(mask)
    lists = pc.split_pattern(pc.if_else(pa.array(mask), "", texts), " ")
    ends = lists.offsets.to_numpy()
    flat = lists.flatten().dictionary_encode()
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_pylist()
    # an emptied text has one empty word
    which[(ends[:-1] - ends[0])[whole]] = len(words) + np.arange(len(whole))
    pieces = encode(words + texts.take(pa.array(whole)).to_pylist())
    per_word = np.concatenate([[0], np.cumsum(pieces.lengths[which])])
    return Ragged(pieces.take(which), np.diff(per_word[ends - ends[0]]))


class Aligned(NamedTuple):
    """Aligned windows: the groups of each as text, how many, and how many links; ``links`` of all
    windows on end (A id << 32 | B id)."""

    groups: list[bytes]
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray


#: What may follow an id in the text of groups.
_MARKS = (",", "|", ";", "")
_NEXT, _SIDES, _GROUP, _END = range(len(_MARKS))


@functools.lru_cache(maxsize=2)
def _id_texts(n: int) -> pa.Array:
    """Every id below ``n`` with every mark: id ``i`` with mark ``m`` is entry ``len(_MARKS) * i + m``."""
    return pa.array([f"{i}{mark}".encode() for i in range(n) for mark in _MARKS], pa.binary())


def align(keys: Sequence[bytes], a_side: Side, b_side: Side) -> Aligned:
    """Windows given as the bytes of their ids: those of A, -1, those of B, which spell the same."""
    flat = np.frombuffer(b"".join(keys), np.int32).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)) // 4)
    starts, cuts = np.append(0, ends)[:-1], np.flatnonzero(flat < 0)
    n_a, n_b = cuts - starts, ends - cuts - 1
    a, b = flat[ranges(starts, n_a)], flat[ranges(cuts + 1, n_b)]
    a_ends, b_ends = np.cumsum(a_side.lengths[a]), np.cumsum(b_side.lengths[b])
    # the B tokens that a token of A overlaps
    first = np.searchsorted(b_ends, a_ends - a_side.lengths[a], "right")
    last = np.searchsorted(b_ends, a_ends)
    wide = last - first + 1
    links = np.repeat(a, wide) << 32 | b[ranges(first, wide)]
    # a group closes where both end
    a_closes = b_ends[last] == a_ends
    b_closes = np.zeros(len(b), bool)
    b_closes[last[a_closes]] = True
    window_a, window_b = np.cumsum(n_a), np.cumsum(n_b)
    marks_a = np.where(a_closes, _SIDES, _NEXT)
    marks_b = np.where(b_closes, _GROUP, _NEXT)
    marks_b[window_b - 1] = _END
    # the tokens of a group follow each other, those of A first
    closed_a, closed_b = np.flatnonzero(a_closes) + 1, np.flatnonzero(b_closes) + 1
    place_a = np.arange(len(a)) + np.append(0, closed_b)[np.cumsum(a_closes) - a_closes]
    place_b = np.arange(len(b)) + closed_a[np.cumsum(b_closes) - b_closes]
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a] = len(_MARKS) * a + marks_a
    order[place_b] = len(_MARKS) * b + marks_b
    texts = _id_texts(max(len(a_side.lengths), len(b_side.lengths))).take(pa.array(order))
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[np.append(0, window_a + window_b)]
    groups = pa.Array.from_buffers(
        pa.binary(), len(keys), [None, pa.py_buffer(bounds), texts.buffers()[2]]
    )

    def per_window(counts: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(counts))[window_a], prepend=0)

    return Aligned(groups.to_pylist(), per_window(a_closes), per_window(wide), links)


class Memo:
    """Aligned windows by the bytes of their ids."""

    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        self.known: dict[bytes, int] = {}
        nothing = np.zeros(0, np.int64)
        self.aligned = Aligned([], nothing, nothing, nothing)

    def __call__(self, keys: list[bytes]) -> tuple[Aligned, np.ndarray]:
        """Aligned windows that hold those of ``keys``, and the place of each among them."""
        place = np.fromiter((self.known.get(key, -1) for key in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.aligned, place
        # short ones first: they may be remembered
        short = np.array([len(keys[i]) <= 4 * MEMO_TOKENS for i in new.tolist()])
        new = np.concatenate([new[short], new[~short]])
        found = align([keys[i] for i in new.tolist()], *self.sides)
        place[new] = len(self.aligned.groups) + np.arange(len(new))
        both = Aligned(
            self.aligned.groups + found.groups,
            *[np.concatenate(pair) for pair in zip(self.aligned[1:], found[1:], strict=True)],
        )
        room = min(max(0, MEMO_WINDOWS - len(self.known)), int(short.sum()))
        if room:
            n = len(self.known)
            self.known |= {keys[i]: n + at for at, i in enumerate(new[:room].tolist())}
            n += room
            self.aligned = Aligned(
                both.groups[:n], both.n_groups[:n], both.n_links[:n], both.links[: both.n_links[:n].sum()]
            )
        return both, place


def spelled(texts: pa.Array, lists: Ragged, side: Side) -> np.ndarray:
    """Whether the tokens of each text spell it, behind a space."""
    tokens = side.content.take(pa.array(lists.ids))
    joined = memoryview(tokens.buffers()[2] or b"").cast("B")
    bounds = np.concatenate([[0], np.cumsum(side.lengths[lists.ids])])
    starts, ends = bounds[lists.starts], bounds[lists.starts + lists.lengths]
    return np.array(
        [
            joined[s:e] == b" " + text.as_py().encode()
            for text, s, e in zip(texts, starts.tolist(), ends.tolist(), strict=True)
        ],
        bool,
    )


def windows(a: Ragged, b: Ragged, a_side: Side, b_side: Side) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The windows of the documents in order, and how many each document has.

    Both sides spell the same bytes for every document, and every document has tokens.
    """
    a_ends, b_ends = np.cumsum(a_side.lengths[a.ids]), np.cumsum(b_side.lengths[b.ids])
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    at_a, at_b = np.searchsorted(a_ends, shared) + 1, np.searchsorted(b_ends, shared) + 1
    # a document begins with a space, and the end of the last one is an anchor, too
    anchor = np.append(a_side.spaced[a.ids], True)[at_a] & np.append(b_side.spaced[b.ids], True)[at_b]
    at_a, at_b = at_a[anchor], at_b[anchor]
    n_a, n_b = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
    size = n_a + n_b + 1
    start = np.cumsum(size) - size
    ids = np.full(int(size.sum()), -1, np.int32)
    ids[ranges(start, n_a)] = a.ids
    ids[ranges(start + n_a + 1, n_b)] = b.ids
    offsets = np.append(start, len(ids)).astype(np.int32) * 4
    keys = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
    last = np.searchsorted(at_a, np.cumsum(a.lengths)) + 1
    return keys.dictionary_encode(), np.diff(last, prepend=0)


ALIGNED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)
ALIGNED_DDL = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def _kept(lists: Ragged, keep: np.ndarray) -> Ragged:
    return Ragged(lists.ids[np.repeat(keep, lists.lengths)], lists.lengths[keep])


def align_chunk(texts: pa.Array, a: Ragged, b: Ragged, a_side: Side, b_side: Side, memo: Memo) -> dict:
    """The columns of ``ALIGNED`` but the first two for texts that are neither null nor empty."""
    good = spelled(texts, a, a_side) & spelled(texts, b, b_side)
    a, b = _kept(a, good), _kept(b, good)
    n_docs = len(a.lengths)
    found, per_doc = windows(a, b, a_side, b_side)
    aligned, place = memo(found.dictionary.to_pylist())
    which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n_docs), per_doc)
    # the windows of this chunk, out of all that are remembered
    n_groups, n_links = aligned.n_groups[place], aligned.n_links[place]
    first_link = (np.cumsum(aligned.n_links) - aligned.n_links)[place]
    pair, number = np.unique(aligned.links[ranges(first_link, n_links)], return_inverse=True)
    # each different window of a document, and how often it occurs
    cells, often = np.unique(doc * len(place) + which, return_counts=True)
    doc_of, window = np.divmod(cells, max(len(place), 1))
    link = ranges((np.cumsum(n_links) - n_links)[window], n_links[window])
    cells = np.repeat(doc_of, n_links[window]) * len(pair) + number[link]
    # the links of a document, each pair once
    order = np.argsort(cells, kind="stable")
    cells, often_of_link = cells[order], np.repeat(often, n_links[window])[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    times = np.add.reduceat(often_of_link, first) if len(first) else np.zeros(0, np.int64)
    pair_doc, pair_number = np.divmod(cells[first], max(len(pair), 1))
    texts_of_window = [aligned.groups[i] for i in place.tolist()]
    groups = [texts_of_window[i] for i in which.tolist()]
    bounds = np.concatenate([[0], np.cumsum(per_doc)]).tolist()
    digests = [
        hashlib.sha256(b";".join(groups[s:e])).hexdigest() for s, e in zip(bounds, bounds[1:], strict=False)
    ]
    kept = np.flatnonzero(good)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(good), np.int64)
        out[kept] = values
        return out

    def total(values: np.ndarray) -> np.ndarray:
        return spread(np.bincount(doc, values[which], n_docs).astype(np.int64))

    texts_of = [""] * len(good)
    for at, digest in zip(kept.tolist(), digests, strict=True):
        texts_of[at] = digest
    n_pairs = spread(np.bincount(pair_doc, minlength=n_docs))
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]), pa.int32())
    return {
        "n_a": pa.array(spread(a.lengths)),
        "n_b": pa.array(spread(b.lengths)),
        "n_groups": pa.array(total(n_groups)),
        "n_links": pa.array(total(n_links)),
        "groups_sha256": pa.array(texts_of, pa.string()),
        "pairs": pa.ListArray.from_arrays(offsets, pa.array(pair[pair_number])),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
    }


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Documents (doc_id, text) as rows of ``ALIGNED``: ``times`` says how often each pair is linked."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, encode_a = byte_level_side(byte_level), library_encoder(byte_level)
        b_side, encode_b = piece_encoder(pieces)
        memo = _memo(byte_level, pieces)
        done = TaskContext.get().partitionId() << 40
        for chunk in text_chunks(batches):
            # a null, like an empty text, spells nothing: its tokens are dropped
            texts = pc.fill_null(chunk.column("text"), "")
            spaced = pc.binary_join_element_wise(" ", texts, "")
            a = encode_texts(spaced, encode_a, drops_space=False)
            b = encode_by_spaces(texts, encode_b)
            empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
            a = Ragged(a.ids[np.repeat(~empty, a.lengths)], np.where(empty, 0, a.lengths))
            columns = align_chunk(texts, a, b, a_side, b_side, memo)
            rows = pa.array(np.arange(done, done + chunk.num_rows))
            done += chunk.num_rows
            yield pa.RecordBatch.from_pydict(
                {"row": rows, "doc_id": chunk.column("doc_id")} | columns, ALIGNED
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(aligned, ALIGNED_DDL)


@functools.lru_cache(maxsize=2)
def _memo(byte_level: str, pieces: str) -> Memo:
    return Memo(byte_level_side(byte_level), piece_encoder(pieces)[0])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n: documents that hold it, a: its A id)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counted.withColumn("a", F.shiftright("pair", 32))


SUMS = pa.schema(
    [
        ("row", pa.int64()),
        ("n_best", pa.int64()),
        ("count_sum", pa.int64()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)
SUMS_DDL = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"


def sums_of_frequent(aligned: DataFrame, frequent) -> DataFrame:
    """Per row the sums over its frequent pairs, and the others with their ``times``.

    ``frequent`` is a broadcast of sorted pairs, their counts and whether they are the best.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = frequent.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            lengths = np.diff(batch.column("pairs").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * counts[at[hit]])
            rest = np.bincount(row[~hit], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            columns = [
                batch.column("row"),
                *map(pa.array, sums),
                *[pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pairs, times)],
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SUMS)

    return aligned.select("row", "pairs", "times").mapInArrow(summed, SUMS_DDL)


def align_documents(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document.

    ``n_best`` counts the links whose pair is held by as many documents as any of its A id,
    ``count_sum`` sums the documents that hold the pair over all links.
    """
    aligned = stage(spark, aligned_documents(docs, byte_level, pieces), "aligned")
    counted = stage(spark, pair_counts(aligned), "pair_counts")
    # at most one row for each entry of the A vocabulary
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    counts = stage(
        spark,
        counted.join(F.broadcast(highest), "a").select(
            "pair", "n", (F.col("n") == F.col("highest")).alias("best")
        ),
        "counts",
    )
    # fewer than FREQUENT_PAIRS pairs can be held by more than that part of all (document, pair) rows
    least = (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT_PAIRS
    frequent = counts.where(F.col("n") > least).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(
        tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best"))
    )
    sums = stage(spark, sums_of_frequent(aligned, sent), "sums")
    rare = (
        sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
        .select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
        .join(counts.where(F.col("n") <= least), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
            F.sum(F.col("times") * F.col("n")).alias("rare_sum"),
        )
    )
    return (
        aligned.drop("pairs", "times")
        .join(sums.drop("pairs", "times"), "row")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
            "groups_sha256",
        )
    )
