"""SimHash near-duplicates: a binary trie over the fingerprints joined with itself.

Pairs of trie nodes are traversed together. A pair carries the bits in which its prefixes differ and is
dropped as soon as they exceed the budget. Above, the traversal is a DataFrame: eight levels at a time,
each fingerprint is sent to the nodes it can still match, as long as a node has more rows than a task
should take. Below, each node is one task that goes on in numpy, down to leaf pairs.

Two tries share the work: fingerprints that differ in at most ``bits`` bits differ in at most
``bits // 2`` of the first half, or in fewer than ``bits - bits // 2`` of the second. So one trie
allows ``bits // 2`` differences in its first half, the other, with the halves swapped, one less
than the rest. That keeps the node pairs few.

Equal fingerprints are one entry of the trie. A task returns a spanning link for each fingerprint that
has a partner, never the pairs; node pairs whose entries are all connected already are skipped.

Defined results. Null or wordless text: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is one. Very long texts: hashed in slices. Repeated rows: a result each,
linked with each other. Null doc_id: a result; never a component's id while the component has another.
Empty table: no row. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import components, local_components, lookup, ranges, stage, text_chunks

SEED = 42
#: Rows of a trie node that one task takes; nodes with more are opened eight levels further.
NODE_ROWS = 1 << 18
#: Bytes of a text that are hashed at once.
SLICE_BYTES = 1 << 20
#: A pair of node ranges with at most so many pairs of entries is a leaf.
LEAF_PAIRS = 64
#: Ids that are sent to all tasks at once, 8 bytes each; more are joined in a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Node pairs and pairs of entries held at once.
FRONTIER = 1 << 17
PAIRS_AT_ONCE = 1 << 21

_BLANK = b" \t\n\x0b\x0c\r"


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        # the last word of a slice may go on, so it waits for the next one
        end = max(data.rfind(bytes([b]), at, at + SLICE_BYTES) for b in _BLANK)
        if end <= at:
            later = [p for b in _BLANK if (p := data.find(bytes([b]), at + SLICE_BYTES)) >= 0]
            end = min(later, default=len(data))
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def shingle_hashes(text: str, words_per_shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles in order, a slice at a time; none for a text without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    whole = True
    # bytes.lower and bytes.split know ASCII only
    for words in _slices(text.encode().lower()):
        words = carry + words
        if len(words) < words_per_shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        last = words_per_shingle - 1
        cuts = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in cuts], "<u8")
        whole = False
        carry = words[len(words) - last :]
    if whole and carry:
        yield np.array([digest(b" ".join(carry), SEED)], "<u8")


def fingerprint(text: str, words_per_shingle: int = 4) -> int:
    """The fingerprint as an unsigned number."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words_per_shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp: the fingerprint's bits as a long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            found = [fingerprint(t.as_py() or "", words_per_shingle) for t in chunk.column("text")]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), column], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _budget(order: int, depth: int, bits: int) -> int:
    """Differences allowed within the first ``depth`` levels of a trie."""
    if depth > 32:
        return bits
    return bits // 2 if order == 0 else bits - bits // 2 - 1


def _opened(rows: DataFrame, order: int, depth: int, bits: int) -> DataFrame:
    """Rows (key, node, err) of nodes at ``depth``, sent on to the nodes eight levels below.

    A row goes to its own node and to larger ones only, so that two nodes meet once.
    """
    masks = [
        (sum(1 << i for i in chosen), n)
        for n in range(min(8, _budget(order, depth + 8, bits)) + 1)
        for chosen in combinations(range(8), n)
    ]
    byte = F.shiftrightunsigned("key", 56 - depth).bitwiseAND(F.lit(255))
    choices = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("n")) for m, n in masks])
    child = byte.bitwiseXOR(F.col("c.mask"))
    return (
        rows.select("key", "node", "err", F.explode(choices).alias("c"))
        .where(F.col("err") + F.col("c.n") <= _budget(order, depth + 8, bits))
        .where((F.col("err") > 0) | (child >= byte))
        .select(
            "key",
            (F.shiftleft("node", 8) + child).alias("node"),
            (F.col("err") + F.col("c.n")).alias("err"),
        )
    )


_STEP = np.arange(4)
_PAIR_A, _PAIR_B = (x.reshape(-1) for x in np.meshgrid(_STEP, _STEP, indexing="ij"))
_PAIR_BITS = np.bitwise_count(_PAIR_A ^ _PAIR_B).astype(np.int64)


def join_node(keys: np.ndarray, first: int, last: int, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the entries ``first`` to ``last`` with all entries of sorted distinct unsigned ``keys``.

    Returned as index pairs that connect what is connected, not as all pairs.
    """
    home = keys[first:last]
    left, right = [], []
    # neighbours at one bit, by look-up: they connect crowds before pairs are tried
    for bit in range(64):
        other = home ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == other)
        left.append(hit + first)
        right.append(at[hit])
    label = local_components(len(keys), np.concatenate(left), np.concatenate(right))
    left, right = [np.arange(len(keys))], [label]
    # same[i]: where the run of entries with the label of i ends
    change = np.append(np.flatnonzero(np.diff(label)) + 1, len(keys))
    same = change[np.searchsorted(change, np.arange(len(keys)), "right")]

    def leaves(pairs: np.ndarray) -> None:
        """Compares all entries of the ranges (h0, h1, a0, a1)."""
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_AT_ONCE)) + 1
        for part in np.split(pairs, cuts):
            h0, h1, a0, a1 = part.T
            i = ranges(h0, h1 - h0)
            wide = np.repeat(a1 - a0, h1 - h0)
            j = ranges(np.repeat(a0, h1 - h0), wide)
            i = np.repeat(i, wide)
            near = np.bitwise_count(keys[i] ^ keys[j]) <= bits
            near &= label[i] != label[j]
            left.append(i[near])
            right.append(j[near])

    stack = [(0, np.array([[first, last, 0, len(keys)]], np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, pairs, err = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half], err[:half]), (depth, pairs[half:], err[half:])]
            continue
        h0, h1, a0, a1 = pairs.T
        joined = (same[h0] >= h1) & (same[a0] >= a1) & (label[h0] == label[a0])
        behind = (a0 >= first) & (a1 <= h0)
        keep = ~joined & ~behind
        pairs, err = pairs[keep], err[keep]
        h0, h1, a0, a1 = pairs.T
        leaf = ((h1 - h0) * (a1 - a0) <= LEAF_PAIRS) | (depth >= 64)
        if leaf.any():
            leaves(pairs[leaf])
        pairs, err = pairs[~leaf], err[~leaf]
        if not len(pairs):
            continue
        h0, h1, a0, a1 = pairs.T
        shift = np.uint64(62 - depth)
        above = ~np.uint64(0) << np.uint64(64 - depth) if depth else np.uint64(0)
        bounds = []
        for low, high in ((h0, h1), (a0, a1)):
            prefix = keys[low] & above
            edges = [low]
            for step in (1, 2, 3):
                # entries of the range lie together, so a search over all finds the cut in it
                cut = np.searchsorted(keys, prefix | np.uint64(step) << shift)
                edges.append(np.clip(cut, low, high))
            bounds.append(np.stack([*edges, high], axis=1))
        hs, az = bounds
        children = np.stack(
            [hs[:, _PAIR_A], hs[:, _PAIR_A + 1], az[:, _PAIR_B], az[:, _PAIR_B + 1]], axis=2
        ).reshape(-1, 4)
        errors = (err[:, None] + _PAIR_BITS[None, :]).reshape(-1)
        alive = (
            (errors <= _budget(order, depth + 2, bits))
            & (children[:, 0] < children[:, 1])
            & (children[:, 2] < children[:, 3])
        )
        stack.append((depth + 2, children[alive], errors[alive]))
    return np.concatenate(left), np.concatenate(right)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _swap(keys: np.ndarray) -> np.ndarray:
    return keys << np.uint64(32) | keys >> np.uint64(32)


def _joiner(order: int, bits: int):
    """The task of a trie node: its entries joined with those sent to it."""

    def join(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        sort = np.argsort(keys)
        keys = keys[sort]
        home = np.flatnonzero(table.column("err").to_numpy()[sort] == 0)
        if not len(home):
            return LINKS.empty_table()
        i, j = join_node(keys, int(home[0]), int(home[-1]) + 1, order, bits)
        label = local_components(len(keys), i, j)
        apart = np.flatnonzero(label != np.arange(len(keys)))
        if order:
            keys = _swap(keys)
        ends = [keys[apart].view(np.int64), keys[label[apart]].view(np.int64)]
        return pa.Table.from_arrays([pa.array(e) for e in ends], schema=LINKS)

    return join


def near_links(spark: SparkSession, distinct: DataFrame, bits: int) -> DataFrame:
    """Spanning links (a, b) between the fingerprints ``fp`` that differ in at most ``bits`` bits."""
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    links = None
    for order in (0, 1):
        if order and bits - bits // 2 - 1 < 0:
            continue

        rows = distinct.select(
            (swapped if order else F.col("fp")).alias("key"),
            F.lit(0).cast("long").alias("node"),
            F.lit(0).alias("err"),
        )
        depth = 0
        while True:
            rows, depth = _opened(rows, order, depth, bits), depth + 8
            if depth == 56:
                ready, rows = rows, None
            else:
                rows = stage(spark, rows, "nodes")
                # at most a million nodes, which are sent to all tasks
                limit = max(NODE_ROWS, rows.count() // MAX_BROADCAST_IDS)
                sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("err").alias("err"))
                crowded = stage(spark, sizes.where(F.col("n") > limit), "crowded")
                if crowded.isEmpty():
                    ready, rows = rows, None
                else:
                    ready = rows.join(F.broadcast(crowded.select("node")), "node", "left_anti")
                    # a node that only others have been sent to has nothing to join
                    with_home = crowded.where("err = 0").select("node")
                    rows = rows.join(F.broadcast(with_home), "node", "left_semi")
            found = ready.groupBy("node").applyInArrow(_joiner(order, bits), "a long, b long")
            links = found if links is None else links.unionByName(found)
            if rows is None:
                break
    return links


def near_duplicates(
    spark: SparkSession, docs: DataFrame, bits: int = 4, words_per_shingle: int = 4
) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``docs``."""
    hashed = stage(spark, fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = stage(
        spark,
        hashed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")),
        "distinct",
    )
    return named_groups(spark, hashed, distinct, near_links(spark, distinct, bits))


def named_groups(spark: SparkSession, hashed: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, component_id) of the staged rows (doc_id, fp), grouped by links between fp.

    ``distinct`` has a row (fp, first: smallest doc_id, n: rows) for each fp.
    """
    roots = components(spark, links)
    rooted = stage(
        spark,
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        ),
        "rooted",
    )
    named = stage(
        spark,
        rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")),
        "named",
    )
    of_fp = stage(spark, lookup(rooted, named, "root", "size").select("fp", "component_id", "n"), "of_fp")
    return lookup(hashed, of_fp, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, bits: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; all columns.

    Of rows that repeat a doc_id one stays, that with the smallest text. Rows without a doc_id cannot
    be told apart by it and all stay.
    """
    return keep_first(spark, docs, near_duplicates(spark, docs, bits, words_per_shingle))


def keep_first(spark: SparkSession, docs: DataFrame, near: DataFrame) -> DataFrame:
    """``keep_one`` by the groups (doc_id, component_id) of all rows."""
    near = stage(spark, near, "near")
    per_id = near.where("doc_id is not null").groupBy("doc_id").agg(
        F.bool_and(F.col("doc_id") == F.col("component_id")).alias("__kept"), F.count("*").alias("__rows")
    )
    # what goes, or needs a choice among its rows, is the smaller part as a rule
    apart = stage(spark, per_id.where("not __kept or __rows > 1"), "apart")
    ids = apart.select("doc_id")
    if apart.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    out = docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    # rows that repeat an id may differ in text, and so in their group: one that stays is chosen
    several = apart.where("__rows > 1").select("doc_id")
    if several.isEmpty():
        return out
    chosen = near.where("doc_id = component_id").select("doc_id").distinct().join(several, "doc_id", "left_semi")
    rows = docs.join(chosen, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("r"))
    once = rows.groupBy("r.doc_id").agg(F.min_by("r", F.struct("r.text")).alias("r")).select("r.*")
    return out.unionByName(once)
