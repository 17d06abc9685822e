"""Documents packed into sequences of at most ``capacity`` tokens, in as few as can be found.

Only lengths matter, and there are at most ``capacity`` of them: the plan is made for the histogram of
lengths, by bin completion with branch and bound. Around the largest length left, undominated fillings
(largest lengths first) are tried in order of their waste; a filling is applied as often as the counts
allow, then less often; a branch is cut when its waste exceeds what a solution better than the
incumbent can afford. The incumbent comes from best fit on the same histogram. A search ends when it
finds a plan, when everything has been tried, which proves that there is none, or after ``STEPS``
fillings. Work and memory of the plan depend on ``capacity`` only. The pieces then find their place by
their rank among pieces of equal length.

Defined results. Null text: empty, so only the end id. Null doc_id: kept. Repeated rows and ids: packed
each for itself. Empty table: no piece. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.llm.common import stage, text_chunks
from starscan.llm.tokens import CACHE_PIECES, encode_texts, library_encoder

#: Fillings that a search looks at, dominated ones included.
STEPS = 4_000

Plan = list[tuple[tuple[int, ...], int]]


class Search(NamedTuple):
    """A plan, or None; in that case whether it is proven that there is none."""

    plan: Plan | None
    proven: bool


class Packing(NamedTuple):
    """A plan, its sequences, and the least number of sequences that is proven to be needed."""

    plan: Plan
    sequences: int
    bound: int


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Around the largest length, always the largest length that still fits."""
    left, plan = dict(counts), []
    while left:
        room, filling, used = capacity, [], {}
        for size in sorted(left, reverse=True):
            n = min(left[size], room // size)
            if n:
                filling += [size] * n
                used[size] = n
                room -= n * size
        times = min(left[s] // n for s, n in used.items())
        plan.append((tuple(filling), times))
        left = {s: c for s, n in left.items() if (c := n - times * used.get(s, 0))}
    return plan


def fillings(counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Multisets of the lengths in ``counts`` that leave at most ``most_waste`` of ``room`` empty.

    In order of waste; of equal waste, those of large lengths first.
    """
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    # reach[i]: bit b is set if lengths from the i-th on, each as often as wanted, can sum to b
    reach = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        bits, step = reach[i + 1], sizes[i]
        while step <= room:
            bits |= (bits << step) & mask
            step *= 2
        reach[i] = bits

    def extend(i: int, need: int) -> Iterator[tuple[int, ...]]:
        if not need:
            yield ()
            return
        while reach[i] >> need & 1 and i < len(sizes):
            size = sizes[i]
            for n in range(min(counts[size], need // size), 0, -1):
                if reach[i + 1] >> (need - n * size) & 1:
                    for rest in extend(i + 1, need - n * size):
                        yield (size,) * n + rest
            i += 1

    for waste in range(min(most_waste, room) + 1):
        yield from extend(0, room - waste)


def _sums(sizes: Iterable[int], room: int) -> int:
    """Bit ``s`` is set if some of the lengths sum to ``s``; at most ``room``."""
    bits = 1
    for size in sizes:
        bits |= bits << size
    return bits & ((1 << (room + 1)) - 1)


def dominated(filling: tuple[int, ...], counts: dict[int, int], room: int) -> bool:
    """Whether a longer piece could take the place of some of the filling, or join it.

    Such a filling is never needed: with the two exchanged, the other sequences only have it easier.
    ``counts`` are the pieces available, those of the filling included.
    """
    waste = room - sum(filling)

    def replaced(others: Iterable[int]) -> int:
        """Bit ``x`` is set if pieces out of ``others`` of a length from ``x - waste`` to ``x`` can go."""
        bits, width = _sums(others, room), 1
        while width <= waste:
            bits |= bits << min(width, waste + 1 - width)
            width *= 2
        return bits

    used = Counter(filling)
    bits = replaced(filling)
    for size, n in counts.items():
        if size > room or n <= used[size]:
            continue
        # a piece is no replacement for its like
        if (replaced(s for s in filling if s != size) if used[size] else bits) >> size & 1:
            return True
    return False


def bin_completion(counts: dict[int, int], capacity: int, bins: int, steps: int = STEPS) -> Search:
    """Looks for a plan of at most ``bins`` sequences."""
    slack = bins * capacity - sum(s * n for s, n in counts.items())
    if slack < 0:
        return Search(None, True)
    looked_at = 0

    def options(left: dict[int, int], slack: int) -> Iterator[tuple[tuple[int, ...], int, int] | None]:
        nonlocal looked_at
        largest = max(left)
        rest = {s: c for s, n in left.items() if (c := n - (s == largest))}
        room = capacity - largest
        for filling in fillings(rest, room, slack):
            looked_at += 1
            if dominated(filling, rest, room):
                if looked_at >= steps:
                    return
                continue
            whole = (largest, *filling)
            most = min(left[s] // whole.count(s) for s in set(whole))
            if waste := room - sum(filling):
                most = min(most, slack // waste)
            for times in range(most, 0, -1):
                yield whole, times, waste * times

    path: list = []
    branches: list[Iterator] = []
    states = [(dict(counts), slack)]
    while looked_at < steps:
        left, slack = states[-1]
        if not left:
            return Search([(whole, times) for whole, times, _ in path], False)
        if len(branches) < len(states):
            branches.append(options(left, slack))
        choice = next(branches[-1], None)
        if looked_at >= steps:
            break
        if choice is None:
            branches.pop()
            states.pop()
            if not states:
                return Search(None, True)
            path.pop()
            continue
        looked_at += 1
        whole, times, lost = choice
        path.append(choice)
        used = {s: whole.count(s) * times for s in set(whole)}
        states.append(({s: c for s, n in left.items() if (c := n - used.get(s, 0))}, slack - lost))
    return Search(None, False)


def make_plan(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Packing:
    """Fillings and how often each is used, for a histogram length -> pieces."""
    if not counts:
        return Packing([], 0, 0)
    best = best_fit(counts, capacity)
    most = sum(times for _, times in best)
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    bound = max(bound, sum(n for s, n in counts.items() if 2 * s > capacity))
    # the bound, one more for as long as that is proven impossible, then ever larger shares of the
    # way to the incumbent
    while bound < most:
        found = bin_completion(counts, capacity, bound, steps)
        if found.plan:
            return Packing(found.plan, bound, bound)
        if not found.proven:
            break
        bound += 1
    for bins in sorted({bound + 1, *(bound + (most - bound) * share // 64 for share in (1, 4, 16, 32))}):
        if bound < bins < most and (found := bin_completion(counts, capacity, bins, steps)).plan:
            return Packing(found.plan, sum(times for _, times in found.plan), bound)
    return Packing(best, most, bound)


PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("task", pa.int32()),
        ("nth", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
PIECE_DDL = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids array<int>"
)


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool, memory: int = CACHE_PIECES
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` ids, numbered per task and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary, memory)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for chunk in text_chunks(batches):
            lists = encode_texts(chunk.column("text"), encode, drops_space=False)
            out: dict[str, list] = {name: [] for name in PIECE.names}
            keys = chunk.column("doc_id").to_pylist()
            for key, at, n in zip(keys, lists.starts.tolist(), lists.lengths.tolist(), strict=True):
                ids = np.append(lists.ids[at : at + n], np.int32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    seen[b - a] += 1
                    row = (
                        key, number, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a] - 1,
                        ids[a:b].astype(np.int32) if with_ids else None,
                    )
                    for name, value in zip(PIECE.names, row, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, PIECE)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECE_DDL)


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, task and nth; ``pieces`` is a staged table."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = _places(make_plan(counts, capacity).plan)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths).tolist():
                first, each, base, at = place[size]
                rows = np.flatnonzero(lengths == size)
                slot = np.searchsorted(first, ranks[rows], "right") - 1
                into = ranks[rows] - first[slot]
                sequence[rows] = base[slot] + into // each[slot]
                offset[rows] = at[slot] + into % each[slot] * size
            keep = batch.select([c for c in batch.schema.names if c != "rank"])
            columns = [*keep.columns, pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*keep.schema.names, "sequence_id", "offset"])

    ranked = (
        pieces.join(bases, ["length", "task"])
        .withColumn("rank", F.col("base") + F.col("nth"))
        .drop("base", "nth", "task")
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(placed, ", ".join([*fields, "sequence_id long", "offset long"]))


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, for runs of ranks: first rank, pieces per sequence, first sequence, offset in it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        at = 0
        for size in sorted(set(filling), reverse=True):
            each = filling.count(size)
            rows.setdefault(size, []).append((used.get(size, 0), each, sequence, at))
            used[size] = used.get(size, 0) + each * times
            at += each * size
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 1024,
    with_ids: bool = False,
    memory: int = CACHE_PIECES,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` if asked for.

    ``memory``: stretches of text whose ids a worker remembers.
    """
    pieces = token_pieces(docs, vocabulary, end_id, capacity, with_ids, memory)
    if not with_ids:
        pieces = pieces.drop("ids")
    return pack_pieces(spark, stage(spark, pieces, "pieces"), capacity)
