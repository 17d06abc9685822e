import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from fixtures import documents_frame, some_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from test_bitpack import crc, whole_ids

from starscan.llm import packing, queries


def check_places(found, capacity):
    """Gapless from 0, within capacity, nothing overlapping; returns the number of sequences."""
    sequences = defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(spark, sf_dir):
    rows = some_documents(sf_dir)
    expected, tokens = Counter(), 0
    for (doc_id, _), ids in zip(rows, whole_ids([t for _, t in rows], "byte_bpe_50k.json"), strict=True):
        ids = [*ids, 2]
        tokens += len(ids)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, crc(ids[a:b])] += 1
    frame = documents_frame(spark, rows)
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    found = packing.pack_documents(spark, frame, vocabulary, 2, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    assert check_places(found, 1024) <= -(-tokens // 1024) + 1


def test_empty(spark):
    frame = documents_frame(spark, [], 1)
    assert packing.pack_documents(spark, frame, queries.vocabulary("byte_bpe_50k.json"), 2).collect() == []


def fewest(sizes, capacity):
    """The least number of bins, by trying all subsets that hold the largest size."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in chosen) <= capacity:
                left = tuple(s for i, s in enumerate(rest) if i not in chosen)
                best = min(best, 1 + fewest(left, capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_plan_is_complete_and_short(sizes):
    plan, sequences, bound = packing.make_plan(dict(Counter(sizes)), 20)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 20 and times > 0
        for size in filling:
            used[size] += times
    assert used == Counter(sizes)
    least = fewest(tuple(sorted(sizes, reverse=True)), 20)
    assert sum(times for _, times in plan) == sequences == least
    assert bound <= least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 20), min_size=1, max_size=7), st.integers(1, 6))
def test_a_search_that_ends_early_proves_nothing(sizes, steps):
    counts, least = dict(Counter(sizes)), fewest(tuple(sorted(sizes, reverse=True)), 20)
    assert packing.bin_completion(counts, 20, least - 1) == packing.Search(None, True)
    found = packing.bin_completion(counts, 20, least, steps)
    assert not found.proven and (found.plan is None or sum(t for _, t in found.plan) <= least)
    # with too few steps the incumbent stays, and it is complete
    cut = packing.make_plan(counts, 20, steps)
    assert sum(len(f) * t for f, t in cut.plan) == len(sizes)
    assert cut.bound <= least <= cut.sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6), st.integers(5, 16))
def test_dominated_fillings(sizes, room):
    """By trying every subset of the filling against every piece that is left."""
    counts = dict(Counter(sizes))
    for filling in packing.fillings(counts, room, room):
        left = Counter(sizes) - Counter(filling)
        waste = room - sum(filling)
        want = any(
            x - waste <= sum(out) <= x and out != (x,)
            for x in left
            for n in range(len(filling) + 1)
            for out in combinations(filling, n)
            if x <= room
        )
        assert packing.dominated(filling, counts, room) == want


def test_the_branches_of_a_length():
    """Of (201, 201), (201, 200), (400) and (200, 200) in 500 two are dominated."""
    counts = {400: 1, 399: 1, 201: 2, 200: 2}
    tried = [f for f in packing.fillings(counts, 500, 100) if not packing.dominated(f, counts, 500)]
    assert tried == [(201, 201), (400,)]


def test_large_histogram_reaches_the_bound():
    rng = np.random.default_rng(3)
    counts = {int(s): int(rng.integers(1, 10**9)) for s in range(1, 1025)}
    plan, sequences, bound = packing.make_plan(counts, 1024)
    assert sum(times for _, times in plan) == sequences <= 1.02 * bound
