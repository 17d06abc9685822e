import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import documents_frame, some_documents
from pyspark.sql import functions as F

from starscan.llm import queries, simhash
from starscan.llm.common import components, local_components


def fingerprint_by_hand(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps):
    """Component of each index over pairs of at most 4 differing bits."""
    x = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    return local_components(len(x), i, j)


def expected(rows):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    label = groups_by_hand(fps)
    least = {}
    for (doc_id, _), group in zip(rows, label):
        if doc_id is not None:
            least[group] = min(doc_id, least.get(group, doc_id))
    return Counter((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, label))


@pytest.mark.parametrize("node_rows", [1 << 18, 60])
def test_query(spark, sf_dir, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rows = some_documents(sf_dir)
    words = rows[5][1].split()
    rows += [(800_000 + i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in range(25)]
    found = queries.fingerprint_groups(spark, documents_frame(spark, rows))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in found.collect()) == expected(rows)


def test_empty(spark):
    assert queries.fingerprint_groups(spark, documents_frame(spark, [], 1)).collect() == []


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i % 89}é" for i in range(400)) + "\n  tail " + "x" * 300 + " end"
    want = fingerprint_by_hand(text)
    for size in (1, 7, 50, 1000):
        monkeypatch.setattr(simhash, "SLICE_BYTES", size)
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("spread", [2, 3, 6])
def test_trie_join_against_brute_force(order, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    keys = centres[rng.integers(0, 12, 1500)]
    for _ in range(spread):
        keys = keys ^ np.uint64(1) << rng.integers(0, 64, len(keys)).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    swapped = np.sort(simhash._swap(keys))
    i0, j0 = simhash.join_node(keys, 0, len(keys), 0, 4)
    i1, j1 = simhash.join_node(swapped, 0, len(keys), 1, 4)
    back = np.searchsorted(keys, simhash._swap(swapped))
    label = local_components(len(keys), np.concatenate([i0, back[i1]]), np.concatenate([j0, back[j1]]))
    assert np.array_equal(label, groups_by_hand(keys))


def test_trie_levels_in_spark(spark, monkeypatch):
    """Nodes opened down to the last level, where only equal prefixes and crowds remain."""
    monkeypatch.setattr(simhash, "NODE_ROWS", 60)
    rng = np.random.default_rng(9)
    keys = np.uint64(0xFFFF0000FFFF0000) ^ (rng.integers(0, 2**12, 120, dtype=np.uint64) << np.uint64(5))
    keys = np.unique(np.concatenate([keys, rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    links = simhash.near_links(spark, frame, 4).collect()
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    label = local_components(
        len(keys), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links])
    )
    assert np.array_equal(label, groups_by_hand(keys))


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, i) for i in range(2000, 2100)]
    pairs = chain + star + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    links = np.array([(at[a], at[b]) for a, b in pairs if a != b])
    label = local_components(len(nodes), links[:, 0], links[:, 1])
    found = {r.node: r.root for r in components(spark, frame).collect()}
    assert found == {x: nodes[label[i]] for x, i in at.items()}
    assert components(spark, frame.where("false")).collect() == []


def test_keep_one(spark, sf_dir):
    rows = some_documents(sf_dir, 60)
    frame = documents_frame(spark, rows)
    kept = simhash.keep_one(spark, frame)
    assert kept.columns == frame.columns
    want = Counter()
    for (doc_id, fp, root), n in expected(rows).items():
        if doc_id is None or doc_id == root:
            want[doc_id] += 1 if doc_id is not None else n
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(spark, frame.where(F.lit(False))).collect() == []
