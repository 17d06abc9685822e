from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from starscan.llm import embdedup, queries, topk

NAN, INF = float("nan"), float("inf")
ODD = [
    (7001, None), (7002, []), (7003, [0.0] * 64), (7004, [1.0, None] * 32), (7005, [NAN] * 64), (7050, [INF] * 64),
    (7100, [0.5, -0.25]), (7101, [0.5, -0.25]), (7150, [1e-3, 2.0]), (None, [0.1] * 64), (7200, [3.0] * 64),
    (7201, [0.01] * 64), (7201, [0.01] * 64), (7202, [-0.5] * 64),
]


def rows_of(sf_dir, n=150, copies=0):
    sql = f"SELECT vec_id, embedding FROM read_parquet('{sf_dir}/embeddings.parquet') ORDER BY 1 LIMIT {n}"
    rows = duckdb.connect().execute(sql).fetchall()
    rng = np.random.default_rng(5)
    for i in range(copies):
        base = np.array(rows[i % 5][1])
        rows.append((8000 + i, (base + rng.normal(0, 0.02, len(base))).tolist()))
    return rows + ODD


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return frame.withColumns({c: F.lit(1) for c in ("id", "vec", "home", "cell", "label", "rank", "score")})


def usable(vec):
    return vec is not None and all(x is not None and np.isfinite(x) for x in vec)


def best_by_hand(rows, k=5):
    vecs = {i: np.floor(256 * np.array(np.float32(v), np.float64)).astype(int) for i, v in rows if i is not None and usable(v)}
    out = Counter()
    for q in vecs:
        if q % 50 == 0:
            scored = [(-int(v @ vecs[q]), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q])]
            for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
                out[q, rank, i, -score] += 1
    return out


@pytest.mark.parametrize("sizes", [(4096, 8192), (2, 40)])
def test_top_k(spark, sf_dir, monkeypatch, sizes):
    monkeypatch.setattr(topk, "QUERY_ROWS", sizes[0])
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", sizes[1])
    rows = rows_of(sf_dir)
    found = queries.nearest(spark, frame_of(spark, rows))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == best_by_hand(rows)


def test_elimination_skips_far_candidates():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (20, 8))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 5, (4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    q, i, s, computed = topk.search_block(ids[:40], x[:40], ids, x, 5)
    assert computed < 0.5 * 40 * 4000
    for n in range(40):
        order = np.lexsort((ids, -(x @ x[n])))
        want = [(int(j), int(x[j] @ x[n])) for j in order if j != n][:5]
        assert list(zip(i[q == n].tolist(), s[q == n].tolist())) == want


def test_large_numbers_stay_exact():
    big = np.array([[2**30 + 1, 3], [2**30, 5], [-(2**30), 1]], np.int64)
    _, i, s, _ = topk.search_block(np.array([9]), big[:1], np.arange(3), big, 2)
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(big[0], v)), n) for n, v in enumerate(big)))[:2]
    assert [(-x, n) for x, n in want] == list(zip(s.tolist(), i.tolist()))


def groups_by_hand(rows, cosine=0.9):
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i or 0))
    vecs = {}
    for i, v in rows:
        if i is not None and usable(v) and any(v):
            v = np.array(np.float32(v), np.float64)
            vecs[i] = v / np.linalg.norm(v)
    links = {i: [j for j in vecs if j != i and len(vecs[i]) == len(vecs[j]) and vecs[i] @ vecs[j] >= cosine] for i in vecs}
    out = Counter()
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(seen, key=lambda x: x if x is not None else 0)
        out[i, len(links.get(i, [])), root, root == i and i is not None] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_copies(spark, sf_dir, monkeypatch, small):
    if small:
        for name, n in (("CELL_ROWS", 20), ("HOME_ROWS", 7), ("VISITOR_ROWS", 9), ("COLUMNS", 4), ("SAMPLE_ROWS", 60)):
            monkeypatch.setattr(embdedup, name, n)
    rows = rows_of(sf_dir, copies=60)
    margin = np.sqrt(0.2) if small else 0.12
    found = embdedup.near_copies(spark, frame_of(spark, rows), margin=margin)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == groups_by_hand(rows)


def test_recall_at_the_threshold():
    """Pairs just above the threshold, in the worst case random directions: at least 0.9 are met."""
    rng = np.random.default_rng(1)
    x = embdedup.unit(rng.normal(size=(20_000, 64)))
    side = embdedup.unit(rng.normal(size=x.shape))
    side = embdedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.91 * x + np.sqrt(1 - 0.91**2) * side
    centres = embdedup.fit_centres(x[:5000], 25)
    home_x, visits_x = embdedup.assign(x, centres, 0.12)
    home_y, visits_y = embdedup.assign(y, centres, 0.12)
    n = np.arange(len(x))
    assert (visits_x[n, home_y] | visits_y[n, home_x]).mean() > 0.9


def test_empty(spark):
    frame = frame_of(spark, [])
    assert queries.nearest(spark, frame).collect() == []
    assert embdedup.near_copies(spark, frame).collect() == []


def test_valid_vector_beside_one_with_null(spark):
    rows = [(1, [None, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-INF, 1.0]), (3, [1.0, 0.0]), (4, [None, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(frame, "vec_id", "embedding", 256)
    assert sorted((r.id, r.vec) for r in vectors.collect()) == [(i, [256, 0]) for i in (1, 2, 3)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_copies(spark, frame).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
