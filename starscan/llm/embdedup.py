"""Near copies among vectors: spherical k-means cells, blocked cosine products inside a cell.

Centres are fitted on a bounded sample; every vector gets its nearest centre as home. A vector also
visits each cell whose boundary with its home lies within ``margin``: a neighbour at a distance of at
most ``margin`` is then surely met, others with a high chance (with ``margin = sqrt(2 - 2 * cosine)``
none can be missed, at the price of more visits). Cells are cut into blocks of bounded size, and each
pair of blocks is one task, so that no cell, however crowded, lands in one. A task returns for
each linked vector its number of links and one representative of its group, never the pairs.

Defined results. Vectors that are null, zero, empty or hold null or non-finite components link with
nothing. Repeated ids: one vector (the smallest array). A row without an id links with nothing and
is not kept. Vectors link only with those of equal length. Empty table: no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import components, local_components, stage
from starscan.llm.vectors import is_finite, matrix, one_per_id

#: Vectors that the centres are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Vectors per cell that are aimed at, and cells at most.
CELL_ROWS = 2_048
MAX_CELLS = 1_024
ROUNDS = 10
#: Rows of a block of vectors at home in a cell, and of visitors.
HOME_ROWS = 2_048
VISITOR_ROWS = 8_192
#: Columns of a product that are held at once.
COLUMNS = 1_024

LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a spherical k-means over unit vectors, from evenly spaced first centres."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def assign(rows: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and whether it is at home in or visits a cell (rows x cells)."""
    near = rows @ centres.T
    home = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    gap = near[np.arange(len(rows)), home][:, None] - near
    visits = gap <= margin * apart + 1e-12
    visits[np.arange(len(rows)), home] = True
    return home, visits


def linked(left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with at least that cosine; ``same``: each unordered pair once."""
    a, b = [], []
    for at in range(0, len(right), COLUMNS):
        close = left @ right[at : at + COLUMNS].T >= cosine
        if same:
            close &= np.arange(len(left))[:, None] < np.arange(at, at + close.shape[1])[None, :]
        i, j = np.nonzero(close)
        a.append(i.astype(np.int32))
        b.append((j + at).astype(np.int32))
    return np.concatenate(a), np.concatenate(b)


def near_copies(
    spark: SparkSession,
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.9,
    margin: float = 0.12,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per id."""
    every = stage(spark, one_per_id(rows, vec_id, embedding), "vectors")
    valid = every.where(is_finite("vec")).where(
        F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0)
    )
    found = None
    # one run per length of vectors; a table has one as a rule
    for (width,) in valid.select(F.size("vec")).distinct().collect():
        part = _links(spark, valid.where(F.size("vec") == width), width, cosine, margin)
        found = part if found is None else found.unionByName(part)
    if found is None:
        links, roots = None, None
    else:
        found = stage(spark, found, "found")
        links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
        edges = found.select(F.col("id").alias("a"), F.col("label").alias("b")).where("a <> b")
        roots = components(spark, edges).select(F.col("node").alias("id"), "root")
    out = every.select("id")
    if links is not None:
        out = out.join(links, "id", "left").join(roots, "id", "left")
    else:
        out = out.withColumns({"n_links": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    root: Column = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"),
        F.coalesce(root == F.col("id"), F.lit(False)).alias("kept"),
    )


def _links(spark: SparkSession, valid: DataFrame, width: int, cosine: float, margin: float) -> DataFrame:
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toArrow()
    n = valid.count()
    cells = min(MAX_CELLS, max(1, n // CELL_ROWS), len(sample))
    centres = fit_centres(unit(matrix(sample.column("vec"), width)), cells)

    def assigned(batches):
        for batch in batches:
            home, visits = assign(unit(matrix(batch.column("vec"), width)), centres, margin)
            cells_of = [np.flatnonzero(v) for v in visits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(home), pa.array(cells_of, pa.list_(pa.int64()))],
                ["id", "vec", "home", "cells"],
            )

    kind = valid.schema["vec"].dataType.simpleString()
    placed = stage(
        spark,
        valid.mapInArrow(assigned, f"id long, vec {kind}, home long, cells array<long>"),
        "placed",
    )
    # at most MAX_CELLS rows
    at_home = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    visiting = {
        r["cell"]: r["n"]
        for r in placed.select("home", F.explode("cells").alias("cell"))
        .where("cell <> home")
        .groupBy("cell")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    blocks = lambda counts, most: F.array(
        *[F.lit(max(1, -(-counts.get(c, 0) // most))) for c in range(cells)]
    )
    spread = F.xxhash64("id")
    each = placed.select("*", F.explode("cells").alias("cell")).withColumns(
        {
            "h": F.element_at(blocks(at_home, HOME_ROWS), (F.col("cell") + 1).cast("int")),
            "v": F.element_at(blocks(visiting, VISITOR_ROWS), (F.col("cell") + 1).cast("int")),
        }
    )
    home_block, visitor_block = F.pmod(spread, F.col("h")), F.pmod(spread, F.col("v"))
    task = lambda kind, i, j, role: F.struct(
        F.lit(kind).alias("kind"),
        i.cast("long").alias("i"),
        j.cast("long").alias("j"),
        F.lit(role).alias("role"),
    )
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    homes_meet = F.transform(
        upto(F.col("h")),
        lambda k: F.when(k >= home_block, task("home", home_block, k, 0)).otherwise(
            task("home", k, home_block, 1)
        ),
    )
    homes_receive = F.transform(upto(F.col("v")), lambda k: task("visit", home_block, k, 0))
    visitors_call = F.transform(upto(F.col("h")), lambda k: task("visit", k, visitor_block, 1))
    tasks = F.when(F.col("home") == F.col("cell"), F.concat(homes_meet, homes_receive)).otherwise(
        visitors_call
    )
    dealt = each.select("id", "vec", "home", "cells", "cell", F.explode(tasks).alias("t")).select(
        "id", "vec", "home", "cells", "cell", "t.*"
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell, what, i, j = (x.as_py() for x in key)
        ids = table.column("id").to_numpy()
        role = table.column("role").to_numpy()
        vectors = unit(matrix(table.column("vec"), width))
        ours, theirs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if what == "home" and i == j:
            theirs = ours
        if not len(ours) or not len(theirs):
            return LINKS.empty_table()
        a, b = linked(vectors[ours], vectors[theirs], cosine, theirs is ours)
        if what == "visit" and len(a):
            # a pair that meets in both homes counts in the smaller one
            visits = np.zeros((len(ours), cells), bool)
            lists = table.column("cells").combine_chunks().take(pa.array(ours))
            visits[np.repeat(np.arange(len(ours)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
            home = table.column("home").to_numpy()[theirs[b]]
            once = ~(visits[a, home] & (home < cell))
            a, b = a[once], b[once]
        if not len(a):
            return LINKS.empty_table()
        rows, at = np.unique(np.concatenate([ours[a], theirs[b]]), return_inverse=True)
        order = np.argsort(ids[rows])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[at]
        by_id = ids[rows][order]
        label = local_components(len(rows), at[: len(a)], at[len(a) :])
        return pa.Table.from_arrays(
            [pa.array(by_id), pa.array(np.bincount(at, minlength=len(rows))), pa.array(by_id[label])], schema=LINKS
        )

    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(compare, "id long, links long, label long")
