"""Every operator as a query over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.demo.records import raw_records, write_dump
from starscan.demo.starmap import bodies, crowded, stars, systems, table
from starscan.functions import counts as C
from starscan.functions.geometry import AXES, round2
from starscan.functions.links import fill_template, link_columns, merge_templates
from starscan.operators import nearest, octree
from starscan.operators import report as R
from starscan.operators import search as S
from starscan.operators.latest import keep_latest, load_counts, upsert
from starscan.operators.rollup import body_totals, label_counts
from starscan.plans import catalog, ingest, planner
from starscan.schema import COUNT_COLUMNS, HISTOGRAM_COLUMNS
from starscan.session import configure, scratch_path
from starscan.sinks import write_csv, write_json
from starscan.sources.dump import parse_records, read_dump, read_first
from starscan.sources.parquet import read_staged, write_staged

Query = Callable[[SparkSession, str], DataFrame]

HOME = "Star 7"
RADIUS = 8.0
REFERENCES = ["Star 7", "  star 42", "", "Star 1000", "Star 7 "]
TEMPLATES = {"INARA": "https://example.org/{name_path}?q={name}", "edgis": " ", "edsm": "{bad"}

HIT_COLUMNS = ["name", "distance_ly", *COUNT_COLUMNS, "population", "faction_count",
               "controlling_faction", "claimable"]


def _maps_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.expr(C.canonical_json(n)) for n in HISTOGRAM_COLUMNS})


def _near(
    spark: SparkSession, sf_dir: str, names: list[str], radius: float
) -> tuple[DataFrame, list[tuple]]:
    """The catalogue around some stars, rolled up only there, and where those stars are."""
    points = S.reference_points(stars(spark, sf_dir), S.clean_references(names))
    reach = S.reach([origin for _, *origin in points], radius)
    return systems(spark, sf_dir, near=reach), points


def _written(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """A copy in the scratch folder, for rows that are used several times."""
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# --- search ---


def radius_search(
    spark: SparkSession, sf_dir: str, body_filter: str, claimable_only: bool, limit: int
) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, [HOME], RADIUS)
    found = S.search_one(
        catalogue,
        HOME,
        RADIUS,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
        points=points,
    )
    return found.select(*HIT_COLUMNS)


def query_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, _ = _near(spark, sf_dir, [HOME], RADIUS)
    return _maps_as_text(planner.query_systems(catalogue, HOME.upper(), RADIUS))


def query_systems_without_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, [HOME], RADIUS)
    found = planner.query_systems(
        catalogue, HOME, RADIUS, include_links=False, limit=50, points=points
    )
    return found.select("name", "edsm_url", "inara_url", "edgis_url")


def multi_ref_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, REFERENCES, RADIUS)
    found = S.search_many(
        catalogue, REFERENCES, RADIUS, body_filter="any", limit=60, points=points
    )
    return found.select("ref_ord", "reference_system", "rank", *HIT_COLUMNS)


def multi_ref_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, REFERENCES, RADIUS)
    found = planner.query_multiple_systems(
        catalogue, REFERENCES, RADIUS, claimable_only=True, limit=40, points=points
    )
    return _maps_as_text(found).orderBy("ref_ord", "rank")


def _supplier_stars(spark: SparkSession, sf_dir: str, catalogue: DataFrame) -> DataFrame:
    """One reference per supplier, too many to list on the driver; located among the stars."""
    wanted = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS ref_ord", "concat('STAR ', s_suppkey) AS reference_system"
    )
    return _written(spark, S.locate(catalogue, wanted), "located")


def multi_ref_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best around each reference, best first: all pairs within the radius would grow with
    the square of the stars."""
    catalogue = stars(spark, sf_dir)
    located = _supplier_stars(spark, sf_dir, catalogue)
    wanted = systems(spark, sf_dir).where(S.row_filter("ww_or_elw"))
    rolled = wanted.select("system_key", "name", "total_bodies")
    points = catalogue.select("system_key", *AXES).join(rolled, "system_key")
    found = nearest.best_first(_written(spark, points, "points"), located, 4.0, 5, leaf_points=32).rows
    return found.select("reference_system", "rank", "name", "distance_ly", "total_bodies")


def radius_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stars near each reference, where half of all stars lie in one cell."""
    catalogue = crowded(stars(spark, sf_dir))
    located = _supplier_stars(spark, sf_dir, catalogue)
    points = catalogue.select("system_key", *AXES)
    pairs = octree.radius_join(points, located, 0.2, leaf_points=256, measure=round2("distance"))
    return pairs.selectExpr("reference_system", "system_key", "distance AS distance_ly")


def nearest_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best stars around each reference, best first, where half of all lie in one cell."""
    # the histograms, the dearest part of the roll-up, are not looked at
    plain = systems(spark, sf_dir).drop(*HISTOGRAM_COLUMNS)
    catalogue = _written(spark, crowded(plain), "catalogue")
    located = _supplier_stars(spark, sf_dir, catalogue)
    found = nearest.search_nearest(catalogue, located, 4.0, limit=200, skip_unknown=True, leaf_points=256)
    return found.select("reference_system", "rank", "name", "distance_ly", "total_bodies")


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' references that no star answers to."""
    wanted = table(spark, sf_dir, "customer").selectExpr(
        "concat('sTAR ', c_custkey * 13) AS reference_system"
    )
    located = S.locate(stars(spark, sf_dir), wanted)
    return S.unlocated(located).select("reference_system")


def _loaded(spark: SparkSession, sf_dir: str, parts: int = 12) -> str:
    """The root of a catalogue loaded from the staged star map in several files."""
    configure(spark)
    staged, root = scratch_path(spark, "staged"), scratch_path(spark, "catalog")
    rows = systems(spark, sf_dir).selectExpr(
        "*",
        "system_address AS seq",
        "timestamp_ntz'2024-01-01 00:00:00' AS imported_at",
        "'orders' AS source_tag",
    )
    write_staged(rows.repartition(parts, "system_key"), staged)
    catalog.import_parquet(spark, root, staged)
    return root


def query_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in a loaded catalogue, the reference looked up in its sorted names."""
    root = _loaded(spark, sf_dir)
    points = catalog.reference_points(spark, root, [HOME.upper()])
    found = planner.query_systems(catalog.systems(spark, root), HOME.upper(), RADIUS, points=points)
    return _maps_as_text(found)


def run_log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every file that a full load and a patch of all systems have read."""
    root, dumps = scratch_path(spark, "catalog"), [scratch_path(spark, "dump") for _ in range(2)]
    for edition, (dump, mode) in enumerate(zip(dumps, ["full", "patch"]), start=1):
        write_dump(raw_records(spark, sf_dir, edition), dump, rows_per_file=4000 * edition)
        catalog.import_dump(spark, root, f"{dump}/*/*", mode=mode)
    file_no = F.regexp_extract("source", "file_no=([0-9]+)", 1).cast("long")
    return catalog.run_sources(spark, root).select("load", file_no.alias("file_no"), "records")


def _published(spark: SparkSession, sf_dir: str) -> str:
    root = _loaded(spark, sf_dir)
    database = f"published_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'database')}'")
    catalog.publish(spark, root, database)
    return database


def typed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of a published catalogue."""
    published = spark.table(f"{_published(spark, sf_dir)}.systems")
    return published.select("system_key", "name", *AXES, "population", *COUNT_COLUMNS)


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, nulls and histogram of the counts, as the session catalog has them."""
    database = _published(spark, sf_dir)
    found = []
    for name in COUNT_COLUMNS:
        known = catalog.column_statistics(spark, f"{database}.systems", name)
        height, bins = (part.rpartition(": ")[2] for part in known["histogram"].split(", "))
        plain = [int(known[key]) for key in ("min", "max", "num_nulls")]
        found.append((name, *plain, int(bins), float(height)))
    return spark.createDataFrame(
        found, "column string, least int, largest int, nulls int, bins int, rows_per_bin double"
    )


def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").selectExpr(
        "concat('sTAR ', c_custkey * 7) AS reference_system"
    )
    return S.locate(stars(spark, sf_dir), wanted)


def vector_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points around each label's first one; an axis sums every third component,
    in whole thousandths so that the order of adding cannot matter."""
    third = "filter(embedding, (v, i) -> i % 3 = {n})"
    total = "aggregate({third}, 0L, (sum, v) -> sum + floor(double(v) * 1000))"
    points = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "label",
        *[f"{total.format(third=third.format(n=n))} / 50D AS {a}" for n, a in enumerate(AXES)],
    )
    references = (
        points.groupBy("label")
        .agg(F.min(F.struct("vec_id", *AXES)).alias("first"))
        .selectExpr(
            "label AS ref_label",
            "first.vec_id AS ref_vec",
            *[f"first.{axis} AS r{axis}" for axis in AXES],
        )
    )
    pairs = S.radius_join(points, references, 10.0).where("vec_id <> ref_vec")
    return pairs.selectExpr("ref_label", "vec_id", f"{round2('distance')} AS distance")


# --- roll-ups over body rows ---


def star_body_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body_totals(bodies(spark, sf_dir), "system_address")


def star_histogram(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return label_counts(bodies(spark, sf_dir), "system_address", label)


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps_as_text(systems(spark, sf_dir)).select("name", *HISTOGRAM_COLUMNS)


def derived_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = C.derived_counts(
        "body_type_counts", "body_subtype_counts", "water_world_count", "earthlike_world_count"
    )
    return systems(spark, sf_dir).selectExpr("name", *[f"{c} AS {n}" for n, c in derived.items()])


def alias_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text to a map and the sum under an alias; broken text counts as empty."""
    text = "CASE WHEN event_type = 'error' THEN concat(props, '}') ELSE props END"
    parsed = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{C.parse_counts(text)} AS counts"
    )
    return parsed.selectExpr(
        "event_id", f"{C.alias_sum('counts', ['K'])} AS k_sum", "size(counts) AS key_count"
    )


# --- raw records and dumps ---


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    records = raw_records(spark, sf_dir).selectExpr(
        "record_no", f"explode({parse_records('value')}) AS record", "'orders' AS source_tag"
    )
    return ingest.system_rows(records, ingest.utc_now()).where("name is not null")


RECORD_COLUMNS = ["system_key", "system_address", "name", *AXES, "population",
                  "controlling_faction", "faction_count"]


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).select("record_no", *RECORD_COLUMNS)


def record_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalised(spark, sf_dir).select("record_no", *COUNT_COLUMNS, *HISTOGRAM_COLUMNS)
    return _maps_as_text(rows)


def _both_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = raw_records(spark, sf_dir).selectExpr("record_no * 2 AS record_no", "value")
    second = raw_records(spark, sf_dir, 2).selectExpr("record_no * 2 + 1 AS record_no", "value")
    return first.unionByName(second)


def dump_scan(
    spark: SparkSession, sf_dir: str, compression: str = "none", layout: str = "lines"
) -> DataFrame:
    """Writes the records as array dumps and reads them back; for layout ``any`` each record
    is spread over lines."""
    configure(spark)
    path = scratch_path(spark, "dump")
    records = raw_records(spark, sf_dir)
    if layout == "any":
        records = records.withColumn("value", F.replace("value", F.lit(", "), F.lit(",\n  ")))
    write_dump(records, path, compression=compression)
    dump = read_dump(spark, f"{path}/*/*", layout=layout)
    rows = ingest.system_rows(dump, ingest.utc_now())
    arrival = Window.partitionBy("source_file").orderBy("seq")
    return (
        rows.withColumn("place", F.row_number().over(arrival).cast("long"))
        .where("name is not null")
        .select(
            F.regexp_extract("source_file", "file_no=([0-9]+)", 1).cast("long").alias("file_no"),
            "place",
            F.expr("endswith(source_file, concat('/', source_tag))").alias("tagged"),
            *RECORD_COLUMNS,
            *COUNT_COLUMNS,
        )
    )


def dump_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = scratch_path(spark, "dump")
    write_dump(raw_records(spark, sf_dir), path, rows_per_file=4000)
    chosen = read_first(spark, f"{path}/*/*", n=5555)
    rows = ingest.system_rows(chosen, ingest.utc_now()).where("name is not null")
    return rows.select(*RECORD_COLUMNS, *COUNT_COLUMNS)


def import_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump holding every system twice: the later record counts."""
    dump, root = scratch_path(spark, "dump"), scratch_path(spark, "catalog")
    write_dump(_both_editions(spark, sf_dir), dump)
    catalog.import_dump(spark, root, f"{dump}/*/*")
    return catalog.systems(spark, root).select(*RECORD_COLUMNS, *COUNT_COLUMNS)


def import_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edition as full load, then the second as a patch: every row is updated."""
    full, patch = scratch_path(spark, "dump"), scratch_path(spark, "dump")
    root = scratch_path(spark, "catalog")
    write_dump(raw_records(spark, sf_dir), full)
    write_dump(raw_records(spark, sf_dir, 2), patch, compression="gzip")
    catalog.import_dump(spark, root, f"{full}/*/*")
    catalog.import_dump(spark, root, f"{patch}/*/*", mode="patch")
    return catalog.systems(spark, root).select(*RECORD_COLUMNS, *COUNT_COLUMNS)


def import_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run log says after converting a dump and loading the parts."""
    dump, parts = scratch_path(spark, "dump"), scratch_path(spark, "parts")
    root = scratch_path(spark, "catalog")
    write_dump(_both_editions(spark, sf_dir), dump, rows_per_file=6000)
    seen = ingest.convert_dump(spark, f"{dump}/*/*", parts)
    catalog.init_catalog(spark, root)
    catalog.import_source(spark, root, parts)
    log = catalog.latest_values(catalog.read_log(spark, root))
    shown = ["schema_version", "last_import_mode", "last_import_systems_seen",
             "last_import_systems_written"]
    converted = spark.range(1).select(
        F.explode(
            F.create_map(
                F.lit("converted_seen"), F.lit(str(seen["systems_seen"])),
                F.lit("converted_written"), F.lit(str(seen["systems_written"])),
            )
        )
    )
    return log.where(F.col("key").isin(shown)).unionByName(converted)


def staged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged Parquet in several parts, read back as one relation."""
    configure(spark)
    path = scratch_path(spark, "staged")
    rows = systems(spark, sf_dir).selectExpr(
        "*",
        "system_address AS seq",
        "timestamp_ntz'2024-01-01 00:00:00' AS imported_at",
        "'orders' AS source_tag",
    )
    write_staged(rows, path, compression="snappy", rows_per_file=5000)
    back = _maps_as_text(read_staged(spark, path))
    return back.select("seq", "name", *AXES, *COUNT_COLUMNS, *HISTOGRAM_COLUMNS, "source_tag")


# --- latest per key, load, upsert, run log ---


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return keep_latest(events, "user_id", [F.desc("event_id")]).select(
        "user_id", "event_id", "event_type", "value", "props"
    )


def load_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_counts(table(spark, sf_dir, "events"), "user_id")


def _accounts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).toDF("key", "name", "nation", "balance")


def patch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers patched by customers: equal keys are updated, negative balances to null."""
    base = _accounts(spark, sf_dir, "supplier")
    patch = _accounts(spark, sf_dir, "customer").withColumn(
        "balance", F.expr("CASE WHEN balance >= 0 THEN balance END")
    )
    return upsert(base, patch, "key")


def run_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr(
        "concat(event_type, '/', user_id) AS key", "props AS value", "ts"
    )
    return catalog.latest_values(log)


# --- reports ---


def _results(spark: SparkSession, sf_dir: str, limit: int = 40) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, REFERENCES, RADIUS)
    return planner.query_multiple_systems(
        catalogue, REFERENCES, RADIUS, limit=limit, points=points
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of whole texts, which hold every kind of character."""
    templates = merge_templates(TEMPLATES)
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        *[f"{link} AS {name}" for name, link in link_columns("text", templates).items()],
        f"{fill_template('{{{name_query}}}', 'text')} AS braced",
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_rows(_results(spark, sf_dir))


def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(_results(spark, sf_dir), path)
    return spark.read.option("lineSep", "\r\n").text(path)


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    results = _results(spark, sf_dir)
    write_json(results, path)
    back = spark.read.schema(results.drop("ref_ord", "rank").schema).json(path)
    return _maps_as_text(back)


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-width line for every system, at a distance made from its population."""
    rows = R.complete_results(
        systems(spark, sf_dir).selectExpr(
            "*",
            "1 AS ref_ord",
            "1 AS rank",
            f"'{HOME}' AS reference_system",
            f"{S.CLAIMABLE} AS claimable",
            "population / 100D AS distance_ly",
        )
    )
    return rows.selectExpr("name", f"{R.table_line()} AS line")


def pack_messages(spark: SparkSession, sf_dir: str, radius: float, limit: int) -> DataFrame:
    catalogue, points = _near(spark, sf_dir, REFERENCES, radius)
    return planner.report_messages(catalogue, REFERENCES, radius, limit=limit, points=points)


def _search(body_filter: str, claimable_only: bool = False, limit: int = 200) -> Query:
    return partial(
        radius_search, body_filter=body_filter, claimable_only=claimable_only, limit=limit
    )


QUERIES: dict[str, Query] = {
    "radius_topk": _search("any"),
    "radius_any": _search("any", limit=1000),
    "radius_ww": _search("ww"),
    "radius_elw": _search("elw"),
    "radius_ww_or_elw": _search("ww_or_elw"),
    "radius_ww_and_elw": _search("ww_and_elw"),
    "claimable_only": _search("any", claimable_only=True),
    "query_systems": query_systems,
    "query_systems_without_links": query_systems_without_links,
    "query_catalog": query_catalog,
    "reference_lookup": reference_lookup,
    "missing_references": missing_references,
    "multi_ref_topk": multi_ref_topk,
    "multi_ref_union": multi_ref_union,
    "multi_ref_grid": multi_ref_grid,
    "radius_crowded": radius_crowded,
    "nearest_crowded": nearest_crowded,
    "vector_radius": vector_radius,
    "body_totals": star_body_totals,
    "type_hist": partial(star_histogram, label="type"),
    "subtype_hist": partial(star_histogram, label="subtype"),
    "ring_hist": partial(star_histogram, label="ring"),
    "canonical_json": canonical_json,
    "derived_counts": derived_counts,
    "alias_sum": alias_sum,
    "record_fields": record_fields,
    "record_rollup": record_rollup,
    "dump_scan": dump_scan,
    "dump_scan_any_layout": partial(dump_scan, layout="any"),
    "dump_scan_gzip": partial(dump_scan, compression="gzip"),
    "dump_first_records": dump_first_records,
    "import_full": import_full,
    "import_patch": import_patch,
    "import_statistics": import_statistics,
    "run_log_sources": run_log_sources,
    "typed_tables": typed_tables,
    "table_statistics": table_statistics,
    "staged_roundtrip": staged_roundtrip,
    "keep_latest": latest_event,
    "load_counts": load_count,
    "patch_upsert": patch_upsert,
    "run_log_latest": run_log_latest,
    "links": links,
    "report_rows": report_rows,
    "csv_report": csv_report,
    "json_report": json_report,
    "table_lines": table_lines,
    "pack_messages": partial(pack_messages, radius=RADIUS, limit=40),
    "pack_messages_long": partial(pack_messages, radius=100.0, limit=1_000_000),
    "empty_message": partial(pack_messages, radius=0.05, limit=200),
}
