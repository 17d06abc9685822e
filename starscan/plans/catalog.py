"""The systems table under a root folder: full loads, patches, run log, typed tables.

``<root>/systems/version=<n>`` holds the systems of full load ``n`` as Parquet, partitioned by a bucket
of the key, ``<root>/names/version=<n>`` a narrow copy by the same buckets, sorted by name. A full load
writes a new version; the run log then names it current, so readers see the old table or the new one.
A patch overwrites the partitions that hold its keys, by Spark's dynamic partition overwrite, and
touches no other. It changes the version it patches: a patch that dies is applied again, which gives
the same rows. Loads of one catalogue run one after the other.
``<root>/run_log`` and ``<root>/run_sources`` are append-only.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.functions.geometry import AXES, cell
from starscan.functions.text import literal
from starscan.operators import search
from starscan.operators.latest import MAX_BROADCAST_KEYS, keep_latest, upsert
from starscan.plans.ingest import stage, utc_now
from starscan.schema import (
    NAMES,
    RUN_LOG,
    RUN_SOURCES,
    SCHEMA_VERSION,
    STAGED,
    STORED,
    SYSTEM_COLUMNS,
    SYSTEMS,
)
from starscan.session import configure, scratch_path, settings
from starscan.sources import files, log
from starscan.sources.parquet import parse_staged, resolve_inputs

MODES = ("full", "patch")
# Edge of the coarse cells that order the rows of a file.
LAYOUT_EDGE = 256.0
# Rows of a bucket, which a patch rewrites as a whole, and the number of buckets.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16
# A file is skipped by parts of this size when a search box or a name lies elsewhere.
ROW_GROUP_BYTES = 32 << 20


class LoadResult(NamedTuple):
    """Records read, systems written, Parquet files, and bytes of the source, in some seconds."""

    seen: int
    written: int
    parts: int
    size: int
    seconds: float


def init_catalog(spark: SparkSession, root: str) -> None:
    """Marks a root folder as a catalog of the current schema version."""
    configure(spark)
    set_meta(spark, root, schema_version=SCHEMA_VERSION)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return log.read(spark, f"{root}/run_log", RUN_LOG)


def latest_values(entries: DataFrame) -> DataFrame:
    """(key, value): the newest entry of each key."""
    newest = [F.desc("ts"), F.desc("value")]
    return keep_latest(entries, "key", newest).select("key", "value")


def set_meta(spark: SparkSession, root: str, **values: object) -> None:
    entries = pa.table(
        {
            "key": list(values),
            "value": [str(value) for value in values.values()],
            "ts": pa.array([utc_now()] * len(values), pa.timestamp("us")),
        }
    )
    log.append(spark, f"{root}/run_log", spark.createDataFrame(entries, RUN_LOG))


def get_meta(spark: SparkSession, root: str, key: str, default: str = "") -> str:
    row = latest_values(read_log(spark, root).where(F.col("key") == key)).first()
    return row["value"] if row else default


def current(spark: SparkSession, root: str) -> tuple[int, int]:
    """The current version and its number of buckets; (0, 0) before the first load."""
    return _state(spark, root)[:2]


def _state(spark: SparkSession, root: str) -> tuple[int, int, int]:
    """The current version, its number of buckets, and how many loads there have been."""
    keys = ["current_version", "buckets", "loads"]
    wanted = read_log(spark, root).where(F.col("key").isin(keys))
    found = {row["key"]: int(row["value"]) for row in latest_values(wanted).collect()}
    return tuple(found.get(key, 0) for key in keys)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions whose files are there, in ascending order."""
    return sorted(int(path.rpartition("=")[2]) for path in files.glob(spark, f"{root}/systems/version=*"))


def systems(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version of the systems table, or an earlier one that is still there."""
    configure(spark)
    return _stored(spark, root, version or current(spark, root)[0]).select(*SYSTEM_COLUMNS)


def _stored(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The rows of a version with their ``bucket``."""
    if not version:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(f"{root}/systems/version={version}")


def names(spark: SparkSession, root: str) -> DataFrame:
    """(name_lower, system_key, x, y, z) of the current version.

    Within a bucket sorted by ``name_lower`` and with a Bloom filter on it, so that a look-up reads
    few row groups, and none for a name that no bucket holds.
    """
    version, _ = current(spark, root)
    if not version:
        return spark.createDataFrame([], NAMES)
    found = spark.read.schema(NAMES).parquet(f"{root}/names/version={version}")
    return found.select(*NAMES.fieldNames())


def reference_points(spark: SparkSession, root: str, references: Sequence[str]) -> list[tuple]:
    """Places of references, looked up in the names of the current version."""
    return search.reference_points(names(spark, root), references)


def _bucket(buckets: int) -> str:
    return f"int(pmod(xxhash64(system_key), {buckets})) AS bucket"


def write_systems(rows: DataFrame, path: str) -> None:
    """Overwrites the buckets that occur in ``rows``, and no others.

    A bucket's rows are ordered by coarse cell, so that Parquet min/max statistics skip row groups
    outside a search box. x and the key come last to let a crowded cell be split.
    """
    cells = ["_cx", "_cy", "_cz"]
    placed = rows.selectExpr(
        "*", *[f"{place} AS {name}" for name, place in zip(cells, cell(AXES, LAYOUT_EDGE))]
    )
    order = ["bucket", *cells, "x", "system_key"]
    # whole buckets to a task, or parts of a large one
    dealt = placed.hint("rebalance", "bucket").sortWithinPartitions(*order)
    _write_buckets(dealt.drop(*cells), path, {})


def write_names(rows: DataFrame, path: str, bucket_rows: int) -> None:
    """The names of ``rows`` (with their ``bucket``), each bucket sorted by name."""
    order = ["bucket", "name_lower", "system_key"]
    named = rows.selectExpr("lower(name) AS name_lower", "system_key", *AXES, "bucket")
    bloom = {
        "parquet.bloom.filter.enabled#name_lower": "true",
        "parquet.bloom.filter.expected.ndv#name_lower": str(max(1000, min(bucket_rows, BUCKET_ROWS))),
        # names hardly repeat
        "parquet.enable.dictionary#name_lower": "false",
    }
    _write_buckets(named.hint("rebalance", "bucket").sortWithinPartitions(*order), path, bloom)


def _write_buckets(rows: DataFrame, path: str, options: dict[str, str]) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .options(**options)
        .partitionBy("bucket")
        .parquet(path)
    )


def import_source(
    spark: SparkSession,
    root: str,
    source: str,
    mode: str = "full",
    *,
    layout: str = "auto",
    database: str | None = None,
) -> LoadResult:
    """Parquet files or folders are loaded as staged rows, anything else is read as a dump.

    With a ``database`` the load is also published to its typed tables.
    """
    if source.lower().endswith(".parquet") or files.is_directory(spark, source):
        return import_parquet(spark, root, source, mode, database=database)
    return import_dump(spark, root, source, mode=mode, layout=layout, database=database)


def import_dump(
    spark: SparkSession,
    root: str,
    *dumps: str,
    mode: str = "full",
    layout: str = "auto",
    keep_staging: bool = False,
    database: str | None = None,
) -> LoadResult:
    """Of several records with a key the last one counts: later file (by path), later position."""
    started = time.monotonic()
    mode = _checked(mode)
    configure(spark)
    staging = scratch_path(spark, "staging")
    try:
        staged = stage(spark, staging, *dumps, layout=layout)
        named = staged.rows.where("name IS NOT NULL")
        latest = keep_latest(named, "system_key", [F.desc("source_file"), F.desc("seq")])
        paths = [path for dump in dumps for path in files.inputs(spark, dump)]
        sources = staged.sources.selectExpr("source_file AS source", "objects AS records")
        written, entries = _load(spark, root, latest, mode, sources, staged.named)
        result = LoadResult(
            seen=staged.seen,
            written=written,
            parts=len(files.glob(spark, f"{staging}/*.parquet")),
            size=files.total_size(spark, paths),
            seconds=time.monotonic() - started,
        )
    finally:
        if not keep_staging:
            files.delete(spark, staging)
    return _log_result(spark, root, result, entries, paths, database)


def import_parquet(
    spark: SparkSession, root: str, path: str, mode: str = "full", *, database: str | None = None
) -> LoadResult:
    """Of several rows with a key the one with the highest ``seq`` counts."""
    started = time.monotonic()
    mode = _checked(mode)
    configure(spark)
    inputs = resolve_inputs(spark, path)
    staged = spark.read.schema(STAGED).parquet(*inputs)
    newest = [F.desc("seq"), F.desc("source_tag"), F.desc("imported_at")]
    # the JSON text of the histograms is parsed for the rows that stay only
    latest = parse_staged(keep_latest(staged, "system_key", newest))
    parts = [part for pattern in inputs for part in files.glob(spark, pattern)]
    # counted from the footers, written as a row per file
    counted = scratch_path(spark, "sources")
    per_file = staged.groupBy("_metadata.file_path")
    per_file.agg(F.count("*").alias("records")).toDF("source", "records").write.parquet(counted)
    sources = spark.read.parquet(counted)
    seen = sources.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    written, entries = _load(spark, root, latest, mode, sources, seen)
    result = LoadResult(
        seen=seen,
        written=written,
        parts=len(parts),
        size=files.total_size(spark, parts),
        seconds=time.monotonic() - started,
    )
    return _log_result(spark, root, result, entries, parts, database)


def _checked(mode: str) -> str:
    cleaned = mode.lower().strip()
    if cleaned not in MODES:
        raise ValueError(f"mode must be one of: {', '.join(MODES)}")
    return cleaned


def _load(
    spark: SparkSession, root: str, latest: DataFrame, mode: str, sources: DataFrame, rows: int
) -> tuple[int, dict[str, object]]:
    """Makes the rows ``latest``, at most ``rows``, a new version or part of the current one.

    ``sources`` (source, records) is logged. Returns how many rows there are, and the entries of the
    run log that make the load count.
    """
    version, buckets, loads = _state(spark, root)
    loaded = latest.select(*SYSTEM_COLUMNS)
    staging = scratch_path(spark, "patch")
    patch = mode == "patch" and version > 0
    if patch:
        loaded.selectExpr("*", _bucket(buckets)).write.parquet(staging)
        loaded = spark.read.schema(STORED).parquet(staging)
        # at most one row for each bucket
        counts = {row["bucket"]: row["count"] for row in loaded.groupBy("bucket").count().collect()}
        written = sum(counts.values())
        touched = F.col("bucket").isin(sorted(counts)) if len(counts) < buckets else F.lit(True)
        replaced = _stored(spark, root, version).where(touched)
        loaded = upsert(replaced, loaded, "system_key", patch_rows=written)
    else:
        version = max([version, *versions(spark, root)]) + 1
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))
        loaded, touched = loaded.selectExpr("*", _bucket(buckets)), F.lit(True)
    write_systems(loaded, f"{root}/systems/version={version}")
    fresh = _stored(spark, root, version)
    write_names(fresh.where(touched), f"{root}/names/version={version}", rows // buckets)
    if patch:
        files.delete(spark, staging)
    else:  # the new files hold just these rows: their footers know the number
        written = fresh.count()
    listed = sources.selectExpr(f"{loads + 1}L AS load", "source", "records")
    log.append(spark, f"{root}/run_sources", listed.select(*RUN_SOURCES.fieldNames()))
    return written, {
        "schema_version": SCHEMA_VERSION,
        "current_version": version,
        "buckets": buckets,
        "loads": loads + 1,
        "last_import_mode": mode,
        "last_import_finished_utc": utc_now().isoformat(timespec="seconds"),
    }


def run_sources(spark: SparkSession, root: str) -> DataFrame:
    """(load, source, records): every file that a load has read, and how many records it held."""
    return log.read(spark, f"{root}/run_sources", RUN_SOURCES)


def remove_old_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the newest versions, the current one being the last; returns how many.

    Readers of a removed version fail, so keep as many as have long-running readers.
    """
    if keep < 1:
        raise ValueError("at least the current version is kept")
    last, _ = current(spark, root)
    gone = [version for version in versions(spark, root) if version <= last][:-keep]
    for version in gone:
        for table in ("names", "systems"):
            files.delete(spark, f"{root}/{table}/version={version}")
    return len(gone)


def _log_result(
    spark: SparkSession,
    root: str,
    result: LoadResult,
    entries: dict[str, object],
    sources: Sequence[str],
    database: str | None,
) -> LoadResult:
    per_second = lambda n: round(n / result.seconds, 2) if result.seconds else 0.0
    set_meta(
        spark,
        root,
        **entries,
        last_import_source=", ".join(files.base_name(path) for path in sources),
        last_import_systems_seen=result.seen,
        last_import_systems_written=result.written,
        last_import_parquet_file_count=result.parts,
        last_import_dump_size_bytes=result.size,
        last_import_elapsed_s=result.seconds,
        last_import_systems_per_sec=per_second(result.seen),
        last_import_bytes_per_sec=per_second(result.size),
    )
    if database:
        publish(spark, root, database)
    return result


def _columns() -> str:
    return ", ".join(
        f"{f.name} {f.dataType.simpleString()}"
        + (" DEFAULT 0" if f.dataType.simpleString() == "int" else "")
        for f in SYSTEMS.fields
    )


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The two typed tables in the session catalog, if missing; counts default to 0."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.systems ({_columns()}) USING parquet")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.app_meta (key string, value string) USING parquet"
    )


def publish(spark: SparkSession, root: str, database: str) -> None:
    """Points the typed table at the current version, fills the run log's, and computes statistics.

    ``systems`` is an external table over the version's own files, with the column ``bucket`` at the
    end: nothing is copied. A patch changes it in place; only its partitions are looked up again.
    """
    create_tables(spark, database)
    version, _ = current(spark, root)
    table = f"{database}.systems"
    if version:
        path = f"{root}/systems/version={version}"
        shown = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
        if dict((row["key"], row["value"]) for row in shown).get("starscan.version") != path:
            # an external table leaves its files; another one is of create_tables and is filled here
            spark.sql(f"DROP TABLE {table}")
            spark.sql(
                f"CREATE TABLE {table} ({_columns()}, bucket int) USING parquet PARTITIONED BY (bucket) "
                f"LOCATION {literal(path)} TBLPROPERTIES ('starscan.version' = {literal(path)})"
            )
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        spark.catalog.refreshTable(table)
    latest_values(read_log(spark, root)).write.mode("overwrite").insertInto(f"{database}.app_meta")
    analyze_table(spark, table)
    analyze_table(spark, f"{database}.app_meta")


def analyze_table(spark: SparkSession, table: str) -> None:
    """Row count and size, and for every column type that has them statistics of the column:
    range, nulls, distinct values and, for numbers, a histogram of equal heights."""
    described = spark.table(table).schema.fields
    partition = {c.name for c in spark.catalog.listColumns(table) if c.isPartition}
    plain = [
        f.name
        for f in described
        if f.dataType.typeName() not in ("map", "array", "struct") and f.name not in partition
    ]
    with settings(spark, {"spark.sql.statistics.histogram.enabled": "true"}):
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(plain)}")


def column_statistics(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    """What the session catalog knows of a column: min, max, num_nulls, distinct_count, histogram, ..."""
    rows = spark.sql(f"DESCRIBE EXTENDED {table} {column}").collect()
    return {row["info_name"]: row["info_value"] for row in rows}


def cost_based(spark: SparkSession):
    """A context in which Spark plans joins by the statistics of analyzed tables, not by file sizes."""
    return settings(
        spark, {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"}
    )
