"""Dump to staged rows: scan, normalise, roll up, write."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starscan.operators.normalise import normalise
from starscan.operators.rollup import roll_up_nested
from starscan.schema import SYSTEM_COLUMNS, SYSTEMS
from starscan.session import configure, scratch_path
from starscan.sources import files
from starscan.sources.dump import (
    assert_whole_arrays,
    is_malformed,
    read_first,
    scan_dump,
    source_counts,
)
from starscan.sources.parquet import check_codec, write_staged


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def system_rows(records: DataFrame, imported_at: datetime) -> DataFrame:
    """All columns of the systems table next to the input's own; nameless rows stay, with a
    null name. One map-side pass: no shuffle."""
    typed = roll_up_nested(normalise(records), "record.bodies").selectExpr(
        "*", f"timestamp_ntz'{imported_at.isoformat(sep=' ')}' AS imported_at"
    )
    return typed.selectExpr(
        *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SYSTEMS.fields],
        *[c for c in records.columns if c not in ("record", *SYSTEM_COLUMNS)],
    )


class Staged(NamedTuple):
    """Staged rows, the records of each source (source_file, objects), records and named records."""

    rows: DataFrame
    sources: DataFrame
    seen: int
    named: int


def stage(spark: SparkSession, staging: str, *dumps: str, layout: str = "auto") -> Staged:
    """Parses the dumps once into ``staging``.

    Later steps (latest per key, load) read the flat copy, so neither a lost shuffle file nor a
    second action parses JSON again; the records are counted while it is written. Besides named
    systems the copy holds nameless records and bracket lines, for the array check. Layout
    ``auto`` reads lines, and starts again with ``any`` if a line anywhere holds no whole objects.
    """
    configure(spark)
    if layout == "auto":
        try:
            return stage(spark, staging, *dumps, layout="lines")
        except Exception as error:
            if not is_malformed(error):
                raise
            files.delete(spark, staging)
            return stage(spark, staging, *dumps, layout="any")
    scanned = scan_dump(spark, *dumps, layout=layout)
    rows = system_rows(scanned.withColumn("is_record", F.col("record").isNotNull()), utc_now())
    try:
        counts = _write_counted(rows, staging)
    except Exception as error:
        if layout == "any" and is_malformed(error):
            raise ValueError(f"Malformed JSON, not a top-level JSON array of objects: {', '.join(dumps)}") from error
        raise
    staged = spark.read.schema(rows.schema).parquet(staging)
    listed = scratch_path(spark, "sources")
    source_counts(staged).write.parquet(listed)
    sources = spark.read.parquet(listed)
    assert_whole_arrays(sources)
    return Staged(staged, sources.select("source_file", "objects"), **counts)


def _write_counted(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes rows and counts, in the same pass, the records and those with a name."""
    counted = Observation()
    rows.observe(
        counted, F.count_if("is_record").alias("seen"), F.count("name").alias("named")
    ).write.option("compression", "zstd").parquet(path)
    return {name: counted.get[name] for name in ("seen", "named")}


def convert_dump(
    spark: SparkSession,
    dump: str,
    parquet_path: str,
    *,
    compression: str = "zstd",
    rows_per_file: int = 1_000_000,
    row_group_bytes: int = 128 * 1024 * 1024,
    max_systems: int | None = None,
    layout: str = "auto",
) -> dict[str, int]:
    """Dump to Parquet parts in the staged layout; returns records seen and rows written."""
    configure(spark)
    check_codec(spark, compression)
    scratch = scratch_path(spark, "convert")
    if max_systems is None:
        staged = stage(spark, scratch, dump, layout=layout)
    else:
        staged = _stage_first(spark, scratch, dump, max_systems, layout)
    write_staged(
        staged.rows.where("name is not null"),
        parquet_path,
        compression=compression,
        rows_per_file=rows_per_file,
        row_group_bytes=row_group_bytes,
    )
    files.delete(spark, scratch)
    return {"systems_seen": staged.seen, "systems_written": staged.named}


def _stage_first(spark: SparkSession, staging: str, dump: str, n: int, layout: str) -> Staged:
    if layout == "auto":
        try:
            return _stage_first(spark, staging, dump, n, "lines")
        except Exception as error:
            if not is_malformed(error):
                raise
            files.delete(spark, staging)
            return _stage_first(spark, staging, dump, n, "any")
    chosen = read_first(spark, dump, n=n, layout=layout)
    rows = system_rows(chosen.withColumn("is_record", F.lit(True)), utc_now())
    counts = _write_counted(rows, staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    sources = staged.groupBy("source_file").agg(F.count("*").alias("objects"))
    return Staged(staged, sources, **counts)
