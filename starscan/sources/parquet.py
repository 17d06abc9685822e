"""Staged Parquet: path resolution, scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starscan.functions.counts import canonical_json, parse_counts
from starscan.schema import HISTOGRAM_COLUMNS, STAGED
from starscan.sources import files

CODECS = ("zstd", "snappy", "gzip", "brotli", "none")
# Codecs that Spark does not bring itself.
NEEDS_CLASS = {"brotli": "org.apache.hadoop.io.compress.BrotliCodec"}


def resolve_inputs(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files a path stands for.

    A pattern is left to the reader. A folder holds them itself, not deeper. Any other name is a
    file or, if there is none, the common beginning of parts: ``a.parquet`` for ``a*.parquet``.
    """
    if set(path) & set("*?["):
        return [path]
    beginning = path.removesuffix("." + files.base_name(path).rpartition(".")[2])
    patterns = (
        [path.rstrip("/") + "/*.parquet"]
        if files.is_directory(spark, path)
        else [path, beginning + "*.parquet"]
    )
    matches = (files.glob(spark, pattern) for pattern in patterns)
    found = next(filter(None, matches), None)
    if found is None:
        raise FileNotFoundError(f"no Parquet files for {path}")
    return found if files.base_name(found[0]) != files.base_name(path) else [path]


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Staged rows, all parts as one relation, histograms as maps."""
    return parse_staged(spark.read.schema(STAGED).parquet(*resolve_inputs(spark, path)))


def parse_staged(staged: DataFrame) -> DataFrame:
    """Rows as they are in staged files with their histograms as maps."""
    return staged.selectExpr(
        *[f"{parse_counts(text)} AS {name}" if text else name for name, text in _staged_names()]
    )


def _staged_names() -> list[tuple[str, str | None]]:
    """(column, its JSON text column in staged files or None)."""
    names = [name.removesuffix("_json") for name in STAGED.fieldNames()]
    return [(name, f"{name}_json" if name in HISTOGRAM_COLUMNS else None) for name in names]


def check_codec(spark: SparkSession, compression: str) -> None:
    """Raises for a codec that is unknown, or that this installation of Spark lacks."""
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {', '.join(CODECS)}")
    needed = NEEDS_CLASS.get(compression)
    if needed:
        loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        if loader.getResource(needed.replace(".", "/") + ".class") is None:
            raise ValueError(f"compression {compression} needs {needed}, which Spark lacks here")


def write_staged(
    rows: DataFrame,
    path: str,
    *,
    compression: str = "zstd",
    rows_per_file: int = 1_000_000,
    row_group_bytes: int = 128 * 1024 * 1024,
    mode: str = "errorifexists",
) -> None:
    """Part files of at most ``rows_per_file`` rows in the fixed schema."""
    check_codec(rows.sparkSession, compression)
    (
        rows.selectExpr(
            *[
                f"CAST({canonical_json(name) if text else name} AS {field.dataType.simpleString()})"
                f" AS {text or name}"
                for (name, text), field in zip(_staged_names(), STAGED.fields)
            ]
        )
        .write.mode(mode)
        .option("compression", compression)
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )
