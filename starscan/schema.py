"""The fixed schemas: staged rows, the systems table, the run log and search results."""

from __future__ import annotations

from pyspark.sql import types as T

COUNT_COLUMNS = [
    "total_bodies",
    "total_planets",
    "total_stars",
    "ringed_body_count",
    "water_world_count",
    "earthlike_world_count",
]

HISTOGRAM_COLUMNS = ["body_type_counts", "body_subtype_counts", "ring_type_counts"]

_HISTOGRAM = T.MapType(T.StringType(), T.IntegerType(), False)

SYSTEMS = T.StructType(
    [
        T.StructField("system_key", T.StringType()),
        T.StructField("system_address", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("population", T.LongType()),
        T.StructField("controlling_faction", T.StringType()),
        T.StructField("faction_count", T.IntegerType()),
        *[T.StructField(name, T.IntegerType()) for name in COUNT_COLUMNS],
        *[T.StructField(name, _HISTOGRAM) for name in HISTOGRAM_COLUMNS],
        T.StructField("imported_at", T.TimestampNTZType()),
        T.StructField("source_tag", T.StringType()),
    ]
)

SYSTEM_COLUMNS = SYSTEMS.fieldNames()

# The systems table on disk is partitioned by a bucket of the key.
STORED = T.StructType([*SYSTEMS.fields, T.StructField("bucket", T.IntegerType())])

# Staged Parquet keeps the arrival number and carries histograms as JSON text.
STAGED = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [
        T.StructField(f"{f.name}_json", T.StringType()) if f.name in HISTOGRAM_COLUMNS else f
        for f in SYSTEMS.fields
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

RUN_SOURCES = T.StructType(
    [
        T.StructField("load", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("records", T.LongType()),
    ]
)

NAMES = T.StructType(
    [
        T.StructField("name_lower", T.StringType()),
        T.StructField("system_key", T.StringType()),
        *[T.StructField(axis, T.DoubleType()) for axis in ("x", "y", "z")],
    ]
)

SCHEMA_VERSION = "4"

RESULT_COLUMNS = [
    "reference_system",
    "name",
    "distance_ly",
    *COUNT_COLUMNS,
    "population",
    "faction_count",
    "controlling_faction",
    *HISTOGRAM_COLUMNS,
    "claimable",
    "claimable_rule",
    "edsm_url",
    "inara_url",
    "edgis_url",
    "hmcw_count",
    "icy_world_count",
    "rocky_icy_world_count",
    "gas_giant_count",
]
