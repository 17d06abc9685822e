"""Session settings this package depends on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

# Runtime settings that results or plans depend on. Everything else (executors, memory, shuffle
# width) is the cluster's business.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a JSON object: the last value wins
    "spark.sql.variant.allowDuplicateKeys": "true",
    # prune to the best k per group before the shuffle for every limit a search may ask for
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # HotSpot never compiles larger methods; without whole-stage code the wide projections of
    # the ingest run compiled in pieces instead of interpreted in one
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(MIN_PARTITIONS, None) is None:
        # arrival numbers need the same splits each time a dump is scanned, so their layout
        # must not follow executors that come and go
        spark.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    return spark


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Runtime settings for a while; what was set before, or nothing, is set again."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def local_session(cores: int | str = "*", app: str = "starscan", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    width = "8" if cores == "*" else str(cores)
    settings = {
        "spark.sql.shuffle.partitions": width,
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # no Python call-site capture on every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a machine-local folder; on a cluster
    a missing setting is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="starscan-")
