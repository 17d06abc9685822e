"""JSON-array dumps: one huge top-level array of objects, plain or compressed.

Spark picks the codec by extension (.gz, .zst, .zstd) and cuts plain files into splits of
``spark.sql.files.maxPartitionBytes``, so a plain dump is parsed by as many tasks as it has
splits. A compressed file cannot be cut: one task unpacks it and its lines are then spread over
the cluster for parsing. Ship big dumps as several files to unpack them in parallel, too.

A dump whose objects spread over lines is read by Spark's multi-line JSON reader: one task per file,
which holds the rows of that file. Such dumps must come in files that fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from starscan.session import scratch_path
from starscan.sources import files

# The only fields anything downstream reads. Parsing to these skips the rest of a record
# (stations, signals, ...) in the JSON tokenizer; VARIANT keeps their loose types.
RECORD_FIELDS = [
    "name",
    "system_name",
    "id64",
    "systemAddress",
    "system_address",
    "coords",
    "x",
    "y",
    "z",
    "population",
    "controllingFaction",
    "controllingFactionName",
    "factions",
    "bodies",
]
RECORD_TYPE = "struct<" + ",".join(f"{name}:variant" for name in RECORD_FIELDS) + ">"

_BLANK = r" \t\r\n\uFEFF"


COMPRESSED = (".gz", ".zst", ".zstd")

LINEAGE = ["_metadata.file_path AS source_file", "_metadata.file_name AS source_tag"]

ROW_IN_TASK = "(monotonically_increasing_id() & ((1L << 33) - 1))"

# Split offset plus row number inside the reading task. A split that starts a task yields fewer
# rows than it has bytes, so its numbers stay below the next split's offset. Only a file's last
# split may share a task with others, and nothing follows it. The check holds Spark's packing of
# splits to that.
ARRIVAL_NUMBER = """CASE
  WHEN row_in_task < block_length OR block_start + block_length >= file_size
    THEN block_start + row_in_task + 1
  ELSE CAST(raise_error('split layout gives no arrival order') AS bigint) END"""


def parse_records(line: str) -> str:
    """SQL expression: array<struct of RECORD_FIELDS> of the objects on one line, [] for a
    bracket-only line. Malformed JSON, or an element that is not an object, raises.
    """
    # trimming a set of characters is dear: nearly all lines need none, or lose a comma
    body = f"""concat('[', CASE
      WHEN startswith({line}, '{{') AND endswith({line}, '}}') THEN {line}
      WHEN startswith({line}, '{{') AND endswith({line}, '}},') THEN left({line}, length({line}) - 1)
      ELSE btrim({line}, '{_BLANK},[]') END, ']')"""
    return f"from_json({body}, 'array<{RECORD_TYPE}>', map('mode', 'FAILFAST'))"


def is_malformed(error: Exception) -> bool:
    """Whether a job has stopped at JSON that does not parse in the layout it was read in."""
    return "MALFORMED_RECORD_IN_PARSING" in str(error)


def scan_dump(spark: SparkSession, *paths: str, layout: str = "lines") -> DataFrame:
    """Every object of the dumps plus the text that opens and closes an array.

    One row per object (``record``), or per bracket without one (``record`` is null). ``opens``
    and ``closes`` tell whether the row's text starts with ``[`` or ends with ``]``.

    With layout ``lines`` each line must hold whole objects, any number of them; an object
    spread over lines stops the job. Layout ``any`` takes every valid JSON array and reads each
    file in one task; what follows the array in a file is not read.

    ``seq`` is the arrival number: it grows strictly in file order but is not dense, which is
    all that "the later record wins" needs, and costs no second pass over the dump.
    """
    if layout == "any":
        return _array_elements(spark, list(paths))
    if layout != "lines":
        raise ValueError("layout must be 'lines' or 'any'")
    found = [name for path in paths for name in files.inputs(spark, path)]
    packed = [name for name in found if name.lower().endswith(COMPRESSED)]
    if not packed:
        return _plain_lines(spark, list(paths))
    if len(packed) == len(found):
        return _packed_lines(spark, list(paths))
    plain = [name for name in found if not name.lower().endswith(COMPRESSED)]
    return _plain_lines(spark, plain).unionByName(_packed_lines(spark, packed))


def _array_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    fields = RECORD_TYPE.removeprefix("struct<").removesuffix(">").replace(":", " ")
    elements = spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    numbered = elements.selectExpr(
        f"struct({', '.join(RECORD_FIELDS)}) AS record",
        # a closing bracket that is missing would have stopped the reader
        "CAST(null AS boolean) AS opens",
        "true AS closes",
        f"{ROW_IN_TASK} + 1 AS seq",
        *LINEAGE,
    )
    # the reader would take a lone object for an array of one
    heads = spark.read.option("lineSep", "[").text(paths)
    brackets = (
        heads.selectExpr("value", *LINEAGE, "_metadata.file_block_start AS at", f"{ROW_IN_TASK} AS row_in_task")
        .where("at = 0")
        .groupBy("source_file", "source_tag")
        .agg(F.min_by("value", "row_in_task").alias("head"))
        .selectExpr(
            "CAST(null AS " + RECORD_TYPE + ") AS record",
            f"btrim(head, '{_BLANK}') = '' AS opens",
            "true AS closes",
            "0L AS seq",
            "source_file",
            "source_tag",
        )
    )
    return numbered.unionByName(brackets).selectExpr("*", "seq >> 16 AS block_start")


def _parsed(texts: DataFrame) -> DataFrame:
    return texts.selectExpr(
        f"posexplode_outer({parse_records('text')}) AS (position, record)",
        f"NOT startswith(text, '{{') AND startswith(ltrim('{_BLANK}', text), '[') AS opens",
        f"NOT endswith(text, ',') AND NOT endswith(text, '}}') AND endswith(rtrim('{_BLANK}', text), ']') AS closes",
        *[name for name in texts.columns if name != "text"],
    )


def _scanned(parsed: DataFrame) -> DataFrame:
    return parsed.where("record IS NOT NULL OR opens OR closes").select(
        "record", "opens", "closes", "seq", "source_file", "source_tag", "block_start"
    )


def _plain_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).selectExpr(
        "value AS text",
        *LINEAGE,
        "_metadata.file_block_start AS block_start",
        "_metadata.file_size AS file_size",
        "_metadata.file_block_length AS block_length",
    )
    numbered = _parsed(lines).selectExpr("*", f"{ROW_IN_TASK} AS row_in_task")
    return _scanned(numbered.selectExpr("*", f"{ARRIVAL_NUMBER} AS seq"))


def _packed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).selectExpr(
        "value AS text", *LINEAGE, f"{ROW_IN_TASK} AS row_in_task"
    )
    parsed = _parsed(lines.repartition("source_file", "row_in_task"))
    return _scanned(
        parsed.selectExpr(
            "*",
            # 33 bits for the line and 30 for the object on it: a line holds less than 2^31 bytes
            "(row_in_task << 30) + coalesce(position, 0) + 1 AS seq",
            # no splits here, so blocks of a fixed number of lines
            "row_in_task >> 16 AS block_start",
        )
    )


def read_dump(spark: SparkSession, *paths: str, layout: str = "lines") -> DataFrame:
    """Every element of the top-level arrays."""
    scanned = scan_dump(spark, *paths, layout=layout)
    return scanned.where("record IS NOT NULL").drop("opens", "closes")


def source_counts(scanned: DataFrame) -> DataFrame:
    """(source_file, opens, closes, objects): how each file begins and ends and what it holds.

    Reads only lineage columns; run it on the staged copy of ``scan_dump``, not on the dump.
    """
    return scanned.groupBy("source_file").agg(
        F.min_by("opens", "seq").alias("opens"),
        F.max_by("closes", "seq").alias("closes"),
        F.count_if("is_record").alias("objects"),
    )


def assert_whole_arrays(scanned: DataFrame) -> None:
    """Each file must open with ``[``, close with ``]`` and hold at least one object.

    ``scanned`` has a row per file: ``source_counts``.
    """
    bad = scanned.where("not opens or not closes or objects = 0")
    first = bad.orderBy("source_file").limit(5).collect()
    if first:
        names = ", ".join(row["source_file"] for row in first)
        raise ValueError(f"{bad.count()} not a top-level JSON array of objects: {names}")


def read_first(spark: SparkSession, *paths: str, n: int, layout: str = "lines") -> DataFrame:
    """The first ``n`` records of the dumps in arrival order.

    Files are taken in order and counted, in growing groups, until they hold ``n`` records; files
    behind that are not read.
    """
    waiting = sorted({name for path in paths for name in files.inputs(spark, path)})
    taken: list[str] = []
    found, size = 0, 1
    while waiting and found < n:
        group, waiting, size = waiting[:size], waiting[size:], 2 * size
        found += read_dump(spark, *group, layout=layout).count()
        taken += group
    if not taken:
        return read_dump(spark, *paths, layout=layout).limit(0)
    return first_records(read_dump(spark, *taken, layout=layout), n)


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records in arrival order over all files, nameless ones included.

    Records are counted per block first; whole blocks before the cut pass a plain filter and
    only the block holding the cut is numbered, so no task sorts more than one block.
    """
    if n <= 0:
        return records.limit(0)
    spark = records.sparkSession
    counted = scratch_path(spark, "blocks")
    # Written out so that every use sees the same blocks: a filter on the file would reach the
    # scan, and a scan of fewer files may be split differently.
    records.groupBy("source_file", "block_start").agg(F.count(F.lit(1)).alias("n")).write.parquet(
        counted
    )
    counts = spark.read.parquet(counted)
    file = _holding(counts.groupBy("source_file").agg(F.sum("n").alias("n")), "source_file", n)
    if file is None:
        return records
    blocks = counts.where(F.col("source_file") == file["source_file"])
    block = _holding(blocks, "block_start", n - file["before"])
    left_over = n - file["before"] - block["before"]

    same_file = F.col("source_file") == file["source_file"]
    earlier = (F.col("source_file") < file["source_file"]) | (
        same_file & (F.col("block_start") < block["block_start"])
    )
    in_cut = same_file & (F.col("block_start") == block["block_start"])
    by_arrival = Window.partitionBy("source_file", "block_start").orderBy("seq")
    # asking for seq keeps its numbering in the plan, and that keeps the filter above the scan
    numbered = records.where("seq > 0")
    cut = (
        numbered.where(in_cut)
        .withColumn("position", F.row_number().over(by_arrival))
        .where(F.col("position") <= left_over)
        .drop("position")
    )
    return numbered.where(earlier).unionByName(cut)


def _holding(counts: DataFrame, order: str, n: int) -> Row | None:
    """The row (a file or a split) in which the running count reaches ``n``."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("through", F.sum("n").over(running))
        .withColumn("before", F.col("through") - F.col("n"))
        .where(F.col("through") >= n)
        .orderBy(order)
        .first()
    )
