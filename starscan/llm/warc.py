"""WARC archives: written by Spark's text sink, read by boundary-chain verification.

Writing: a record is one string of bytes (``cast(binary as string)`` copies bytes unchanged) and
the record end, CRLF CRLF, is the sink's line separator. Reading: the version line ``WARC/1.1`` is the
separator of a splittable text scan, so that each piece after a separator is a *candidate* record.
Every task parses its pieces and emits candidate -> successor offsets; pointer jumping from the
start of each file keeps the candidates that are reached. A version line inside a payload is never
the successor of a real record, so it falls away, however genuine it looks.

Defined results. Null payload: empty. Null url: no target line. Line breaks in a url are written
percent-encoded. Null id: a record without the id; it is read back as null and is never a
keeper. Repeated rows: a record each; rows that repeat the keeper's id are all responses. Empty
table: an empty archive. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.llm.common import lookup, stage
from starscan.session import configure

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never written as revisits.
MIN_REVISIT_BYTES = 1000
#: Repeated payloads, or pieces of torn records, up to this many are joined by broadcast (about 60 bytes each).
MAX_BROADCAST_KEEPERS = 200_000
RECORDS_PER_FILE = 100_000

CANDIDATE = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("pos", pa.int64()),
        ("piece_bytes", pa.int64()),
        ("record_bytes", pa.int64()),
        ("kind", pa.string()),
        ("id", pa.int64()),
        ("refers_to", pa.int64()),
        ("digest", pa.string()),
        ("skip", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("found_digest", pa.string()),
    ]
)
CANDIDATE_DDL = (
    "file string, block long, pos long, piece_bytes long, record_bytes long, kind string, id long,"
    " refers_to long, digest string, skip long, payload_bytes long, found_digest string"
)


def with_revisits(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds ``digest``, ``kind`` and ``refers_to`` to rows (id, url, payload binary).

    Only the digests of long payloads are shuffled. The digests that occur more than once are joined
    back by broadcast if they are few, else in a shuffle that spreads hot digests.
    """
    digested = pages.withColumn("digest", F.sha1("payload"))
    is_long = F.octet_length("payload") >= MIN_REVISIT_BYTES
    keepers = stage(
        spark,
        digested.where(is_long)
        .groupBy("digest")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1"),
        "keepers",
    )
    if keepers.count() <= MAX_BROADCAST_KEEPERS:
        joined = digested.join(F.broadcast(keepers.drop("n")), "digest", "left")
    else:
        joined = lookup(stage(spark, digested, "digested"), keepers, "digest", "n")
    revisit = is_long & F.coalesce(F.col("keeper") != F.col("id"), F.col("keeper").isNotNull())
    return joined.select(
        "id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def write_archive(records: DataFrame, path: str) -> None:
    """Writes rows (id, url, payload, digest, kind, refers_to), one record each, as WARC files."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    size = F.octet_length("payload")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("kind")),
        optional("WARC-Record-ID", page("id")),
        optional("WARC-Target-URI", url),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            F.col("kind") == "revisit",
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", page("refers_to"))),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(END),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), body)
    (
        records.select(record.cast("string").alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _page(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    sign = -1 if inner.startswith("-") else 1
    number = _number(inner.removeprefix("-"))
    return None if number is None else sign * number


def _headers(block: bytes) -> dict[str, str]:
    """Field name in lower case -> value, of the lines of a header block."""
    found = {}
    for row in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = row.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def parse_candidate(piece: bytes) -> dict | None:
    """What the header behind a version line says, or None if it is no record header.

    ``record_bytes`` runs from the version line to the successor; ``skip`` is where the payload
    starts in the piece; ``found_digest`` is null if the piece ends before the payload does.
    """
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = _headers(piece[:end])
    length = _number(fields.get("content-length"))
    if length is None or "warc-type" not in fields:
        return None
    start = end + 4
    http_end = piece.find(b"\r\n\r\n", start, start + min(length, 1 << 16))
    http = _headers(piece[start:http_end]) if http_end >= 0 else {}
    skip = http_end + 4 if http_end >= 0 else start
    stop = start + length
    whole = stop + len(END) <= len(piece)
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_bytes": len(MAGIC) + stop + len(END),
        "kind": fields["warc-type"],
        "id": _page(fields.get("warc-record-id")),
        "refers_to": _page(fields.get("warc-refers-to")),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "skip": skip,
        "payload_bytes": _number(http.get("content-length")) if revisit else stop - skip,
        "found_digest": hashlib.sha1(piece[skip:stop]).hexdigest() if whole and not revisit else None,
    }


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, position in the block's own pieces, piece); a split's rows come in file order."""
    at, pos = None, 0
    for batch in batches:
        for file, block, piece in zip(*(batch.column(i) for i in range(3)), strict=True):
            if at != (file.as_py(), block.as_py()):
                at, pos = (file.as_py(), block.as_py()), 0
            data = piece.as_py()
            yield *at, pos, data
            pos += len(data) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for file, block, pos, piece in _in_order(batches):
        known = {"file": file, "block": block, "pos": pos, "piece_bytes": len(piece)}
        rows.append(known | (parse_candidate(piece) or {}))
        if len(rows) == 5000:
            yield pa.RecordBatch.from_pylist(rows, CANDIDATE)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, CANDIDATE)


def reachable(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(file, at) of the nodes (file, at, next) on the chain from each file's ``at`` = 0.

    Pointer jumping: in round k the reached nodes add what lies 2^k steps on, and every pointer is
    replaced by its target's pointer. Each round is a written table of narrow rows.
    """
    links = nodes.select("file", F.col("next").alias("at"), F.col("at").alias("before"))
    jump = stage(
        spark,
        links.join(nodes.select("file", "at"), ["file", "at"]).select(
            "file", F.col("before").alias("at"), F.col("at").alias("next")
        ),
        "jump",
    )
    reached = nodes.where("at = 0").select("file", "at")
    while not jump.isEmpty():
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = stage(spark, reached.unionByName(step), "reached")
        target = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = stage(
            spark,
            jump.join(target, ["file", "next"]).select("file", "at", F.col("after").alias("next")),
            "jump",
        )
    return reached


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Verified records of the WARC files below ``path``.

    Columns file, at (byte offset), id, kind, refers_to, digest (as declared), payload_bytes,
    found_digest (of the payload read; null for revisits). The files are scanned twice if payloads hold
    version lines, and ``configure`` keeps the splits of both scans alike.
    """
    configure(spark)
    staged = stage(spark, _pieces(spark, path).mapInArrow(_candidates, CANDIDATE_DDL), "candidates")
    # where a split's first piece lies in its file: all pieces and separators of the splits before
    spans = staged.groupBy("file", "block").agg(
        F.max(F.col("pos") + F.col("piece_bytes") + len(MAGIC)).alias("span")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("file", "block", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("base"))
    placed = stage(
        spark,
        staged.join(bases, ["file", "block"])
        .withColumn("at", F.col("base") + F.col("pos") - len(MAGIC))
        .where("at >= 0 and record_bytes is not null")
        .drop("base"),
        "placed",
    )
    nodes = placed.select("file", "at", (F.col("at") + F.col("record_bytes")).alias("next"))
    records = stage(spark, placed.join(reachable(spark, nodes), ["file", "at"], "left_semi"), "records")
    torn = records.where("kind <> 'revisit' and found_digest is null").select(
        "file", "at", "skip", "payload_bytes"
    )
    if not torn.isEmpty():
        owners = stage(spark, _owners(staged, bases, records, torn), "owners")
        records = records.join(
            _joined_payloads(spark, path, owners), ["file", "at"], "left"
        ).withColumn("found_digest", F.coalesce("found_digest", "torn_digest"))
    return records.select(
        "file", "at", "id", "kind", "refers_to", "digest", "payload_bytes", "found_digest"
    )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, pos, piece in _in_order(batches):
        yield pa.RecordBatch.from_pylist(
            [{"file": file, "block": block, "pos": pos, "piece": piece}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("piece", pa.binary())]),
        )


def _owners(staged: DataFrame, bases: DataFrame, records: DataFrame, torn: DataFrame) -> DataFrame:
    """(file, block, pos, at, skip, payload_bytes): the torn record that each of its pieces lies in.

    Narrow rows only. A piece belongs to the last record that starts at or before it: in its own block,
    or else the last one of the blocks before.
    """
    starts = records.select("file", "at", F.lit(True).alias("is_record"))
    pieces = (
        staged.join(bases, ["file", "block"])
        .select("file", "block", "pos", (F.col("base") + F.col("pos") - len(MAGIC)).alias("at"))
        .join(starts, ["file", "at"], "left")
    )
    own = F.when(F.col("is_record"), F.col("at"))
    blocks = pieces.groupBy("file", "block").agg(F.max(own).alias("last"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.max("last").over(in_file).alias("carried"))
    in_block = Window.partitionBy("file", "block").orderBy("pos")
    owned = pieces.join(carried, ["file", "block"]).select(
        "file",
        "block",
        "pos",
        F.col("at").alias("here"),
        F.coalesce(F.last(own, ignorenulls=True).over(in_block), F.col("carried")).alias("at"),
    )
    return owned.join(torn, ["file", "at"]).where("here <= at + skip + payload_bytes").drop("here")


def _joined_payloads(spark: SparkSession, path: str, owners: DataFrame) -> DataFrame:
    """(file, at, torn_digest) of records whose payload holds version lines, from all their pieces.

    Only pieces of such records are grouped. A few owners are sent to the scan; many are joined to it in
    a shuffle by piece.
    """
    pieces = _pieces(spark, path).mapInArrow(_positions, "file string, block long, pos long, piece binary")
    if owners.count() <= MAX_BROADCAST_KEEPERS:
        owners = F.broadcast(owners)
    whole = (
        pieces.join(owners, ["file", "block", "pos"])
        .groupBy("file", "at")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "pos", "piece"))).alias("parts"),
            F.first("skip").alias("skip"),
            F.first("payload_bytes").alias("size"),
        )
    )
    # strings only in name: neither the casts nor the join look at the bytes
    joined = F.array_join(F.transform("parts", lambda part: part["piece"].cast("string")), MAGIC)
    payload = F.substring(joined.cast("binary"), F.col("skip") + 1, F.col("size"))
    # a file may end before the payload does
    digest = F.when(F.octet_length(payload) == F.col("size"), F.sha1(payload))
    return whole.select("file", "at", digest.alias("torn_digest"))
