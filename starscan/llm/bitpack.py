"""Token ids in binary files: each id takes the fewest bits that the vocabulary needs.

A file is a row of blocks, each followed by one byte 0x0A (the text sink's line separator). A block,
little-endian: ``TIDS``, then six unsigned 32-bit numbers (bits of an id, shard, number of the block
in its shard, documents, ids, bytes of the whole block with its end byte); per document its id (8 bytes signed),
its number of ids (8 bytes unsigned) and one byte, 0 for a null id; then the ids of all documents on end. Eight ids
fill as many bytes as an id has bits, so that any id is found by its number: packing and unpacking
work on columns of bytes. Documents lie in ascending order of their id, over files, blocks and shards.

Defined results. Null text: empty, so only the end id. Null doc_id: before all others. Repeated
rows and ids: an entry each, ties in order of the text. Very long texts: a block of their own. Empty
table: no block. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.llm.common import text_chunks
from starscan.llm.tokens import encode_texts, library_encoder

MAGIC = b"TIDS"
HEAD = struct.Struct("<4s6I")
ENTRY = np.dtype([("doc", "<i8"), ("ids", "<u8"), ("valid", "u1")])
#: A block is closed when it holds as many ids; a file when it holds as many blocks (about 8 MB).
IDS_PER_BLOCK = 1 << 16
BLOCKS_PER_FILE = 64
#: Text that is encoded at once, in bytes, and pieces that a worker remembers.
CORPUS_BYTES = 8 << 20
KNOWN_PIECES = 600_000


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits for each id, lowest bit first."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = groups[:, j] << np.uint64(shift)
        for k in range(byte, byte + -(-(shift + width) // 8)):
            out[:, k] |= (value & np.uint64(255)).astype(np.uint8)
            value >>= np.uint64(8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: memoryview | bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of packed ``data``; reads only the bytes they are in."""
    group, skip = divmod(first, 8)
    groups = -(-(skip + count) // 8)
    raw = np.frombuffer(data, np.uint8)[group * width : (group + groups) * width]
    cells = np.zeros(groups * width, np.uint8)
    cells[: len(raw)] = raw
    cells = cells.reshape(groups, width)
    out = np.zeros((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = np.zeros(groups, np.uint64)
        for n, k in enumerate(range(byte, byte + -(-(shift + width) // 8))):
            value |= cells[:, k].astype(np.uint64) << np.uint64(8 * n)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[skip : skip + count]


def write_block(shard: int, block: int, width: int, docs: list, ids: list[np.ndarray]) -> bytes:
    table = np.zeros(len(docs), ENTRY)
    table["doc"] = [d or 0 for d in docs]
    table["ids"] = [len(x) for x in ids]
    table["valid"] = [d is not None for d in docs]
    flat = np.concatenate(ids)
    body = table.tobytes() + pack(flat, width)
    return HEAD.pack(MAGIC, width, shard, block, len(docs), len(flat), HEAD.size + len(body) + 1) + body


def blocks(content: memoryview) -> Iterator[tuple[int, int, int, np.ndarray, memoryview]]:
    """(shard, block, width, document table, packed ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, width, shard, block, n_docs, _, size = HEAD.unpack_from(content, at)
        if magic != MAGIC or content[at + size - 1] != 0x0A:
            raise ValueError(f"no block at byte {at}")
        start = at + HEAD.size
        table = np.frombuffer(content, ENTRY, n_docs, start)
        yield shard, block, width, table, content[start + table.nbytes : at + size - 1]
        at += size


def write_ids(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, end_id: int) -> None:
    """Encodes rows (doc_id, text) by the tokenizers file ``vocabulary`` and writes them.

    The documents are dealt out by ranges of doc_id and sorted; each task writes its files alone.
    """
    width = max(1, (vocabulary_size - 1).bit_length())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary, KNOWN_PIECES)
        shard, number, held = TaskContext.get().partitionId(), 0, 0
        names: list = []
        parts: list[np.ndarray] = []
        done = lambda: pa.RecordBatch.from_pydict(
            {"block": pa.array([write_block(shard, number, width, names, parts)], pa.binary())}
        )
        for chunk in text_chunks(batches, size=CORPUS_BYTES):
            lists = encode_texts(chunk.column("text"), encode, drops_space=True)
            keys = chunk.column("doc_id").to_pylist()
            for key, start, n in zip(keys, lists.starts.tolist(), lists.lengths.tolist(), strict=True):
                names.append(key)
                parts.append(np.append(lists.ids[start : start + n], np.int32(end_id)))
                held += n + 1
                if held >= IDS_PER_BLOCK:
                    yield done()
                    names, parts, held, number = [], [], 0, number + 1
        if names:
            yield done()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ordered.mapInArrow(packed, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", BLOCKS_PER_FILE)
        .text(path)
    )


READ = pa.schema(
    [
        ("file", pa.string()),
        ("shard", pa.int64()),
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
READ_DDL = (
    "file string, shard long, block long, doc_id long, start long, n_tokens long, ids_crc32 long,"
    " ids array<int>"
)


def _documents(with_ids: bool, only: frozenset | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column(0), batch.column(1), strict=True):
                before = 0
                for shard, block, width, table, data in blocks(memoryview(cell.as_buffer())):
                    ends = np.cumsum(table["ids"].astype(np.int64))
                    starts = ends - table["ids"].astype(np.int64)
                    which = range(len(table))
                    if only is not None:
                        which = [i for i in which if table["valid"][i] and int(table["doc"][i]) in only]
                    flat = None if only is not None else unpack(data, width, 0, int(ends[-1]))
                    rows = []
                    for i in which:
                        a, b = int(starts[i]), int(ends[i])
                        ids = unpack(data, width, a, b - a) if flat is None else flat[a:b]
                        rows.append(
                            {
                                "file": path.as_py(),
                                "shard": shard,
                                "block": block,
                                "doc_id": int(table["doc"][i]) if table["valid"][i] else None,
                                "start": before + a,
                                "n_tokens": b - a,
                                "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                                "ids": ids.astype(np.int32) if with_ids else None,
                            }
                        )
                    before += int(ends[-1])
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, READ)

    return read


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(_documents(with_ids, None), READ_DDL)
    # one row per file: what the headers say of its ids and its place among the files
    heads = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        _totals, "file string, shard long, block long, total long"
    )
    before = Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = heads.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "file").select(
        "doc_id",
        (F.col("base") + F.col("start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, cell in zip(batch.column(0), batch.column(1), strict=True):
            first, total = None, 0
            for shard, block, _, table, _ in blocks(memoryview(cell.as_buffer())):
                first = first or (shard, block)
                total += int(table["ids"].sum())
            if first:
                yield pa.RecordBatch.from_pydict(
                    {"file": [path.as_py()], "shard": [first[0]], "block": [first[1]], "total": [total]}
                )


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a list of documents; of other documents nothing is unpacked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_documents(True, frozenset(doc_ids)), READ_DDL).select(
        "doc_id", "n_tokens", "ids_crc32", "ids"
    )
