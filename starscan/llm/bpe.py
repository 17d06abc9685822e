"""Byte-level BPE by merge replay over a whole chunk of the corpus at once.

The distinct words of a chunk lie on end as one row of symbols. An inverted index leads from the
rank of a mergeable pair to the positions where it stands; the ranks are replayed in ascending
order, each at all its positions at once, and only the two neighbours of a merged pair are looked up
and indexed anew. That equals merging each word alone, lowest rank and leftmost first, unless a
merge makes a pair of a lower rank than its own; words in which that happens are merged alone.

Defined results. Null text: empty, no id. Null doc_id and repeated rows: encoded each for itself.
Empty table: no row. Very long texts are encoded whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starscan.llm.common import text_chunks
from starscan.llm.tokens import PieceCache, Ragged, encode_texts

NEVER = np.int64(1 << 40)
#: Text that is replayed at once, in bytes.
CORPUS_BYTES = 3 << 20
#: Pieces that a worker remembers between corpora.
CACHE_PIECES = 200_000


class Vocabulary:
    """The ranks of a file of lines ``base64 rank``."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(ranks, np.int64)[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or ``NEVER``."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_alone(self, word: bytes) -> list[int]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            i = int(np.argmin(found))
            if found[i] == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words on end, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    symbol = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, n + 1)
    ends = np.cumsum(sizes[sizes > 0])
    after[ends - 1] = n
    before = np.arange(-1, n - 1)
    before[ends - sizes[sizes > 0]] = -1
    # one more cell, so that "no neighbour" can be written to
    before = np.append(before, -1)
    alive = np.ones(n, bool)
    odd = np.zeros(len(words), bool)

    rank = np.full(n, NEVER)
    paired = np.flatnonzero(after < n)
    rank[paired] = vocabulary.rank_of(symbol[paired], symbol[after[paired]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        positions = positions[rank[positions] != NEVER]
        if not len(positions):
            return
        found = rank[positions]
        order = np.argsort(found, kind="stable")
        positions, found = positions[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for key, part in zip(found[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
            if key not in index:
                index[key] = []
                heapq.heappush(heap, key)
            index[key].append(part)

    enter(paired)
    while heap:
        now = heapq.heappop(heap)
        lists = index.pop(now)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        at = at[alive[at] & (rank[at] == now)]
        if not len(at):
            continue
        # of positions that overlap, every second one from the left
        overlaps = np.append(False, after[at[:-1]] == at[1:])
        if overlaps.any():
            run = np.maximum.accumulate(np.where(overlaps, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        symbol[at] = now
        alive[gone] = False
        rank[gone] = NEVER
        after[at] = after[gone]
        before[after[at]] = at
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        has_next = after[touched] < n
        rank[touched[~has_next]] = NEVER
        touched = touched[has_next]
        rank[touched] = vocabulary.rank_of(symbol[touched], symbol[after[touched]])
        odd[word[touched[rank[touched] < now]]] = True
        enter(touched)

    ids = symbol[alive]
    counts = np.bincount(word[alive], minlength=len(words))
    if odd.any():
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd).tolist():
            pieces[i] = np.array(vocabulary.merge_alone(words[i]), np.int64)
        ids, counts = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    return ids, counts


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def replay_encoder(path: str, pattern: str) -> PieceCache:
    """Encodes by ``replay``; one for each worker, which remembers pieces it has met."""
    import regex

    vocabulary = load(path)
    words_of = regex.compile(pattern).findall

    def encode(pieces: list[str]) -> list[np.ndarray]:
        known: dict[str, int] = {}
        split = [words_of(piece) for piece in pieces]
        which = np.array([known.setdefault(w, len(known)) for words in split for w in words], np.int64)
        ids, counts = replay([w.encode() for w in known], vocabulary)
        words = Ragged(ids.astype(np.int32), counts)
        flat = words.take(which)
        ends = np.append(0, np.cumsum(words.lengths[which]))
        cuts = ends[np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))].tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    return PieceCache(encode, at_once=1 << 30, size=CACHE_PIECES)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids) of documents (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(path, pattern)
        for chunk in text_chunks(batches, size=CORPUS_BYTES):
            lists = encode_texts(chunk.column("text"), encoder, drops_space=False)
            offsets = np.append(0, np.cumsum(lists.lengths)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), ids], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) with the decoded bytes as ``decoded``."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(path).decode
        for batch in batches:
            lists = batch.column("ids")
            cells = [decode(lists[i].values.to_numpy().tolist()) for i in range(len(lists))]
            yield batch.append_column("decoded", pa.array(cells, pa.binary()))

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, decoded binary")
