"""Whole texts to token ids, encoding each distinct stretch between spaces once.

A text may be cut before a space, or before a lone line break, wherever the character before the
cut is no white space: no word pattern of these vocabularies matches across such a place. Texts
with two white-space characters in a row are encoded in one piece. The pieces of a chunk are
dictionary-encoded by Arrow, only distinct ones reach the tokenizer, and ids are laid out by numpy.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starscan.llm.common import ranges

#: Pieces whose ids a worker remembers between chunks and tasks (about 200 bytes each).
CACHE_PIECES = 300_000
#: Lists whose ids are laid out at once.
TAKE_AT_ONCE = 1 << 17
#: Longer pieces are not remembered.
CACHE_CHARS = 64

_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class Ragged:
    """Lists of ids: ``ids`` of all lists on end, list i from ``starts[i]`` with ``lengths[i]``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids = ids
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of some lists on end; the index arrays are made for a part of them at a time."""
        out = np.empty(int(self.lengths[which].sum()), self.ids.dtype)
        done = 0
        for at in range(0, len(which), TAKE_AT_ONCE):
            part = which[at : at + TAKE_AT_ONCE]
            found = self.ids[ranges(self.starts[part], self.lengths[part])]
            out[done : done + len(found)] = found
            done += len(found)
        return out


class PieceCache:
    """Ids of strings by an encoder, remembered for the first ``size`` strings."""

    def __init__(self, encode: Callable[[list[str]], list], at_once: int = 2_000, size: int = CACHE_PIECES):
        self.encode = encode
        self.at_once = at_once
        self.size = size
        self.known: dict[str, bytes] = {}

    def __call__(self, pieces: list[str]) -> Ragged:
        found = [self.known.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(missing), self.at_once):
            part = missing[at : at + self.at_once]
            for i, ids in zip(part, self.encode([pieces[i] for i in part]), strict=True):
                found[i] = np.asarray(ids, np.int32).tobytes()
                if len(self.known) < self.size and len(pieces[i]) <= CACHE_CHARS:
                    self.known[pieces[i]] = found[i]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return Ragged(np.frombuffer(b"".join(found), np.int32), lengths)


def encode_texts(texts: pa.Array, encode: PieceCache, drops_space: bool) -> Ragged:
    """The ids of each text (null: empty). ``drops_space``: the vocabulary ignores white space."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))
    if drops_space:
        lists = pc.ascii_split_whitespace(texts)
        whole = np.zeros(0, np.int64)
    else:
        whole = np.flatnonzero(
            pc.match_substring_regex(texts, _SPACE + "{2}").to_numpy(zero_copy_only=False)
        )
        if len(whole):
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            cut = pc.if_else(pa.array(mask), "", texts)
        else:
            cut = texts
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
    ends = lists.offsets.to_numpy()
    counts = np.diff(ends)
    flat = lists.flatten().dictionary_encode()
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_pylist()
    n = len(words)
    if not drops_space:
        # a text's first piece has no space before it
        first = (ends[:-1] - ends[0])[counts > 0]
        openers, slot = np.unique(which[first], return_inverse=True)
        which[first] = n + slot
        words = [w if w[:1] == "\n" else f" {w}" for w in words] + [words[i] for i in openers]
    if len(whole):
        # the emptied texts have one empty piece each, their first
        at = (ends[:-1] - ends[0])[whole]
        which[at] = len(words) + np.arange(len(whole))
        words += texts.take(pa.array(whole)).to_pylist()
    pieces = encode(words)
    ids = pieces.take(which)
    per_piece = np.concatenate([[0], np.cumsum(pieces.lengths[which])])
    bounds = per_piece[ends - ends[0]]
    return Ragged(ids, np.diff(bounds))


#: Pieces that the library encodes as one text, and the longest of them in characters.
JOINED = 64
JOINED_CHARS = 256


@functools.lru_cache(maxsize=4)
def library_encoder(path: str, size: int = CACHE_PIECES) -> PieceCache:
    """Encodes by the tokenizers library with the vocabulary file ``path``; one for each worker.

    Half the time of a short text is spent on calling the library, so short pieces are joined by a
    special token, at which the library cuts before anything else, and told apart by its id.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    special = {t.content: i for i, t in added.items() if t.special}
    plain = [c for c, i in special.items() if not (added[i].lstrip or added[i].rstrip or added[i].single_word)]
    separator = plain[-1] if plain else None

    def apart(pieces: list[str]) -> list[list[int]]:
        tokenizer.encode_special_tokens = True
        return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def joined(pieces: list[str]) -> list[np.ndarray]:
        tokenizer.encode_special_tokens = False
        texts = [separator.join(pieces[at : at + JOINED]) for at in range(0, len(pieces), JOINED)]
        ids: list[int] = []
        for encoded in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids += encoded.ids
            ids.append(special[separator])
        flat = np.array(ids, np.int32)
        ends = np.flatnonzero(flat == special[separator]).tolist()
        return [flat[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def encode(pieces: list[str]) -> list:
        if separator is None:
            return apart(pieces)
        out: list = [None] * len(pieces)
        alone = [len(p) > JOINED_CHARS or any(token in p for token in special) for p in pieces]
        for encoder, kind in ((apart, True), (joined, False)):
            at = [i for i, a in enumerate(alone) if a is kind]
            for i, ids in zip(at, encoder([pieces[i] for i in at]) if at else [], strict=True):
                out[i] = ids
        return out

    return PieceCache(encode, size=size)
