import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents_frame, some_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starscan.llm import bitpack, queries
from starscan.session import scratch_path


def whole_ids(texts, name):
    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bitpack, "IDS_PER_BLOCK", 4000)
    monkeypatch.setattr(bitpack, "BLOCKS_PER_FILE", 2)
    rows = some_documents(sf_dir)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = Counter(), 0
    for (doc_id, _), ids in zip(rows, whole_ids([t for _, t in rows], "word_bpe_49k.json"), strict=True):
        expected[doc_id, start, len(ids) + 1, crc([*ids, 1])] += 1
        start += len(ids) + 1
    found = queries.bitpack_round_trip(spark, documents_frame(spark, rows))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_empty(spark):
    assert queries.bitpack_round_trip(spark, documents_frame(spark, [], 1)).collect() == []


def test_random_access(spark, sf_dir):
    rows = some_documents(sf_dir, 30)
    path = scratch_path(spark, "ids")
    vocabulary = queries.vocabulary("word_bpe_49k.json")
    bitpack.write_ids(documents_frame(spark, rows), path, vocabulary, 49_408, 1)
    wanted = {rows[3][0]: rows[3][1], 900_005: dict(rows)[900_005]}
    found = {r.doc_id: r.ids for r in bitpack.fetch_documents(spark, path, list(wanted)).collect()}
    ids = whole_ids(wanted.values(), "word_bpe_49k.json")
    assert found == {d: [*i, 1] for d, i in zip(wanted, ids, strict=True)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=60), st.data())
def test_any_width_and_place(width, values, data):
    ids = np.array([v % (1 << width) for v in values], np.uint32)
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert bitpack.unpack(packed, width, first, count).tolist() == ids[first : first + count].tolist()


def test_broken_block():
    with pytest.raises(ValueError):
        list(bitpack.blocks(memoryview(b"x" * 100)))
