from collections import Counter

import corpus_pipeline
import pytest
from fixtures import documents_frame, some_documents
from test_bitpack import crc, whole_ids
from test_packing import check_places
from test_simhash import expected as groups_by_hand

from starscan.llm import pii, quality

LABELS = "doc_id long, quality int, toxic int"


def labelled(rows):
    return [(d, int("!!" not in (t or "")), 0) for d, t in rows if d is not None and d < 900_000]


def write(spark, folder, rows):
    documents_frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(labelled(rows), LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_against_brute_force(spark, sf_dir, tmp_path):
    rows = some_documents(sf_dir, 80)
    words = rows[7][1]
    rows += [(700_001, words), (700_002, words + " more"), (700_003, "mail a@b.cc or +1 (017) 555-7713 now")]
    folder = write(spark, tmp_path / "in", rows)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    # the model itself is tested by its accuracy
    model = quality.fit_on(spark, frame, spark.read.parquet(f"{folder}/labels.parquet"))
    graded = quality.with_grades(frame, model).collect()
    kept = [(r.doc_id, r.text) for r in graded if r["__top"] >= quality.LEAST]
    assert 0 < len(kept) < len(rows)
    chosen = Counter()
    for (doc_id, _, root), n in groups_by_hand(kept).items():
        if doc_id is None or doc_id == root:
            chosen[doc_id] += n if doc_id is None else 1
    smallest = {}
    for doc_id, text in kept:
        if doc_id in chosen:
            smallest.setdefault(doc_id, []).append(text)
    out = [(d, pii.mask(t)) for d, texts in smallest.items() for t in sorted(texts)[: chosen[d]]]
    expected = Counter()
    for (doc_id, _), ids in zip(out, whole_ids([t for _, t in out], "byte_bpe_50k.json"), strict=True):
        ids = [*ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, crc(ids[a:b])] += 1
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    check_places(found, 1024)


@pytest.mark.parametrize("rows", [[], [(1, "one clean document of words"), (1, "one clean document of words")]])
def test_small_tables(spark, tmp_path, rows):
    folder = write(spark, tmp_path / "in", rows)
    found = corpus_pipeline.run(spark, folder).collect()
    assert [r.doc_id for r in found] == [1] * bool(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, frame, sf_dir).schema == frame.schema
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
