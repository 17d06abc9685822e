import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents_frame, some_documents
from pyspark.sql import functions as F

from starscan.llm import quality, queries


def features_by_hand(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    found = {}
    share = 1 / (len(words) + quality.SMOOTH)
    for i, word in enumerate(words):
        *stems, shape = quality.word_features(word)
        for column in stems:
            found[column] = 1.0
        found[shape] = found.get(shape, 0) + 8 * share
        if i and words[i - 1] == word:
            found[quality.COLUMNS - 2] = found.get(quality.COLUMNS - 2, 0) + 8 * share
    if words:
        plain = quality.word_features("plain")[-1]
        found[plain] = found.get(plain, 0) + 8 * quality.SMOOTH * share
        found[quality.COLUMNS - 1] = 8 * (len(set(words)) + quality.SMOOTH) * share
    return found


def test_features(sf_dir):
    texts = [t for _, t in some_documents(sf_dir, 40)]
    found = quality.features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        mine = {}
        for column, value in zip(found.column[found.row == i].tolist(), found.value[found.row == i].tolist()):
            mine[column] = mine.get(column, 0) + value
        mine = {c: v for c, v in mine.items() if v}
        want = features_by_hand(text)
        assert mine.keys() == want.keys()
        assert all(abs(mine[c] - want[c]) < 1e-9 for c in want)


def test_slopes_fit_a_separable_case():
    texts = ["plain text of good words"] * 30 + ["nasty good words here"] * 30 + ["BAD!! STUFF!! HERE!!"] * 30
    found = quality.features(pa.array(texts))
    model = quality.fit(found, np.repeat([2, 1, 0], 30))
    assert model.thresholds[0] < model.thresholds[1]
    expected = model.exceed(found).sum(1)
    assert expected[:30].min() > expected[30:60].max() >= expected[30:60].min() > expected[60:].max()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_on(spark, docs, labels.where("doc_id % 4 > 0"))
    test = quality.graded(labels.where("doc_id % 4 = 0"))
    rows = quality.with_grades(docs.join(test, "doc_id"), model).select("grade", "__top").collect()
    kept = {g: np.mean([r["__top"] >= quality.LEAST for r in rows if r.grade == g]) for g in range(3)}
    assert kept[2] > 0.93 and kept[1] < 0.07 and kept[0] < 0.03


def test_odd_rows(spark, sf_dir):
    rows = some_documents(sf_dir)
    frame = documents_frame(spark, rows)
    labels = spark.createDataFrame(
        [(rows[0][0], 1, 0), (rows[0][0], 0, 0), (rows[1][0], None, None), (rows[2][0], 1, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = queries.quality_grades(spark, frame, labels)
    assert found.columns == ["doc_id", "expected_grade", "top_probability", "kept"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (900_001, 900_002, 900_003):
            assert (r.expected_grade, r.kept) == (0.0, False)
    kept = quality.select(spark, frame, labels)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("empty", ["docs", "labels"])
def test_empty(spark, sf_dir, empty):
    frame = documents_frame(spark, [] if empty == "docs" else [(1, "a b"), (2, "")], 1)
    labels = spark.createDataFrame([] if empty == "labels" else [(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in queries.quality_grades(spark, frame, labels).collect()}
    assert found == ({} if empty == "docs" else {1: True, 2: False})


def test_grades(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.grade for r in quality.graded(labels.withColumn("grade", F.lit(9))).collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: 2}
