import hashlib
import re
from collections import Counter

import pytest
from fixtures import documents_frame, some_documents
from pyspark.sql import functions as F

from starscan.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    sections = ["".join(sha(p) for p in s.split("\n")) for s in text.split("\n\n")]
    return sha("".join(map(sha, sections)))


def leaves(text):
    return set(re.findall(r"(?:[^ \n]*[^ \n.!?] ){0,7}[^ \n]+", text))


def likeness(a, b):
    x, y = leaves(a), leaves(b)
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def by_hand(rows):
    rows = [(d, t or "") for d, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), root(r[1])))
    out = Counter()
    for (doc_id, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        out[
            doc_id, len(text), sha(edited), root(text), root(edited),
            likeness(text, edited), likeness(text, follower),
        ] += 1
    return out


def fingerprints(spark, rows, parts=3):
    found = merkle.fingerprint_documents(spark, documents_frame(spark, rows, parts))
    assert found.columns == merkle.RESULT
    return Counter(tuple(r) for r in found.collect())


MORE = [(-7, "a\n\nb\n\n\nc"), (-8, "a\n\nb\n\n\nc"), (-9, "One. Two three! Four?five six. " * 20)]


@pytest.mark.parametrize("bucket", [1 << 24, 20_000, 400])
def test_against_brute_force(spark, sf_dir, monkeypatch, bucket):
    monkeypatch.setattr(merkle, "BUCKET_BYTES", bucket)
    rows = some_documents(sf_dir, 60) + MORE
    assert fingerprints(spark, rows) == by_hand(rows)


def test_an_id_of_most_rows_is_dealt_to_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 400)
    rows = [(5, f"text {i} of one id\nwith lines") for i in range(300)]
    rows += [(None, f"no id {i}") for i in range(200)] + [(i, f"other {i}") for i in range(20)]
    frame = documents_frame(spark, rows)
    dealt = merkle.with_fingerprints(frame)
    bucket, n = merkle.bucket_of(dealt)
    sizes = dealt.select("doc_id", bucket.alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 120 and max(r["b"] for r in sizes) < n
    assert fingerprints(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(1, None)], [(2, "same"), (2, "same"), (2, "same")]])
def test_small_tables(spark, rows):
    assert fingerprints(spark, rows, 1) == by_hand(rows)


def test_differing_branches_locate_edits(spark):
    before = "title\n\nfirst line\nsecond line\n\nlast"
    pairs = [
        ("same", before, before),
        ("line", before, before.replace("second", "another")),
        ("section", before, before.replace("\n\nlast", "\n\nnew\n\nlast")),
        ("moved", before, "last\n\ntitle\n\nfirst line\nsecond line"),
        ("missing", before, "title\n\nlast"),
        ("from nothing", None, "a\nb"),
    ]
    frame = spark.createDataFrame(pairs, "id string, before string, after string")
    found = merkle.locate_edits(frame.withColumn("node", F.lit(1)))
    assert Counter(tuple(r) for r in found.collect()) == Counter(
        [("line", 1, 1), ("section", 2, 0), ("from nothing", 0, 0), ("from nothing", 0, 1)]
    )


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = merkle.with_fingerprints(docs)
    merkle.compared(rows.withColumn("next", F.struct("fingerprint", "text", "leaves"))).explain(True)
    assert not re.search("Python|Arrow|Pandas|MapPartitions", capsys.readouterr().out)
