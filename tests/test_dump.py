"""Reading dump files: layouts, codecs, splits, order and errors."""

import gzip
import json
import random

import pytest
import zstandard

from starscan.demo.records import write_dump
from starscan.plans.ingest import convert_dump, stage
from starscan.session import configure, scratch_path, settings
from starscan.sources.dump import first_records, read_dump, read_first
from starscan.sources.parquet import read_staged

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in (SPLIT, OPEN_COST)}
    spark.conf.set(SPLIT, "3000")
    spark.conf.set(OPEN_COST, "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def tricky(rng, depth=0):
    roll = rng.random()
    if roll < 0.3:
        return rng.choice(["a", "}{", '"', "\\", '[]"}\\', "é}", "\n{", '\\"', ""])
    if roll < 0.5:
        return rng.randint(0, 99)
    if depth < 3 and roll < 0.75:
        return [tricky(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if depth < 3:
        return {rng.choice('pq}"\\'): tricky(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return None


def make_records(n=300, seed=3):
    rng = random.Random(seed)
    return [{"name": f"s{i}", "x": i, "bodies": tricky(rng), "factions": [tricky(rng)]}
            for i in range(n)]


def as_lines(records):
    return "[\n" + ",\n".join(json.dumps(r, ensure_ascii=False) for r in records) + "\n]\n"


LAYOUTS = {
    "pretty": lambda rs: json.dumps(rs, indent=2, ensure_ascii=False),
    "minified": lambda rs: json.dumps(rs, separators=(",", ":")),
    "mixed": lambda rs: "\n [ " + " ,\n".join(
        json.dumps(r, indent=[None, 1][i % 2]) for i, r in enumerate(rs)) + "\n]\n\n",
    "lines": as_lines,
}


def back(df):
    got = df.orderBy("source_file", "seq").selectExpr("to_json(record)").collect()
    return [json.loads(row[0]) for row in got]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_any_layout(spark, tmp_path, small_splits, layout):
    records = make_records()
    path = tmp_path / "dump.json"
    path.write_text(LAYOUTS[layout](records), encoding="utf-8")
    configure(spark)
    assert back(read_dump(spark, str(path), layout="any")) == records


def test_several_files_in_any_layout_keep_arrival_order(spark, tmp_path):
    configure(spark)
    sizes = {"a": 7, "b": 300, "c": 1, "d": 50}
    for (name, n), layout in zip(sizes.items(), LAYOUTS.values()):
        (tmp_path / f"{name}.json").write_text(layout(make_records(n)), encoding="utf-8")
    (tmp_path / "e.json.gz").write_bytes(gzip.compress(LAYOUTS["pretty"](make_records(9)).encode()))
    (tmp_path / "f.json").write_bytes(b"\xef\xbb\xbf" + LAYOUTS["pretty"](make_records(3)).encode())
    df = read_dump(spark, str(tmp_path), layout="any")
    everything = [r for n in [*sizes.values(), 9, 3] for r in make_records(n)]
    assert back(df) == everything
    assert df.select("source_file", "seq").distinct().count() == len(everything)
    assert back(read_first(spark, f"{tmp_path}/*.json", n=290, layout="any")) == everything[:290]


@pytest.mark.parametrize("change_at", [None, 0, 350])
def test_layout_is_found_in_the_whole_file(spark, tmp_path, change_at):
    """Records that spread over lines are found wherever they begin."""
    records = make_records(400)
    texts = [json.dumps(r, indent=1 if change_at is not None and i >= change_at else None)
             for i, r in enumerate(records)]
    (tmp_path / "d.json").write_text("[\n" + ",\n".join(texts) + "\n]\n")
    staged = stage(spark, scratch_path(spark, "staging"), str(tmp_path / "d.json"))
    assert (staged.seen, staged.named) == (400, 400)
    assert [r["objects"] for r in staged.sources.collect()] == [400]
    assert {r["name"] for r in staged.rows.where("is_record").collect()} == {f"s{i}" for i in range(400)}
    done = convert_dump(spark, str(tmp_path / "d.json"), str(tmp_path / "first"), max_systems=370)
    assert done == {"systems_seen": 370, "systems_written": 370}


def test_other_errors_are_no_reason_to_read_again(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        stage(spark, scratch_path(spark, "staging"), str(tmp_path / "missing.json"))


def test_lines_in_many_splits_keep_arrival_order(spark, tmp_path, small_splits):
    sizes = {"a.json": 500, "b.json": 40, "c.json": 3}
    for file, n in sizes.items():
        (tmp_path / file).write_text(as_lines(make_records(n)), encoding="utf-8")
    df = read_dump(spark, str(tmp_path / "*.json"))
    assert df.select("block_start").distinct().count() > 5
    assert back(df) == [r for n in sizes.values() for r in make_records(n)]
    numbers = df.groupBy("source_file", "seq").count().where("count > 1").count()
    assert numbers == 0


@pytest.mark.parametrize("suffix", [".json", ".json.gz", ".json.zst", ".json.zstd"])
def test_codecs(spark, tmp_path, suffix):
    records = make_records(50)
    data = as_lines(records).encode()
    if suffix.endswith("gz"):
        data = gzip.compress(data)
    elif suffix != ".json":
        data = zstandard.ZstdCompressor().compress(data)
    path = tmp_path / f"dump{suffix}"
    path.write_bytes(data)
    assert back(read_dump(spark, str(path))) == records


def test_plain_and_compressed_together(spark, tmp_path, small_splits):
    records = make_records(120)
    text = "[" + ",\n".join(
        ",".join(json.dumps(r) for r in records[i : i + 3]) for i in range(0, 120, 3)) + "]"
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.json").write_text(text)
    df = read_dump(spark, str(tmp_path))
    assert back(df) == records + records
    assert df.select("source_file", "seq").distinct().count() == 240


def test_object_over_lines_stops_the_line_layout(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text(json.dumps(make_records(3), indent=1))
    with pytest.raises(Exception, match="Malformed"):
        read_dump(spark, str(path)).collect()


@pytest.mark.parametrize("layout", ["lines", "any"])
@pytest.mark.parametrize(
    "text", ['{"name": "a"}\n', '[\n{"name": "a"},\n', '{"name": "a"}]', "[]", "[\n]\n", "[\n\n"]
)
def test_not_an_array_of_objects(spark, tmp_path, text, layout):
    path = tmp_path / "dump.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="not a top-level JSON array"):
        stage(spark, scratch_path(spark, "staging"), str(path), layout=layout)


@pytest.mark.parametrize("n", [0, 1, 7, 40, 41, 300, 542, 543, 9999])
def test_first_records(spark, tmp_path, small_splits, n):
    for file, size in {"a.json": 40, "b.json": 500, "c.json": 3}.items():
        (tmp_path / file).write_text(as_lines(make_records(size)), encoding="utf-8")
    everything = [r for size in (40, 500, 3) for r in make_records(size)]
    df = first_records(read_dump(spark, str(tmp_path / "*.json")), n)
    assert back(df) == everything[:n]


def test_convert_counts_nameless_records(spark, tmp_path):
    records = [{"name": "a"}, {"id64": 1}, {"name": "b"}, {"name": "c"}]
    (tmp_path / "d.json").write_text(as_lines(records))
    whole = convert_dump(spark, str(tmp_path / "d.json"), str(tmp_path / "whole"))
    assert whole == {"systems_seen": 4, "systems_written": 3}
    first = convert_dump(
        spark, str(tmp_path / "d.json"), str(tmp_path / "first"), max_systems=2, compression="none"
    )
    assert first == {"systems_seen": 2, "systems_written": 1}
    assert [r.name for r in read_staged(spark, str(tmp_path / "whole")).orderBy("seq").collect()] == [
        "a", "b", "c"]


def test_written_dump_keeps_a_file_whole_when_its_join_turns_into_a_broadcast(spark, tmp_path):
    """Each file was written by several tasks, so that brackets came in the wrong places."""
    source = spark.range(0, 4000, numPartitions=8).selectExpr(
        "id AS record_no", "concat('{\"name\": \"', id, '\"}') AS value"
    )
    source.write.parquet(f"{tmp_path}/source")
    # between the size of the source and that of its files' ends
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "3000"}):
        write_dump(spark.read.parquet(f"{tmp_path}/source"), f"{tmp_path}/dump", rows_per_file=500)
    for folder in sorted(tmp_path.glob("dump/file_no=*")):
        (part,) = folder.glob("*.txt")
        number = int(folder.name.rpartition("=")[2])
        names = [record["name"] for record in json.loads(part.read_text())]
        assert names == [str(i) for i in range(500 * number, 500 * number + 500)]
