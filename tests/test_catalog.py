"""Loads, patches, run log and path rules on files in a scratch folder."""

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starscan.plans import catalog
from starscan.plans.ingest import convert_dump
from starscan.session import settings
from starscan.sources import files, log
from starscan.sources.dump import read_first
from starscan.sources.parquet import check_codec, read_staged, resolve_inputs, write_staged


def write_lines(path, records):
    path.write_text("[\n" + ",\n".join(json.dumps(r) for r in records) + "\n]\n")
    return str(path)


def names(spark, root):
    return {r["system_key"]: r["name"] for r in catalog.systems(spark, root).collect()}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "catalog")


def test_later_record_and_later_file_win(spark, tmp_path, root):
    write_lines(tmp_path / "a.json", [{"id64": 1, "name": "a1"}, {"id64": 1, "name": "a2"},
                                      {"id64": 2, "name": "only"}, {"id64": 3}])
    write_lines(tmp_path / "b.json", [{"id64": 1, "name": "b1"}, {"id64": 1, "name": "b2"}])
    stats = catalog.import_dump(spark, root, str(tmp_path / "*.json"))
    assert names(spark, root) == {"addr:1": "b2", "addr:2": "only"}
    assert (stats.seen, stats.written) == (6, 2)
    assert stats.size > 100
    assert float(catalog.get_meta(spark, root, "last_import_systems_per_sec")) > 0


def test_patch_updates_inserts_and_keeps(spark, tmp_path, root):
    full = write_lines(tmp_path / "full.json", [
        {"id64": 1, "name": "one", "population": 5}, {"id64": 2, "name": "two"}])
    patch = write_lines(tmp_path / "patch.json", [{"id64": 1, "name": "ONE"},
                                                  {"id64": 3, "name": "three"}])
    catalog.import_source(spark, root, full)
    for _ in range(2):  # a patch applied twice changes nothing more
        catalog.import_source(spark, root, patch, mode=" Patch ")
        assert names(spark, root) == {"addr:1": "ONE", "addr:2": "two", "addr:3": "three"}
        row = catalog.systems(spark, root).where("system_key = 'addr:1'").first()
        assert row["population"] is None and row["source_tag"] == "patch.json"
    assert catalog.get_meta(spark, root, "last_import_mode") == "patch"
    assert catalog.get_meta(spark, root, "last_import_source") == "patch.json"


def test_patch_on_nothing_equals_full(spark, tmp_path, root):
    dump = write_lines(tmp_path / "d.json", [{"id64": i, "name": f"s{i}"} for i in range(5)])
    catalog.import_dump(spark, root, dump)
    catalog.import_dump(spark, root + "2", dump, mode="patch")
    assert names(spark, root) == names(spark, root + "2")


def test_failed_load_leaves_the_table(spark, tmp_path, root):
    catalog.import_dump(spark, root, write_lines(tmp_path / "d.json", [{"name": "kept"}]))
    (tmp_path / "bad.json").write_text('[\n{"name": "x"},\n{"name": \n]\n')
    with pytest.raises(Exception, match="Malformed"):
        catalog.import_dump(spark, root, str(tmp_path / "bad.json"))
    assert names(spark, root) == {"name:kept": "kept"}


def test_mode_is_checked(spark, tmp_path, root):
    with pytest.raises(ValueError, match="mode"):
        catalog.import_dump(spark, root, str(tmp_path / "d.json"), mode="merge")


def test_run_log(spark, root):
    assert catalog.get_meta(spark, root, "missing", "default") == "default"
    catalog.init_catalog(spark, root)
    catalog.set_meta(spark, root, a=1, b="x")
    catalog.set_meta(spark, root, a=2)
    assert catalog.get_meta(spark, root, "a") == "2"
    assert catalog.get_meta(spark, root, "schema_version") == "4"
    assert catalog.latest_values(catalog.read_log(spark, root)).count() == 3
    assert catalog.systems(spark, root).count() == 0


# --- fixed values: the columns of the exchange format ---
STAGED = pa.schema([
    ("seq", pa.int64()), ("system_key", pa.string()), ("system_address", pa.int64()),
    ("name", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()),
    ("population", pa.int64()), ("controlling_faction", pa.string()),
    ("faction_count", pa.int32()), ("total_bodies", pa.int32()), ("total_planets", pa.int32()),
    ("total_stars", pa.int32()), ("ringed_body_count", pa.int32()),
    ("water_world_count", pa.int32()), ("earthlike_world_count", pa.int32()),
    ("body_type_counts_json", pa.string()), ("body_subtype_counts_json", pa.string()),
    ("ring_type_counts_json", pa.string()), ("imported_at", pa.timestamp("us")),
    ("source_tag", pa.string())])
# --- end of fixed values ---


def staged_file(path, *rows):
    filled = []
    for seq, key, name in rows:
        row = dict.fromkeys(STAGED.names)
        filled.append(row | {"seq": seq, "system_key": key, "name": name, "faction_count": 0,
                             "body_type_counts_json": '{"Planet": 2}', "source_tag": "t",
                             "imported_at": datetime(2024, 1, 2, 3, 4, 5, 6)})
    pq.write_table(pa.Table.from_pylist(filled, schema=STAGED), str(path))


def test_foreign_staged_files(spark, tmp_path, root):
    """Parts written by another program: the highest seq wins, JSON text becomes maps."""
    staged_file(tmp_path / "s.part-1.parquet", (1, "k1", "old"), (5, "k1", "new"), (2, "k2", "b"))
    staged_file(tmp_path / "s.part-2.parquet", (3, "k1", "mid"), (4, "k3", "c"))
    stats = catalog.import_source(spark, root, str(tmp_path / "s.parquet"))
    assert names(spark, root) == {"k1": "new", "k2": "b", "k3": "c"}
    assert (stats.seen, stats.written, stats.parts) == (5, 3, 2)
    assert catalog.get_meta(spark, root, "last_import_source") == "s.part-1.parquet, s.part-2.parquet"
    row = catalog.systems(spark, root).first()
    assert row["body_type_counts"] == {"Planet": 2} and row["ring_type_counts"] == {}
    assert row["imported_at"] == datetime(2024, 1, 2, 3, 4, 5, 6)


def test_histograms_are_parsed_for_the_latest_rows_only(spark, tmp_path, root, monkeypatch):
    staged_file(tmp_path / "a.parquet", (1, "k1", "old"), (2, "k1", "new"))
    seen, keep = [], catalog.keep_latest
    monkeypatch.setattr(
        catalog, "keep_latest", lambda rows, *order: seen.append((rows.columns, keep(rows, *order))) or seen[-1][1]
    )
    catalog.import_source(spark, root, str(tmp_path / "a.parquet"))
    columns, latest = next(found for found in seen if "seq" in found[0])
    assert "body_type_counts_json" in columns and latest.count() == 1
    assert catalog.systems(spark, root).first()["body_type_counts"] == {"Planet": 2}


def test_path_rules(spark, tmp_path):
    folder = tmp_path / "dir"
    (folder / "deep").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        resolve_inputs(spark, str(folder))
    staged_file(folder / "b.parquet", (1, "k", "n"))
    staged_file(folder / "a.parquet", (1, "k", "n"))
    staged_file(folder / "deep" / "c.parquet", (1, "k", "n"))
    tails = [p.rpartition("/")[2] for p in resolve_inputs(spark, str(folder))]
    assert tails == ["a.parquet", "b.parquet"]
    assert resolve_inputs(spark, f"{folder}/*.parquet") == [f"{folder}/*.parquet"]
    assert resolve_inputs(spark, f"{folder}/a.parquet") == [f"{folder}/a.parquet"]
    with pytest.raises(FileNotFoundError):
        resolve_inputs(spark, f"{folder}/missing.parquet")


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", "none"])
def test_convert_then_load(spark, tmp_path, root, codec):
    dump = write_lines(tmp_path / "d.json", [
        {"id64": i % 40, "name": f"s{i}", "bodies": [{"type": "Star"}]} for i in range(100)])
    parts = str(tmp_path / "parts")
    convert_dump(spark, dump, parts, compression=codec, rows_per_file=30)
    files = sorted((tmp_path / "parts").glob("*.parquet"))
    assert len(files) >= 4 and all(pq.read_metadata(f).num_rows <= 30 for f in files)
    meta = pq.read_metadata(files[0]).row_group(0).column(0).compression
    assert meta == {"none": "UNCOMPRESSED"}.get(codec, codec.upper())
    assert pq.read_schema(files[0]).names == STAGED.names
    assert pq.read_table(files[0])["body_type_counts_json"][0].as_py() == '{"Star": 1}'
    catalog.import_parquet(spark, root, parts)
    assert names(spark, root) == {f"addr:{i % 40}": f"s{i}" for i in range(100)}


def test_unknown_codec(spark, tmp_path):
    with pytest.raises(ValueError, match="compression"):
        write_staged(spark.range(1), str(tmp_path / "x"), compression="lzma")


def test_staged_round_trip_keeps_types(spark, tmp_path):
    staged_file(tmp_path / "a.parquet", (1, "k", "n"))
    rows = read_staged(spark, str(tmp_path / "a.parquet"))
    write_staged(rows, str(tmp_path / "b"))
    again = read_staged(spark, str(tmp_path / "b"))
    assert again.schema == rows.schema and again.collect() == rows.collect()


def test_buckets_are_ordered_in_space(spark, tmp_path, root):
    dump = write_lines(tmp_path / "d.json", [
        {"id64": i, "name": f"s{i}", "x": (i * 7919) % 4001 - 2000, "y": 0, "z": 0}
        for i in range(500)])
    catalog.import_dump(spark, root, dump)
    parts = list((tmp_path / "catalog" / "systems" / "version=1").glob("bucket=*/*.parquet"))
    assert len({part.parent for part in parts}) == catalog.LEAST_BUCKETS
    for part in parts:
        cells = [x // catalog.LAYOUT_EDGE for x in pq.ParquetFile(part).read()["x"].to_pylist()]
        assert cells == sorted(cells)


def test_typed_tables_and_statistics(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS typed")
    catalog.create_tables(spark, "typed")
    catalog.create_tables(spark, "typed")
    spark.sql("INSERT INTO typed.systems (system_key, name) VALUES ('k', 'n')")
    row = spark.table("typed.systems").first()
    assert row["faction_count"] == 0 and row["total_bodies"] == 0 and row["population"] is None
    catalog.analyze_table(spark, "typed.systems")
    described = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED typed.systems name").collect()}
    assert described["distinct_count"] == "1"
    spark.sql("DROP DATABASE typed CASCADE")


def grid(n):
    return [{"id64": i, "name": f"S{i}", "x": i * 600.0, "y": 0, "z": 0} for i in range(n)]


def stored_files(tmp_path, table="systems"):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / "catalog" / table).rglob("*.parquet")}


def test_patch_overwrites_only_the_partitions_it_touches(spark, tmp_path, root):
    catalog.import_dump(spark, root, write_lines(tmp_path / "full.json", grid(400)))
    before = stored_files(tmp_path) | stored_files(tmp_path, "names")
    patch = [{"id64": 3, "name": "S3b"}]
    catalog.import_dump(spark, root, write_lines(tmp_path / "patch.json", patch), mode="patch")
    after = stored_files(tmp_path) | stored_files(tmp_path, "names")
    gone = {p.parent for p in before if after.get(p) != before[p]}
    assert len(gone) == 2 and {p.parent for p in set(after) - set(before)} == gone
    want = {f"addr:{i}": f"S{i}" for i in range(400)} | {"addr:3": "S3b"}
    assert names(spark, root) == want
    # names that have been replaced are gone, others stay
    found = {r["name_lower"] for r in catalog.names(spark, root).collect()}
    assert found == {name.lower() for name in want.values()}
    assert catalog.current(spark, root) == (1, catalog.LEAST_BUCKETS)


def test_old_versions_stay_until_they_are_removed(spark, tmp_path, root):
    for n in (5, 7, 9):
        catalog.import_dump(spark, root, write_lines(tmp_path / "d.json", grid(n)))
    assert catalog.versions(spark, root) == [1, 2, 3]
    assert catalog.systems(spark, root, 1).count() == 5
    # a load that died before it was logged is no version, and its number is not used again
    (tmp_path / "catalog" / "systems" / "version=4").mkdir()
    assert catalog.remove_old_versions(spark, root) == 1
    assert catalog.versions(spark, root) == [2, 3, 4]
    assert len(names(spark, root)) == 9
    catalog.import_dump(spark, root, write_lines(tmp_path / "d.json", grid(11)))
    assert catalog.current(spark, root)[0] == 5 and len(names(spark, root)) == 11
    with pytest.raises(ValueError, match="kept"):
        catalog.remove_old_versions(spark, root, keep=0)


def test_a_patch_that_died_is_applied_again(spark, tmp_path, root, monkeypatch):
    catalog.import_dump(spark, root, write_lines(tmp_path / "full.json", grid(40)))
    patch = write_lines(tmp_path / "p.json", [{"id64": i, "name": f"P{i}"} for i in range(0, 60, 3)])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(catalog, "write_names", dies)
        with pytest.raises(RuntimeError, match="lost"):
            catalog.import_dump(spark, root, patch, mode="patch")
    catalog.import_dump(spark, root, patch, mode="patch")
    want = {f"addr:{i}": f"S{i}" for i in range(40)} | {f"addr:{i}": f"P{i}" for i in range(0, 60, 3)}
    assert names(spark, root) == want
    assert {r["name_lower"] for r in catalog.names(spark, root).collect()} == {n.lower() for n in want.values()}


def test_many_loads_leave_few_files(spark, root, monkeypatch):
    """The log is read while it grows: every entry is there once, in a bounded number of files."""
    monkeypatch.setattr(log, "MOST_FILES", 4)
    most = 0
    for n in range(1, 31):
        catalog.set_meta(spark, root, n=n, even=n - n % 2)
        entries = catalog.read_log(spark, root)
        # a reader that has listed the files before the next entry comes
        if n % 7 == 0:
            listed, seen = entries, n
        if n % 7 == 2 and n > 7:
            assert listed.count() == 2 * seen
        most = max(most, len(files.glob(spark, f"{root}/run_log/*/*.parquet")))
    assert most <= 2 * 4 + 1
    assert catalog.get_meta(spark, root, "n") == "30" and catalog.get_meta(spark, root, "even") == "30"
    found = [int(r["value"]) for r in catalog.read_log(spark, root).where("key = 'n'").collect()]
    assert sorted(found) == list(range(1, 31))


def test_every_source_is_logged(spark, tmp_path, root):
    folder = tmp_path / "dumps"
    folder.mkdir()
    for i in range(13):
        write_lines(folder / f"d{i:02}.json", [{"id64": i, "name": f"s{i}"}])
    (folder / "_SUCCESS").write_text("")
    catalog.import_dump(spark, root, f"{folder}/d*.json")
    listed = [f"d{i:02}.json" for i in range(13)]
    found = catalog.run_sources(spark, root).collect()
    assert sorted(r["source"].rpartition("/")[2] for r in found) == listed
    assert {(r["load"], r["records"]) for r in found} == {(1, 1)}
    assert catalog.get_meta(spark, root, "last_import_source") == ", ".join(listed)
    assert [p.rpartition("/")[2] for p in files.inputs(spark, str(folder))] == listed


def test_lookup_filter_reaches_the_names(spark, tmp_path, root):
    catalog.import_dump(spark, root, write_lines(tmp_path / "d.json", grid(50)))
    plan = catalog.names(spark, root).where("name_lower = 's7'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name_lower,s7)" in text
    assert catalog.reference_points(spark, root, ["S7"]) == [("S7", 4200.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="unknown"):
        catalog.reference_points(spark, root, ["S7", "nowhere"])


def scan_metric(df, name):
    """A metric of the plan's only scan, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getName():
        plan = plan.finalPhysicalPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().get(name).get().value()


def test_absent_names_read_no_row(spark, tmp_path, root):
    """Within the range of names of every row group, so that only the Bloom filters tell."""
    rows = [{"id64": i, "name": f"S{i:05}", "x": 0, "y": 0, "z": 0} for i in range(0, 4000, 2)]
    catalog.import_dump(spark, root, write_lines(tmp_path / "d.json", rows))
    stored = catalog.names(spark, root)
    # one bucket holds it, and the filters of the others may pass one in a hundred names
    assert scan_metric(stored.where("name_lower = 's01998'"), "numOutputRows") < 2000 / 2
    absent = [scan_metric(stored.where(f"name_lower = 's{i:05}'"), "numOutputRows") for i in range(1001, 1041, 2)]
    assert sum(n == 0 for n in absent) >= 15
    key = "parquet.filter.bloom.enabled"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(key, "false")
    try:
        plain = catalog.names(spark, root).where("name_lower = 's01001'")
        assert scan_metric(plain, "numOutputRows") > 0
    finally:
        conf.unset(key)


def test_statistics_change_the_side_that_is_broadcast(spark, tmp_path, root):
    """Nearly all systems are empty: only a histogram tells that few have more than a few bodies."""
    bodies = [{"type": "Star"}] * 40
    rows = [{"id64": i, "name": f"S{i}", "bodies": bodies if i % 200 == 0 else []} for i in range(4000)]
    spark.sql("CREATE DATABASE IF NOT EXISTS planned")
    dump = write_lines(tmp_path / "d.json", rows)
    catalog.import_source(spark, root, dump, database="planned")
    assert "num_of_bins: 254" in catalog.column_statistics(spark, "planned.systems", "total_bodies")["histogram"]
    spark.sql("CREATE TABLE planned.visits (system_key string, note string) USING parquet")
    visits = spark.range(600).selectExpr("concat('addr:', id) AS system_key", "repeat('n', 40) AS note")
    visits.write.insertInto("planned.visits")
    catalog.analyze_table(spark, "planned.visits")

    def built(spark):
        rich = spark.table("planned.systems").where("total_bodies > 30").select("system_key")
        joined = rich.join(spark.table("planned.visits"), "system_key")
        text = joined._jdf.queryExecution().sparkPlan().toString()
        assert joined.count() == 3
        return [side for side in ("BuildLeft", "BuildRight") if side in text]

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": str(1 << 30)}):
        assert built(spark) == ["BuildRight"]
        with catalog.cost_based(spark):
            assert built(spark) == ["BuildLeft"]
    spark.sql("DROP DATABASE planned CASCADE")


def test_patch_changes_the_published_table_in_place(spark, tmp_path, root):
    spark.sql("CREATE DATABASE IF NOT EXISTS inplace")
    catalog.import_dump(spark, root, write_lines(tmp_path / "f.json", grid(40)), database="inplace")
    before = stored_files(tmp_path)
    patch = write_lines(tmp_path / "p.json", [{"id64": 7, "name": "New"}])
    catalog.import_dump(spark, root, patch, mode="patch", database="inplace")
    assert spark.table("inplace.systems").where("system_key = 'addr:7'").first()["name"] == "New"
    assert spark.table("inplace.systems").count() == 40
    assert len(set(before) & set(stored_files(tmp_path))) >= len(before) - 2
    assert catalog.column_statistics(spark, "inplace.systems", "name")["distinct_count"] == "40"
    spark.sql("DROP DATABASE inplace CASCADE")
    # the files are the catalogue's, not the table's
    assert len(names(spark, root)) == 40


def test_publish_to_typed_tables(spark, tmp_path, root):
    spark.sql("CREATE DATABASE IF NOT EXISTS published")
    dump = write_lines(tmp_path / "d.json", grid(30))
    for _ in range(2):
        catalog.import_source(spark, root, dump, database="published")
        assert spark.table("published.systems").count() == 30
    meta = {r["key"]: r["value"] for r in spark.table("published.app_meta").collect()}
    assert meta["last_import_mode"] == "full" and meta["current_version"] == "2"
    spark.sql("DROP DATABASE published CASCADE")


def test_codec_that_spark_lacks(spark, tmp_path):
    dump = write_lines(tmp_path / "d.json", grid(3))
    try:
        check_codec(spark, "brotli")
    except ValueError as error:
        assert "brotli needs" in str(error)
        with pytest.raises(ValueError, match="brotli needs"):
            convert_dump(spark, dump, str(tmp_path / "b"), compression="brotli")
    else:
        convert_dump(spark, dump, str(tmp_path / "b"), compression="brotli")


def test_row_group_size(spark, tmp_path):
    dump = write_lines(tmp_path / "d.json", grid(30_000))
    convert_dump(spark, dump, str(tmp_path / "p"), row_group_bytes=100_000)
    assert any(pq.read_metadata(f).num_row_groups > 1 for f in (tmp_path / "p").glob("*.parquet"))


def test_first_records_read_no_file_behind_the_cut(spark, tmp_path):
    for name in "abcd":
        write_lines(tmp_path / f"{name}.json", [{"name": f"{name}{i}"} for i in range(5)])
    chosen = read_first(spark, f"{tmp_path}/*.json", n=7)
    assert {f.rpartition("/")[2] for f in chosen.inputFiles()} <= {"a.json", "b.json", "c.json"}
    found = [r["n"] for r in chosen.selectExpr("cast(record.name AS string) AS n", "seq").collect()]
    assert sorted(found) == ["a0", "a1", "a2", "a3", "a4", "b0", "b1"]
    assert read_first(spark, f"{tmp_path}/*.json", n=0).count() == 0
    assert read_first(spark, f"{tmp_path}/*.json", n=100).count() == 20
