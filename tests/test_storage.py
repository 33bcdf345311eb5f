"""Writes, read-backs and reruns in a temporary folder."""

import json

import pytest
from conftest import plan_text

from pyspark.sql import functions as F

from snaplake import session
from snaplake.session import materialise, scratch_path, shared_folder
from snaplake.sinks import tables
from snaplake.sources import files, snapshots
from snaplake.streaming.arrivals import load_arrivals


def test_csv_folder(spark, tmp_path, rows):
    (tmp_path / "A.csv").write_bytes("id,Name #,note\n1,Caf\xe9,\n2,NA,\"x, \"\"y\"\"\"\n".encode("latin-1"))
    (tmp_path / "b.CSV").write_text("k\n\"one\ntwo\"\n")
    (tmp_path / "c.txt").write_text("no")
    frames = snapshots.scan_csv_folder(spark, str(tmp_path), quoted_newlines=True)
    assert set(frames) == {"A", "b"}
    assert rows(frames["A"]) == [("1", "Café", None), ("2", "NA", 'x, "y"')]
    assert rows(frames["b"]) == [("one\ntwo",)]


def test_replacing_a_version_is_idempotent(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "v1"), ("b", "v1")], "id string, dataset_version string")
    two = spark.createDataFrame([("c", "v2")], "id string, dataset_version string")
    for df, n in ((one, 2), (two, 1), (one, 2)):
        assert tables.replace_version(df, path) == n
    assert rows(snapshots.scan_entity(spark, path), "id", "dataset_version") == [("a", "v1"), ("b", "v1"), ("c", "v2")]
    pruned = snapshots.scan_snapshot(spark, path, "v2")
    assert rows(pruned, "id") == [("c",)]
    assert "PartitionFilters: [isnotnull(dataset_version" in pruned._jdf.queryExecution().toString()


def test_raw_tables(spark, tmp_path):
    df = spark.createDataFrame([("1",), ("2",)], "x string")
    assert tables.replace_tables({"a-b": df, "c": df}, str(tmp_path), "v1") == (["a_b", "c"], 4)


def test_an_empty_entity_is_readable(spark, tmp_path):
    df = spark.createDataFrame([], "id string, n int")
    assert tables.write_entities({"none": df}, str(tmp_path), "v1") == {"none": 0}
    back = snapshots.scan_snapshot(spark, f"{tmp_path}/none", "v1")
    assert back.count() == 0 and back.columns == ["id", "n", "dataset_version"]


def test_snapshots_with_other_columns(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.append_entities(spark.createDataFrame([("a", "v1")], "id string, dataset_version string"), path)
    tables.append_entities(spark.createDataFrame([("b", 1, "v2")], "id string, n int, dataset_version string"), path)
    assert rows(snapshots.scan_entity(spark, path), "id", "n") == [("a", None), ("b", 1)]


def test_versions_sort_by_date(spark):
    df = spark.createDataFrame([("ia12012025",), ("ia01012026",), ("ia12012025",)], "dataset_version string")
    listed = snapshots.list_versions(df).orderBy("version_date").collect()
    assert [(r.dataset_version, r.row_count) for r in listed] == [("ia12012025", 2), ("ia01012026", 1)]


def test_upsert_twice_changes_nothing_more(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, c string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", None, "w")], "k string, n int, c string")
    once = tables.upserted(old, new, ["k"], update=["n"])
    assert rows(once) == [("a", 1, "x"), ("b", 3, "y"), ("c", None, "w")]
    assert rows(tables.upserted(once, new, ["k"], update=["n"])) == rows(once)


def test_failed_retry_does_not_demote(spark, rows):
    schema = "v string, status string, size int"
    held = spark.createDataFrame([("a", "success", 1), ("b", "failed", 1)], schema)
    retry = spark.createDataFrame([("a", "failed", 2), ("b", "success", 2)], schema)
    kept = tables.upserted(held, retry, ["v"], precedence=(F.col("status") == "success").cast("int"))
    assert rows(kept) == [("a", "success", 1), ("b", "success", 2)]


def test_insert_if_absent_takes_null_as_a_value(spark, rows):
    schema = "k string, v string, n int"
    held = spark.createDataFrame([("a", None, 1)], schema)
    new = spark.createDataFrame([("a", None, 2), ("a", "x", 3), ("a", "x", 4), (None, None, 5), (None, None, 6)], schema)
    assert rows(tables.absent_rows(held, new, ["k", "v"])) == [("a", "x", 3), (None, None, 5)]


def test_artifacts_skip_broken_documents(spark, tmp_path, rows):
    folder = tmp_path / "artifact_type=quality" / "dataset_version=2024"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"summary": {"quality_score": 0.9, "passed": 6, "failed": 1}}, indent=2))
    (folder / "b.json").write_text("{ not json")
    other = tmp_path / "artifact_type=schema_diff" / "dataset_version=2024"
    other.mkdir(parents=True)
    (other / "c.json").write_text(json.dumps({"missing": ["x"], "extra": []}, indent=2))
    got = files.scan_artifacts(spark, str(tmp_path), one_per_file=True)
    assert rows(got, "artifact_type", "dataset_version", "summary.passed", F.size("missing")) == [
        ("quality", "2024", 6, None), ("schema_diff", "2024", None, 1)]


def test_log(spark, tmp_path, rows):
    (tmp_path / "l.log").write_text("t1 | INFO | EXEC|op|0.5s|SUCCESS\nbad line\nt2 | INFO | a | b\n")
    assert rows(files.scan_log(spark, str(tmp_path / "l.log"))) == [("t1", "INFO", "EXEC|op|0.5s|SUCCESS"), ("t2", "INFO", "a | b")]


def test_filings(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Organization CRD#,Latest ADV Filing Date,Form Version\n123,2025-12-31,1A\n,2025-12-31,1A\n9,soon,\n")
    got = files.filings(snapshots.scan_csv(spark, str(tmp_path))).collect()
    assert [(r.firm_id, str(r.filing_date)[:10], r.form_version) for r in got] == [("123", "2025-12-31", "1A")]


def test_fingerprint(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y,z",w\n1,2,3\n4,5,6\n')
    one = files.fingerprint(spark, str(tmp_path)).first()
    assert (one.file_name, one.row_count, one.column_names, one.column_count) == ("a.csv", 2, ["x", "y,z", "w"], 3)
    (tmp_path / "a.csv").write_text('x,"y,z",w\n1,2,3\n4,5,7\n')
    assert files.fingerprint(spark, str(tmp_path)).first().file_hash != one.file_hash
    assert files.dataset_fingerprint(files.fingerprint(spark, str(tmp_path))).first().table_count == 1


def test_history_csv(spark, tmp_path):
    df = spark.createDataFrame([("v", "2023-01-01", "success", None, None), ("w", "2023-01-02", "failed", 5, 0.5)],
                               "dataset_version string, download_timestamp string, status string, file_size bigint, quality_score double")
    tables.write_history_csv(df, str(tmp_path / "h"))
    got = sorted(tuple(r) for r in snapshots.scan_csv(spark, str(tmp_path / "h")).collect())
    assert got == [("v", "2023-01-01", "success", "0", "N/A"), ("w", "2023-01-02", "failed", "5", "0.5")]


def test_json_keeps_nulls(spark, tmp_path):
    tables.write_json(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":"a","v":null}']


def test_arrivals_are_taken_once(spark, tmp_path):
    for version, body in (("ia07012026", "x\n1\n2\n"), ("ia08012026", "x\n3\n")):
        folder = tmp_path / "in" / version
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text(body)
        for _ in range(2):
            load_arrivals(spark, f"{tmp_path}/in/*", ["x"], f"{tmp_path}/t", f"{tmp_path}/p")
    got = sorted((r.x, r.dataset_version) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == [("1", "ia07012026"), ("2", "ia07012026"), ("3", "ia08012026")]


def test_arrivals_lose_no_row_and_shift_no_column(spark, tmp_path):
    for folder, body in (("ia07012026", "x,y\n1,2\n3\n4,5,6\n"), ("undated", "x,y\n7,8\n")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "f.csv").write_text(body)
    load_arrivals(spark, f"{tmp_path}/in/*", ["x", "y"], f"{tmp_path}/t", f"{tmp_path}/p")
    got = sorted((r.dataset_version, r._wrong_row or f"{r.x},{r.y}") for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == [("ia07012026", "1,2"), ("quarantine", "3"), ("quarantine", "4,5,6"), ("quarantine", "7,8")]
    (tmp_path / "in" / "ia08012026").mkdir()
    (tmp_path / "in" / "ia08012026" / "g.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="g.csv"):
        load_arrivals(spark, f"{tmp_path}/in/*", ["x", "y"], f"{tmp_path}/t", f"{tmp_path}/p")


def test_files_of_a_folder_keep_their_own_headers(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,name\n1,one\n")
    (tmp_path / "b.csv").write_text("name,extra,id\ntwo,x,2\n")
    got = snapshots.scan_csv_union(spark, str(tmp_path))
    assert rows(got, "id", "name", "extra", "source_file") == [("1", "one", None, "a"), ("2", "two", "x", "b")]


def test_an_empty_reload_empties_the_version(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    two = spark.createDataFrame([("a", "v1"), ("b", "v2")], "id string, dataset_version string")
    tables.replace_version(two, path)
    assert tables.replace_version(two.filter("id = 'x'"), path, version="v1") == 0
    assert rows(snapshots.scan_entity(spark, path), "id", "dataset_version") == [("b", "v2")]
    assert tables.replace_version(two.filter("id = 'a'"), path, version="v1") == 1
    assert snapshots.scan_entity(spark, path).count() == 2


def test_shared_folder_is_stable_and_named_by_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    cut = materialise(spark.range(3))
    assert cut.count() == 3 and "Range" not in cut._jdf.queryExecution().toString()


def test_scratch_is_the_applications_own_and_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    (tmp_path / "other").mkdir()
    cut = session.materialise(spark.range(3))
    assert cut.count() == 3 and (tmp_path / spark.sparkContext.applicationId).is_dir()
    assert session.clear_scratch(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_publishing_twice(spark, tmp_path, rows):
    """Facts are replaced, what people edit is kept."""
    root = str(tmp_path)
    firms = spark.createDataFrame([("a", "v1", "A")], "firm_id string, dataset_version string, name string")
    outreach = spark.createDataFrame([("a", "v1", "NOT_RESEARCHED")], "firm_id string, dataset_version string, status string")
    tables.publish({"firms": firms}, {"outreach_targets": outreach}, root)
    edited = outreach.withColumn("status", F.lit("CONTACTED"))
    tables.replace_version(edited, f"{root}/outreach_targets")
    more = outreach.unionByName(spark.createDataFrame([("b", "v1", "NOT_RESEARCHED")], outreach.schema))
    counts = tables.publish({"firms": firms.withColumn("name", F.lit("A2"))}, {"outreach_targets": more}, root)
    assert counts == {"firms": 1, "outreach_targets": 1}
    assert rows(spark.read.parquet(f"{root}/firms"), "firm_id", "name") == [("a", "A2")]
    assert rows(spark.read.parquet(f"{root}/outreach_targets"), "firm_id", "status") == [("a", "CONTACTED"), ("b", "NOT_RESEARCHED")]


def test_bucketed_snapshots_join_without_a_shuffle(spark, tmp_path, rows):
    from snaplake.operators.diff import key_changes

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, n in (("snap_old", 50), ("snap_new", 60)):
            df = spark.range(n).select(F.col("id").alias("firm_id"), (F.col("id") % 7).alias("x"))
            tables.save_bucketed(df, name, ["firm_id"], 4, str(tmp_path / name))
        changes = key_changes(spark.table("snap_old"), spark.table("snap_new"), ["firm_id"])
        assert changes.count() == 60
        assert "Exchange hashpartitioning" not in changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS snap_old")
        spark.sql("DROP TABLE IF EXISTS snap_new")


def test_files_of_one_header_are_one_scan(spark, tmp_path, rows):
    for i in range(60):
        head, cells = [("id,name", f"{i},n"), ("name,id,extra", f"n,{i},e"), ("id", f"{i}")][i % 3]
        (tmp_path / f"part {i}.csv").write_text(f"{head}\n{cells}\n")
    (tmp_path / "empty.csv").write_text("")
    df = snapshots.scan_csv_union(spark, str(tmp_path))
    assert plan_text(df).split("== Optimized")[0].count("Relation [") <= 2 * 3
    got = rows(df, "id", "name", "extra", "source_file")
    assert len(got) == 60 and ("0", "n", None, "part 0") in got and ("1", "n", "e", "part 1") in got and ("2", None, None, "part 2") in got
