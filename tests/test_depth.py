"""Inclusion dependencies, file-wise upserts, hash trees of files, stored pages and searches."""

import os
import random
from hashlib import sha256

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from snaplake import session
from snaplake.operators import diff, inclusion, lineage, profile, serve, sketches
from snaplake.session import materialise, materialise_counted, release
from snaplake.sinks import copy_on_write as cow
from snaplake.sinks import directories, tables
from snaplake.sources import files


# ------------------------------------------------------------- dependencies
@pytest.mark.parametrize("sampled", [64, 1])
def test_dependencies_by_force(spark, monkeypatch, sampled):
    monkeypatch.setattr(inclusion, "SAMPLED", sampled)
    rng = random.Random(3)
    data = {
        "a": [(i, rng.choice([None, i % 5]), f"x{i % 7}", None) for i in range(200)],
        "b": [(i, i % 3, f"x{i % 9}", float(i % 4)) for i in range(50, 150)],
        "c": [(None, 7, "x1", 0.0), (3, 7, "x2", -0.0)],
    }
    tables_ = {t: spark.createDataFrame(rows, "k int, g int, s string, f double").withColumn("list", F.array("k")) for t, rows in data.items()}
    columns = {(t, c): [r[i] for r in rows] for t, rows in data.items() for i, c in enumerate("kgsf")}
    text = lambda v: str(abs(v)) if isinstance(v, float) else str(v)
    want = set()
    for one, own in columns.items():
        for two, other in columns.items():
            mine = {text(v) for v in own if v is not None}
            if one != two and mine and mine <= {text(v) for v in other if v is not None}:
                want.add((*one, *two, len(mine), None not in other and len(set(other)) == len(other)))
    assert {tuple(r) for r in inclusion.inclusion_dependencies(tables_).collect()} == want
    keys = {tuple(r) for r in inclusion.foreign_keys(tables_).collect()}
    assert keys == {w[:5] for w in want if w[5] and w[0] != w[2]}


def test_dependencies_of_empty_columns(spark):
    none = spark.createDataFrame([(None,)], "k int")
    assert inclusion.inclusion_dependencies({"a": none, "b": spark.range(3).withColumnRenamed("id", "k")}).count() == 0


# ----------------------------------------------------------- files of a table
@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("a").alias("note"))
    cow.upsert_files(rows, root, ["k"], file_rows=1000)
    return root, rows


def names(spark, root):
    return {r["file"] for r in cow.manifest(spark, root).collect()}


def test_an_upsert_rewrites_only_the_files_it_changes(spark, stored, rows):
    root, first = stored
    before = names(spark, root)
    assert len(before) == 10
    new = spark.range(2010, 2110).select(F.col("id").alias("k"), F.lit(99).cast("long").alias("v"), F.lit("b").alias("note"))
    done = cow.upsert_files(new, root, ["k"], ["v"])
    assert done == {"changed": 100, "inserted": 0, "removed": 0, "files": done["files"]} and done["files"] <= 2
    assert len(before - names(spark, root)) == done["files"]
    want = first.join(new.select("k", F.col("v").alias("w")), "k", "left").select("k", F.coalesce("w", "v").alias("v"), "note")
    assert rows(cow.read_files(spark, root)) == rows(want)
    # The state before is still whole.
    assert rows(cow.read_files(spark, root, 1)) == rows(first)


def test_nothing_changes_nothing_is_written(spark, stored):
    root, first = stored
    assert cow.upsert_files(first.where("k % 3 = 0"), root, ["k"]) == {"changed": 0, "inserted": 0, "removed": 0, "files": 0}
    assert cow.states(spark, root) == [1]
    assert cow.upsert_files(first.limit(0), root, ["k"])["inserted"] == 0


def test_inserts_add_files_and_removals_rewrite_theirs(spark, stored, rows):
    root, first = stored
    before = names(spark, root)
    new = spark.createDataFrame([(20_000, 1, "x"), (20_000, 2, "y"), (5, 50, "z")], "k long, v long, note string")
    assert cow.upsert_files(new, root, ["k"], [])["inserted"] == 1
    assert before < names(spark, root)
    assert rows(cow.read_files(spark, root).where("k IN (5, 20000)")) == [(20000, 2, "y"), (5, 5, "a")]
    done = cow.upsert_files(new.limit(0), root, ["k"], replaced=F.col("k") >= 20_000)
    assert done["removed"] == 1 and rows(cow.read_files(spark, root)) == rows(first)
    assert cow.drop_old_states(spark, root) >= 1
    assert rows(cow.read_files(spark, root)) == rows(first) and len(cow.states(spark, root)) == 1


def test_no_task_writes_or_reads_a_whole_table(spark, tmp_path):
    """Files are sorted, written and read one by a task, so a table of more than a million rows has several."""
    root = str(tmp_path / "table")
    cow.upsert_files(spark.range(1_200_000).withColumnRenamed("id", "k"), root, ["k"])
    sizes = [r["rows"] for r in cow.manifest(spark, root).collect()]
    assert sum(sizes) == 1_200_000 and len(sizes) > 1 and max(sizes) < 700_000


def test_precedence_and_a_failed_change(spark, stored, rows):
    root, first = stored
    low = spark.createDataFrame([(1, -5, "low"), (2, 77, "high")], "k long, v long, note string")
    cow.upsert_files(low, root, ["k"], precedence=F.col("v"))
    assert rows(cow.read_files(spark, root).where("k < 3")) == [(0, 0, "a"), (1, 1, "a"), (2, 77, "high")]
    # Files without a complete manifest are no state.
    first.limit(1).write.parquet(f"{root}/data/000000009")
    assert cow.states(spark, root) == [1, 2] and cow.read_files(spark, root).count() == 10_000


def test_an_empty_table_keeps_its_columns(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    empty = spark.createDataFrame([], "k long, v string")
    cow.upsert_files(empty, root, ["k"])
    assert cow.read_files(spark, root).columns == ["k", "v"] and cow.read_files(spark, root).count() == 0
    cow.upsert_files(spark.createDataFrame([(1, "a")], "k long, v string"), root, ["k"])
    assert rows(cow.read_files(spark, root)) == [(1, "a")]


def test_refresh_queue_keeps_other_versions(spark, tmp_path, rows):
    root = str(tmp_path / "queue")
    queue = lambda *r: spark.createDataFrame(list(r), "firm_id string, action string, reasons array<string>")
    at = F.lit("2026-01-01").cast("timestamp")
    tables.save_refresh_queue(queue(("1", "A", ["x"]), ("2", "B", [])), root, "v1", at)
    tables.save_refresh_queue(queue(("1", "A", ["x"])), root, "v2", at)
    assert tables.save_refresh_queue(queue(("2", "C", ["y", "x"])), root, "v1", at)["removed"] == 1
    assert rows(cow.read_files(spark, f"{root}/queue"), "firm_id", "action", "dataset_version") == [("1", "A", "v2"), ("2", "C", "v1")]
    assert cow.read_files(spark, f"{root}/runs").count() == 2


# ------------------------------------------------------------- hashes of files
def tree_by_force(raw, chunk, fan=1024):
    lines = raw[:-1].split(b"\n") if raw.endswith(b"\n") else raw.split(b"\n")
    at, chunks = 0, {}
    for line in lines:
        chunks.setdefault(at // chunk, []).append(sha256(line).hexdigest())
        at += len(line) + 1
    level = [sha256("".join(c).encode()).hexdigest() for _, c in sorted(chunks.items())]
    while len(level) > 1:
        level = [sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return sha256(f"{len(raw)}:{level[0]}".encode()).hexdigest()


def test_hash_trees_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(1)
    given = {
        "a.csv": b"".join(bytes(rng.choices(b"abc\r,\xe9", k=rng.randrange(60))) + b"\n" for _ in range(3000)),
        "b 1+%.CSV": b"x,y\n1,2", "c.csv": b"", "d.csv": b"\n", "e.csv": b"x,y\r\n1,2\r\n", "skip.txt": b"no",
    }
    for name, raw in given.items():
        (tmp_path / name).write_bytes(raw)
    want = {n: tree_by_force(raw, 512) for n, raw in given.items() if n.lower().endswith("csv") and raw}
    read = lambda: {r["file_name"]: r["byte_hash"] for r in files.byte_hashes(spark, str(tmp_path), 512).collect()}
    assert read() == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "1500")
    try:
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
        assert tasks > 20 and read() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = files.dataset_bytes(files.byte_hashes(spark, str(tmp_path), 512)).first()["byte_hash"]
    (tmp_path / "e.csv").write_bytes(b"x,y\n1,2\n")
    assert files.dataset_bytes(files.byte_hashes(spark, str(tmp_path), 512)).first()["byte_hash"] != whole


def test_ordered_digest_is_a_tree(spark):
    texts = [sha256(str(i).encode()).hexdigest() for i in range(50)]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)] + [("one", 0, "t")], "k string, i int, d string")
    level = texts
    while len(level) > 1:
        level = [sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert {r["k"]: r["d"] for r in files.ordered_digest(df, ["k"], ["i"], "d", fan=4).collect()} == {"k": level[0], "one": "t"}


# ------------------------------------------------------- pages and searches
def test_a_deep_page_reads_one_range(spark, tmp_path, rows):
    path = str(tmp_path / "pages")
    df = spark.range(20_000).select(F.col("id").cast("string").alias("firm_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 97).alias("score"))
    for descending in (True, False):
        directories.save_pages(df, path, "score", descending=descending, rows=1000)
        for number in (1, 2, 150, 200, 201, 10_000):
            got = directories.read_page(spark, path, number, 100)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in serve.page(df, "score", number, 100, descending).collect()]
    assert spark.read.parquet(f"{path}/directory").count() == 20
    # One of the twenty folders is read.
    plan = plan_text(directories.read_page(spark, path, 150, 100))
    assert "_range#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    directories.save_pages(df.limit(0), path, "score")
    assert directories.read_page(spark, path, 1).count() == 0


def test_stored_search_equals_search_and_skips_ranges(spark, tmp_path, rows):
    path = str(tmp_path / "search")
    rng = random.Random(6)
    words = ["Ring", "green", "Ölpumpe", "x_y", "50%", "ab", "", "straße"]
    data = [(i, " ".join(rng.choices(words[1:], k=3)) if i != 777 else "the only needle", rng.choice([None, f"c{i}"])) for i in range(2000)]
    df = spark.createDataFrame(data, "firm_id int, name string, code string")
    columns = ("name", "code")
    directories.save_searchable(df, path, columns, ["firm_id"], rows=100)
    for text in ("NEEDLE", "needles", "ring", "gReEn öl", "ölpumpe", "x_y", "ab", "50%", "c19", "", None, "STRASSE", "e on"):
        assert rows(directories.search_stored(spark, path, text, columns)) == rows(serve.search(df, text, columns)), text
    assert len(directories.candidate_ranges(spark, path, "needle", columns)) == 1
    assert directories.candidate_ranges(spark, path, "ab", columns) is None
    assert directories.candidate_ranges(spark, path, "needles", columns) == []


# ------------------------------------------------------------ wide snapshots
def test_cells_by_hash_equal_cells_and_read_what_changed(spark, rows, monkeypatch):
    wide = [f"c{i}" for i in range(448)]
    old = spark.range(300).select(F.col("id").alias("k"), *[F.when((F.col("id") + i) % 5 > 0, F.col("id") * i).alias(c) for i, c in enumerate(wide)])
    hit = F.col("k") % 100 == 7
    new = old.withColumns({"c3": F.when(hit, F.lit(None)).otherwise(F.col("c3")), "c9": F.when(hit, F.lit(-1)).otherwise(F.col("c9"))}).where("k > 5")
    assert rows(diff.changed_keys(old, new, ["k"])) == [(107,), (207,), (7,)]
    assert rows(diff.cell_changes_by_hash(old, new, ["k"])) == rows(diff.cell_changes(old, new, ["k"]))
    # Two columns that trade a NULL differ.
    a, b = (spark.sql(f"SELECT 1 AS k, {x} AS x, {y} AS y") for x, y in (("5", "CAST(NULL AS INT)"), ("CAST(NULL AS INT)", "5")))
    assert diff.changed_keys(a, b, ["k"]).count() == 1


# ------------------------------------------------------------------ scratch
def test_release_deletes_what_was_written(spark):
    kept = materialise(spark.range(5))
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")

    assert os.path.isdir(path)
    release(kept, spark.range(3))
    assert not os.path.isdir(path)


def test_a_cluster_on_one_machine_is_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)}), Context

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


# ------------------------------------------------------------------ lineage
def test_intervals_by_force(spark):
    rng = random.Random(5)
    parents = {i: rng.choice([None, rng.randrange(i) if i else None, 10_000 + i]) if rng.random() < 0.2 else (rng.randrange(i) if i else None) for i in range(300)}
    parents |= {400 + i: 399 + i for i in range(1, 80)} | {400: None}
    df = spark.createDataFrame(list(parents.items()), "id long, parent long")
    got = {r["id"]: (r["begin"], r["size"], r["depth"]) for r in lineage.intervals(df).collect()}
    children, want = {}, {}
    for i, p in parents.items():
        children.setdefault(p if p in parents else None, []).append(i)

    def walk(i, at, depth):
        end = at + 1
        for c in sorted(children.get(i, [])):
            end = walk(c, end, depth + 1)
        want[i] = (at, end - at, depth)
        return end

    at = 0
    for root in sorted(children[None]):
        at = walk(root, at, 0)
    assert got == want
    assert lineage.intervals(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lineage.intervals(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long"))


def test_merged_sketches_answer_for_all_versions(spark):
    parts = [spark.range(1000 * i, 1000 * i + 5000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("v"), F.lit("x").alias("t"), F.lit(None).cast("double").alias("none")) for i in range(3)]
    stored = None
    for i, df in enumerate(parts):
        one = sketches.column_sketches(df.withColumn("dataset_version", F.lit(f"v{i}")), f"v{i}")
        stored = one if stored is None else stored.unionByName(one)
    got = {r["column_name"]: r for r in sketches.merged_profile(stored).collect()}
    assert set(got) == {"k", "v", "t", "none"}
    assert abs(got["k"]["distinct_estimate"] - 7000) < 500 and got["t"]["distinct_estimate"] == 1
    assert (got["k"]["low"], got["k"]["high"], got["k"]["total_rows"], got["v"]["null_count"]) == (0, 6999, 15000, 3750)
    assert abs(got["k"]["median"] - 3500) < 400 and got["none"]["median"] is None and got["none"]["distinct_estimate"] == 0
    two = sketches.merged_profile(stored.where("dataset_version <> 'v2'"))
    assert {r["versions"] for r in two.collect()} == {2}


def test_row_fingerprints_take_what_a_grouping_takes_as_equal(spark):
    rows_ = [(0.0, None, [1], {"a": 1, "b": 2}), (-0.0, None, [1], {"b": 2, "a": 1}), (None, 0.0, [], {}), (None, 0.0, None, {}), (float("nan"), 1.0, [1], None), (float("nan"), 1.0, [1], None)]
    df = spark.createDataFrame(rows_, "x double, y double, z array<int>, m map<string,int>")
    assert tuple(profile.row_uniqueness(df).first()) == (6, 4, 2)
    assert tuple(profile.row_uniqueness(df.limit(0)).first()) == (0, 0, 0)


def test_no_task_gets_all_ends_of_a_walk(spark, monkeypatch):
    """What has reached the end of the walk has no next element; a join by that would bring all of it to one task."""
    most = []

    def spied(df, **counts):
        kept, seen = materialise_counted(df, **counts)
        if "to" in kept.columns:
            ends = kept.where("to IS NULL").groupBy(F.input_file_name().alias("file")).count()
            most.append(max((r["count"] for r in ends.collect()), default=0))
        return kept, seen

    monkeypatch.setattr(lineage, "materialise_counted", spied)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(400).select("id", F.when(F.col("id") > 0, F.expr("(id - 1) div 3")).alias("parent"))
        assert lineage.intervals(df).count() == 400
    finally:
        for k in plain:
            spark.conf.unset(k)
    # Of 800 elements about half end before the last round.
    assert len(most) > 8 and max(most) < 300
