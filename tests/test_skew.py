"""Skew-safe operators against their plain forms, with hot keys and small limits."""

import random

import pytest
from conftest import plan_text
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snaplake.operators import skew
from snaplake.operators.lineage import ancestry, lineage_of


@pytest.fixture
def hot(spark):
    """A third of the rows on one key, some NULL keys, identical copies."""
    rng = random.Random(7)
    data = [(1 if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(2, 3000), "copy" if i % 3 == 0 else f"r{i}")
            for i in range(6000)]
    return spark.createDataFrame(data, "k int, v string").repartition(6)


@pytest.fixture
def always_shuffled(spark):
    """Joins shuffle, and partitions of a few kilobytes count as too large."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("has_hot", [True, False])
@pytest.mark.parametrize("budget", [100, 1_000_000])
def test_lookup_join_equals_plain_join(spark, hot, rows, always_shuffled, monkeypatch, how, has_hot, budget):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", budget)
    monkeypatch.setattr(skew, "needs_no_spread", lambda *a: False)
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(0 if has_hot else 2, 2000)], "k int, name string")
    if how in ("left_semi", "left_anti"):
        lookup = lookup.unionByName(lookup)
    got = skew.lookup_join(hot.repartition(5, "k"), lookup, ["k"], how)
    assert rows(got) == rows(hot.join(lookup, ["k"], how).select(*got.columns))


def test_no_task_gets_all_of_a_hot_key(spark, always_shuffled, monkeypatch):
    """Rows that were shuffled by their key before lie in one task; the join spreads them."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(skew, "needs_no_spread", lambda *a: False)
    given = spark.range(3000).select(F.lit(1).alias("k"), "id").repartition(40, "k")
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(2000)], "k int, name string")
    # What runs behind the join runs in the join's own tasks.
    tasks = skew.lookup_join(given, lookup, ["k"]).select(F.spark_partition_id().alias("task")).collect()
    most = max(tasks.count(t) for t in set(tasks))
    assert len(tasks) == 3000 and most <= 900


@pytest.mark.parametrize("name", [
    "fk_composite", "anti_broken_refs", "transitions", "version_links", "dossier", "lineage_integrity", "register_check", "percentile_score",
])
def test_queries_with_small_budgets(spark, monkeypatch, name):
    from __spark_entry__ import oracle_sql, queries
    from check_oracle import compare, connect

    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(skew, "needs_no_spread", lambda *a: False)
    folder = "/root/testdata/sf0.001"
    assert compare(connect(folder), queries()[name](spark, folder), oracle_sql()[name]) is None


def test_lookup_join_leaves_the_size_to_the_planner(spark, hot):
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(200)], "k int, name string")
    text = plan_text(skew.lookup_join(hot, lookup, ["k"]))
    # The only hint is on the bounded table of hot keys.
    assert "MOST_HOT" not in text and text.split("== Analyzed Logical Plan ==")[1].split("==")[0].count("ResolvedHint") == 2


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_tie_percentile_equals_definition(spark, monkeypatch, bucket):
    monkeypatch.setattr(skew, "BUCKET_VALUES", bucket)
    rng = random.Random(3)
    values = [0.0] * 200 + [round(rng.gauss(0, 5), 1) for _ in range(400)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    got = {r.id: r.p for r in skew.with_tie_percentile(df, "x", "p").collect()}
    present = [v for v in values if v is not None]
    for i, v in enumerate(values):
        if v is None:
            assert got[i] is None
        else:
            below, ties = sum(p < v for p in present), sum(p == v for p in present)
            assert got[i] == pytest.approx((below + (ties + 1) / 2) / len(present))


def test_tie_percentile_of_four(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "x double")
    assert sorted(r.p for r in skew.with_tie_percentile(df, "x", "p").collect()) == [0.25, 0.625, 0.625, 1.0]


def test_no_task_sorts_all_values(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKET_VALUES", 7)
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    windows = [t for t in plan_text(skew.value_positions(df, "x")[0]).split("== Physical Plan ==")[1].splitlines() if "Window [" in t]
    assert any("sum(n" in t and "_bucket" in t for t in windows)


@pytest.mark.parametrize("n", [1, 2, 101, 200])
def test_exact_median(spark, monkeypatch, n):
    monkeypatch.setattr(skew, "BUCKET_VALUES", 9)
    rng = random.Random(n)
    values = sorted(rng.choice([0.0, rng.uniform(-9, 9)]) for _ in range(n))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    middle = (values[(n - 1) // 2] + values[n // 2]) / 2
    assert skew.exact_median(df, "x").first()["median"] == pytest.approx(middle)


@pytest.mark.parametrize("partition", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 8, 50])
def test_neighbours_equal_a_window(spark, rows, partition, ranges):
    """A hot key, a hot instant, NULL keys, NULL values, and ids that no double can tell apart."""
    rng = random.Random(11)
    data = []
    for i in range(3000):
        key = 1 if i % 3 == 0 else None if i % 40 == 1 else rng.randrange(2, 30)
        second = 500 if i % 3 == 1 else rng.randrange(1000)
        data.append((key, second, 2**60 + i, None if i % 17 == 0 else rng.choice("abc")))
    df = spark.createDataFrame(data, "k int, s int, id bigint, v string").withColumn("ts", F.timestamp_seconds("s"))
    by = W.partitionBy(*(partition or [F.lit(1)])).orderBy("ts", "id")
    want = df.withColumns({"old": F.lag("v").over(by), "new": F.lead("v").over(by)})
    got = skew.with_neighbours(df, partition, ("ts", "id"), F.col("v"), "old", "new", ranges)
    assert rows(got, "id", "old", "new") == rows(want, "id", "old", "new")


def test_neighbours_by_text_ids_and_of_nothing(spark, rows):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id string, v int")
    assert rows(skew.with_neighbours(df, [], ["id"], F.col("v"), "old", "new")) == [("a", 2, None, 1), ("b", 1, 2, 3), ("c", 3, 1, None)]
    assert skew.with_neighbours(df.limit(0), [], ["id"], F.col("v"), "old").count() == 0


def test_no_window_holds_a_hot_key(spark):
    df = spark.range(4000).select(F.timestamp_seconds("id").alias("ts"), "id", F.lit(1).alias("k"))
    got = skew.with_neighbours(df, ["k"], ("ts", "id"), F.col("id"), "near", ranges=8)
    windows = [t for t in plan_text(got).split("== Physical Plan ==")[1].splitlines() if "Window [" in t]
    assert any("_range" in t.split("], [")[1] for t in windows)


def test_newest_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    newest = skew.newest_per_key(df, ["k"], [F.col("id").desc()])
    assert sorted(r.id for r in newest.collect()) == [97, 98, 99]
    assert "WindowGroupLimit" in plan_text(newest) and "Partial" in plan_text(newest)


def test_ancestry_of_a_chain_and_a_star(spark, rows):
    chain = [(i, i - 1 if i else None) for i in range(20)]
    star = [(100 + i, 19) for i in range(50)]
    df = spark.createDataFrame(chain + star + [(500, 999)], "id bigint, parent bigint")
    pairs = ancestry(df)
    parents = {i: p for i, p in chain + star}
    want = []
    for i in parents:
        at, distance = parents[i], 1
        while at is not None:
            want.append((i, at, distance))
            at, distance = parents[at], distance + 1
    assert rows(pairs) == sorted(want, key=repr)
    asked = spark.createDataFrame([(18,), (2,), (2,), (777,), (500,)], "v bigint")
    both = want + [(i, i, 0) for i in [*parents, 500]]
    wanted = [(a, i, d) for x, y, d in both for a, i, d in {(x, y, -d), (y, x, d)} if a in (18, 2, 500)]
    assert rows(lineage_of(df, asked)) == sorted(wanted, key=repr)


def test_lineage_of_a_long_chain(spark):
    chain = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = lineage_of(chain, spark.range(70_000, 70_001))
    got = found.agg(F.count("id"), F.min("distance"), F.max("distance"), F.countDistinct("id"), F.sum(F.col("id") - F.col("distance"))).first()
    assert tuple(got) == (100_000, -70_000, 29_999, 100_000, 70_000 * 100_000)


def test_ancestry_refuses_a_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id bigint, parent bigint")
    with pytest.raises(ValueError):
        ancestry(df)
    with pytest.raises(ValueError):
        lineage_of(df, spark.range(1, 2))


def test_positions_by_force(spark, rows):
    data = [(k, i % 7 if k != 3 else None, f"t{i % 5}") for i, k in enumerate([None, 1, 3, 3, 3, 3, 2, 1, 3, 3] * 20)]
    df = spark.createDataFrame(data, "k int, o int, t string")
    got = skew.with_positions(df, ["k"], ["o", "t"], "place", ranges=5)
    none_first = lambda x: (x is not None, x)
    want = []
    for key in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == key), key=lambda r: (none_first(r[1]), r[2]))
        want += [(*r, i) for i, r in enumerate(own)]
    assert rows(got) == sorted(want, key=repr)
    assert rows(skew.with_positions(df, [], ["k", "o", "t"], "place", ranges=4), "place") == sorted([(i,) for i in range(len(data))], key=repr)
    assert skew.with_positions(df.limit(0), ["k"], ["o"], "place").count() == 0


def test_lookup_takes_known_counts_and_planned_sizes(spark, rows, monkeypatch):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k int, v int")
    lookup = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    plain = rows(skew.lookup_join(df, lookup, ["k"]))
    assert skew.needs_no_spread(spark.range(50).withColumn("k", F.lit(1)), lookup)
    assert not skew.needs_no_spread(spark.range(10**9), lookup)
    monkeypatch.setattr(skew, "needs_no_spread", lambda *a: False)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    counts = df.groupBy("k").count().withColumnRenamed("count", "n")
    assert rows(skew.lookup_join(df, lookup, ["k"], counts=counts)) == rows(skew.lookup_join(df, lookup, ["k"])) == plain
