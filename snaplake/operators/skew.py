"""Joins, ranks and neighbours that hold when one key has a third of all rows.

Nothing here drops or samples rows.  Small sides are broadcast only where
their size is bounded by construction, and the bound is stated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snaplake.session import materialise, materialise_counted, release

# Rows of one key that a task of a join should get at most, and how many keys may have more.
ROWS_PER_TASK = 1_000_000
MOST_HOT = 100_000
# Values one rank bucket should hold; a bucket is sorted inside one task.
BUCKET_VALUES = 250_000
MAX_BUCKETS = 10_000


def hot_salts(rows: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(_hot, _salts): hash of each key with more than ``ROWS_PER_TASK`` rows, and over how many tasks to spread it.

    Rows are counted per key map-side first, unless ``counts`` (the keys and
    ``n``) already knows.  There are at most ``MOST_HOT`` rows of two numbers,
    whatever the table holds, so the result may be broadcast.  Keys beyond that
    are joined like the others, only not spread.
    """
    if counts is None:
        counts = rows.select(F.xxhash64(*keys).alias("_hot")).groupBy("_hot").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = counts.select(F.xxhash64(*keys).alias("_hot"), F.col("n").alias("_n"))
    hot = counts.filter(F.col("_n") > ROWS_PER_TASK).orderBy(F.desc("_n"), "_hot").limit(MOST_HOT)
    return hot.select("_hot", F.ceil(F.col("_n") / ROWS_PER_TASK).cast("int").alias("_salts"))


def _planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def needs_no_spread(rows: DataFrame, lookup: DataFrame) -> bool:
    """Whether no key of ``rows`` can overload a task of the join, by the planner's own sizes.

    Rows that one task may read cannot be too many for the task that joins them,
    and a lookup small enough for the planner to broadcast shuffles no row.
    """
    conf = rows.sparkSession._jsparkSession.sessionState().conf()
    return _planned_bytes(rows) <= conf.filesMaxPartitionBytes() or _planned_bytes(lookup) <= conf.autoBroadcastJoinThreshold()


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", counts: DataFrame | None = None
) -> DataFrame:
    """Many-to-one equi-join; ``how`` is left, inner, left_semi or left_anti.

    For left and inner the lookup has one row per key; for the other two it
    may repeat keys, which are combined map-side first.  The planner sizes the
    join by bytes, and where its sizes rule out an overloaded task the join
    stays as it is.  Else a key with more rows than a task should get is spread:
    its lookup row is copied for each salt, and its rows are salted by a hash of
    all their columns, which does not depend on where they lie and is the same
    when a lost task is repeated.  Salts are part of the join keys, so a join
    that shuffles shuffles anew, and equal rows of one key, which share a salt,
    can still be split by adaptive execution if they come from several tasks.
    ``counts`` (the keys and ``n``) saves counting the rows per key.
    """
    keys = list(keys)
    payload = [c for c in lookup.columns if c not in keys] if how in ("left", "inner") else []
    lookup = lookup.select(*keys, *payload)
    if how not in ("left", "inner"):
        lookup = lookup.distinct()
    if needs_no_spread(rows, lookup):
        return rows.join(lookup, keys, how).select(*rows.columns, *payload)
    hot = F.broadcast(hot_salts(rows, keys, counts))
    salts = F.coalesce("_salts", F.lit(1))
    named = [*keys, "_salt"]
    salted = rows.withColumn("_hot", F.xxhash64(*keys)).join(hot, "_hot", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")
    )
    copied = lookup.withColumn("_hot", F.xxhash64(*keys)).join(hot, "_hot", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return salted.join(copied.select(*named, *payload), named, how).select(*rows.columns, *payload)


def _bounds(df: DataFrame, columns: Sequence[str], buckets: int) -> list[list[float]]:
    if buckets < 2:
        return [[] for _ in columns]
    shares = [i / buckets for i in range(1, buckets)]
    return [sorted(set(b)) for b in df.stat.approxQuantile(list(columns), shares, 1 / (4 * buckets))]


def _bucketed(df: DataFrame, column: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Number of bounds at or below the value.  Bounds are plan constants."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *bounds, math.inf]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)


def value_positions(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """Distinct values with their count, the rows below them and all rows.

    Returns (positions, number of distinct values); positions has the columns
    value, n, below and total.  ``df`` is read once: rows are counted
    per value, so a hot value is one row, and the counts are written.
    Quantiles of the *distinct* values then cut them into even ranges, a
    running sum runs inside each range, and the at most MAX_BUCKETS range
    totals are summed in front of it.  No task ever sorts all values.
    """
    counts, seen = materialise_counted(
        df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), distinct=F.count(F.lit(1))
    )
    distinct = seen["distinct"]
    buckets = min(MAX_BUCKETS, math.ceil(distinct / BUCKET_VALUES))
    (bounds,) = _bounds(counts, [value], buckets)
    ranged = _bucketed(counts.withColumn("_v", F.col(value).cast("double")), "_v", bounds, "_bucket")
    # One row per range: at most MAX_BUCKETS.
    offsets = (
        ranged.groupBy("_bucket")
        .agg(F.sum("n").alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n"))
        .withColumn("total", F.sum("_n").over(W.partitionBy(F.lit(1))))
        .drop("_n")
    )
    inside = F.sum("n").over(W.partitionBy("_bucket").orderBy(value)) - F.col("n")
    positions = ranged.join(F.broadcast(offsets), "_bucket").select(
        value, "n", (F.col("_before") + inside).alias("below"), "total"
    )
    return positions, distinct


def with_tie_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile rank with ties averaged; NULL values get NULL."""
    positions, _ = value_positions(df, value)
    ranks = positions.select(value, ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(out))
    return lookup_join(df, ranks, [value], counts=positions)


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row with the exact median, by position rather than by one big sort."""
    p, _ = value_positions(df, value)
    last = F.col("below") + F.col("n")
    lower = F.floor((F.col("total") - 1) / 2)
    upper = F.floor(F.col("total") / 2)
    covers = lambda pos: (F.col("below") <= pos) & (pos < last)
    return p.agg(
        (
            (F.max(F.when(covers(lower), F.col(value).cast("double")))
             + F.max(F.when(covers(upper), F.col(value).cast("double")))) / 2
        ).alias("median")
    )


def with_neighbours(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column,
    before: str | None = None, after: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """``lag(value)`` as ``before`` and ``lead(value)`` as ``after``, in the given order.

    ``order`` are columns of any orderable types, unique together in a
    partition.  A window by key would sort all rows of a hot key (or of the
    whole table when ``partition`` is empty) in one task.  Rows are therefore
    cut into even ranges of (key, order), by the columns themselves, and the
    ranges are written once, so that they stay what they are when a task is
    repeated.  A key that goes on in the next range gets one extra row at its
    edge that carries the value from beyond; one window over (range, key) then
    serves both directions.  A key has at most one edge row for each range.
    """
    partition, order = list(partition), list(order)
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        df.repartitionByRange(ranges, *partition, *order).withColumns({
            "_range": F.spark_partition_id(), "_value": F.struct(value.alias("v")), "_at": F.lit(1),
        })
    )
    spots = ["_range", *partition]
    place = F.struct(*order)
    edges = ranged.groupBy(*spots).agg(F.min_by("_value", place).alias("_first"), F.max_by("_value", place).alias("_last"))
    # One row per (key, range).
    along = W.partitionBy(*(partition or [F.lit(1)])).orderBy("_range")
    edges = edges.withColumns({"_before": F.lag("_last").over(along), "_after": F.lead("_first").over(along)})
    beyond = edges.select(*spots, F.inline(F.array(
        F.struct(F.col("_before").alias("_value"), F.lit(0).alias("_at")), F.struct(F.col("_after").alias("_value"), F.lit(2).alias("_at")),
    ))).filter("_value IS NOT NULL")
    near = W.partitionBy(*spots).orderBy("_at", *order)
    found = {"_before": F.lag("_value").over(near), "_after": F.lead("_value").over(near)}
    named = [F.col(f"{c}.v").alias(out) for c, out in (("_before", before), ("_after", after)) if out]
    rows = ranged.unionByName(beyond, allowMissingColumns=True).withColumns(found).filter("_at = 1")
    return rows.select(*df.columns, *named)


def with_positions(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], out: str, ranges: int | None = None, amount: Column | None = None
) -> DataFrame:
    """The place of every row of a key in the given order, from 0, as ``out``; with ``amount``, the sum of it over the rows before.

    A row number by key would sort all rows of a hot key in one task.  Rows are
    cut into even ranges of (key, order) and written; the rows of a key in the
    ranges before, summed over at most one row per (key, range), are added to
    the number inside a range.  NULL comes first and is a key like any
    other.  Rows that are equal in all these columns take their places in any
    order; where they lie spreads them over the ranges.
    """
    partition, order = list(partition), list(order)
    amount = F.lit(1).cast("long") if amount is None else amount.cast("long")
    kept, seen = materialise_counted(
        df.withColumns({"_tie": F.monotonically_increasing_id(), "_amount": amount}), rows=F.count(F.lit(1))
    )
    ranges = ranges or max(1, math.ceil(seen["rows"] / BUCKET_VALUES))
    ranged = materialise(kept.repartitionByRange(ranges, *partition, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    release(kept)
    spots = ["_range", *partition]
    before = W.partitionBy(*(partition or [F.lit(1)])).orderBy("_range")
    sizes = ranged.groupBy(*spots).agg(F.sum("_amount").alias("_n")).select(
        *[F.col(c).alias(f"_of{i}") for i, c in enumerate(spots)], (F.sum("_n").over(before) - F.col("_n")).alias("_before")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(spots)]
    inside = F.sum("_amount").over(W.partitionBy(*spots).orderBy(*order, "_tie")) - F.col("_amount")
    return ranged.join(sizes, same).select(*df.columns, (F.col("_before") + inside).alias(out))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order.

    Spark keeps one row per key on the map side already (window group limit),
    so a hot key sends one row per input partition.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
