"""Column profiles of versions that are stored small and merged for any set of versions.

A version is read once.  For each column there is one row with counts, bounds, a sketch of
its distinct values and, for numbers, one of their distribution; both sketches are
mergeable, so what many versions hold together is answered from a few kilobytes per column
and version, without reading one of them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.sources.snapshots import VERSION

#: Precision of the sketches: log2 of the buckets of distinct values, and items of a distribution.
SKETCH_LOG_K, SKETCH_ITEMS = 12, 400
QUARTILES = (0.25, 0.5, 0.75)


def column_sketches(df: DataFrame, version: str) -> DataFrame:
    """(column_name, dataset_version, total_rows, null_count, low, high, distinct_sketch, quantile_sketch), one row per column.

    low and high are those of a column of numbers.
    """
    fields = [f for f in df.schema.fields if f.name != VERSION]
    found = []
    for i, f in enumerate(fields):
        cell, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        # Both zeros are one value.
        value = (cell + F.lit(0)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else cell
        amount = F.when(~F.isnan(cell.cast("double")), cell.cast("double")) if number else F.lit(None).cast("double")
        found += [
            F.count(cell).alias(f"n{i}"), F.hll_sketch_agg(value.cast("string"), F.lit(SKETCH_LOG_K)).alias(f"d{i}"),
            F.min(amount).alias(f"low{i}"), F.max(amount).alias(f"high{i}"),
            F.kll_sketch_agg_double(amount, F.lit(SKETCH_ITEMS)).alias(f"q{i}") if number else F.lit(None).cast("binary").alias(f"q{i}"),
        ]
    whole = df.agg(F.count(F.lit(1)).alias("total"), *found)
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(version).alias(VERSION), F.col("total").alias("total_rows"),
            (F.col("total") - F.col(f"n{i}")).alias("null_count"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"),
            F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("quantile_sketch"),
        ) for i, f in enumerate(fields)
    ])
    return whole.select(F.inline(rows))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """What the versions in ``sketches`` hold together: one row per column.

    column_name, versions, total_rows, null_count, completeness_pct, distinct_estimate, low, high, lower_quartile, median, upper_quartile.
    """
    joined = sketches.groupBy("column_name").agg(
        F.countDistinct(VERSION).alias("versions"), F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"),
        F.hll_union_agg("distinct_sketch").alias("_distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double(F.when(F.col("low").isNotNull(), F.col("quantile_sketch"))).alias("_quantiles"),
    )
    quantile = lambda share: F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("_quantiles", F.lit(share)))
    return joined.select(
        "column_name", "versions", "total_rows", "null_count",
        F.round(F.try_divide(F.col("total_rows") - F.col("null_count"), F.col("total_rows")) * 100, 2).alias("completeness_pct"),
        F.hll_sketch_estimate("_distinct").alias("distinct_estimate"), "low", "high",
        *[quantile(q).alias(name) for q, name in zip(QUARTILES, ("lower_quartile", "median", "upper_quartile"))],
    )
