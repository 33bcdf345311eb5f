"""Stored tables that answer one page or one search without reading the rest.

Both are the rows in even ranges, one folder for each range, and a small table beside them:
how many rows lie before each range, or which letter triples a range holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snaplake.operators.serve import PAGE_SIZES, search
from snaplake.session import materialise_counted

RANGE_ROWS = 250_000


def _in_ranges(df: DataFrame, path: str, order: Sequence[Column | str], rows: int) -> DataFrame:
    """Write ``df`` in ranges of about ``rows`` rows and read it again; the range is a folder, so filters on it prune."""
    kept, seen = materialise_counted(df, rows=F.count(F.lit(1)))
    ranged = kept.repartitionByRange(max(1, math.ceil(seen["rows"] / rows)), *order).withColumn("_range", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    # A table without rows has no range, but it has columns.
    kept.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    return _stored(df.sparkSession, path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(schema.add("_range", "integer")).parquet(f"{path}/rows")


# ------------------------------------------------------------------- pages
def _page_order(sort: str, tie: str, descending: bool) -> list[Column]:
    return [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), F.col(tie)]


def save_pages(df: DataFrame, path: str, sort: str, tie: str = "firm_id", descending: bool = True, rows: int = RANGE_ROWS) -> None:
    """Store ``df`` in the order of its pages, with a directory of how many rows lie before each range."""
    ranged = _in_ranges(df, path, _page_order(sort, tie, descending), rows)
    # One row per range.
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("_range")) - F.col("n")
    sizes.withColumns({"before": before, "sort": F.lit(sort), "tie": F.lit(tie), "descending": F.lit(descending)}).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = 25) -> DataFrame:
    """A page as ``serve.page`` gives it; only the ranges that hold it are read and sorted."""
    size = min(PAGE_SIZES[1], max(PAGE_SIZES[0], size))
    begin = (max(1, number) - 1) * size
    directory = spark.read.schema("_range int, n long, before long, sort string, tie string, descending boolean").parquet(f"{path}/directory")
    held = directory.where((F.col("before") < begin + size) & (F.col("before") + F.col("n") > begin)).orderBy("_range").limit(size).collect()
    rows = _stored(spark, path)
    if not held:
        return rows.drop("_range").limit(0)
    first = held[0]
    found = rows.where(F.col("_range").isin([r["_range"] for r in held])).drop("_range")
    return found.orderBy(*_page_order(first["sort"], first["tie"], first["descending"])).offset(begin - first["before"]).limit(size)


# ------------------------------------------------------------------- search
def _triples(text: Column) -> Column:
    """All runs of three letters of a text in lower case."""
    low = F.lower(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))


def needed_triples(text: str) -> list[str]:
    """What a text must hold to match; ``%``, ``_`` and ``\\`` stand for something else in a pattern."""
    parts = re.split(r"[%_\\]", text.lower())
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


def save_searchable(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], rows: int = RANGE_ROWS) -> None:
    """Store ``df`` in ranges of ``order`` with the letter triples of each column that a range holds."""
    ranged = _in_ranges(df, path, order, rows)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    triples = ranged.select("_range", cells).where("value IS NOT NULL").select("_range", "column_name", F.explode(F.array_distinct(_triples(F.col("value")))).alias("triple"))
    held = triples.where(F.length("triple") == 3).distinct()
    held.repartitionByRange("triple").sortWithinPartitions("triple").write.mode("overwrite").parquet(f"{path}/triples")


def candidate_ranges(spark: SparkSession, path: str, text: str, columns: Sequence[str]) -> list[int] | None:
    """Ranges in which one column holds all letter triples of ``text``; None where it has none and every range may match.

    The rarest triple names the candidates, the others only thin them out: what is counted is at most one
    row per range, column and triple of the text.
    """
    needed = needed_triples(text)
    if not needed:
        return None
    held = spark.read.parquet(f"{path}/triples").where(F.col("triple").isin(needed) & F.col("column_name").isin(list(columns)))
    whole = held.groupBy("_range", "column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(needed))
    return sorted(r["_range"] for r in whole.select("_range").distinct().collect())


def search_stored(spark: SparkSession, path: str, text: str | None, columns: Sequence[str]) -> DataFrame:
    """The rows that ``serve.search`` gives, from the ranges that can hold them."""
    rows = _stored(spark, path)
    ranges = candidate_ranges(spark, path, text, columns) if text else None
    if ranges is not None:
        rows = rows.where(F.col("_range").isin(ranges)) if ranges else rows.limit(0)
    return search(rows.drop("_range"), text, columns)
