"""Writes.  Everything is partitioned by version; a rerun replaces its own part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from snaplake.functions.typing import nan_to_null
from snaplake.operators.skew import newest_per_key
from snaplake.sinks.copy_on_write import upsert_files
from snaplake.sources.snapshots import VERSION

TARGET_FILE_ROWS = 5_000_000


def replace_version(
    df: DataFrame, path: str, parts: Sequence[str] = (VERSION,), fmt: str = "parquet", version: str | None = None
) -> int:
    """Replace only the partitions that ``df`` holds; returns the rows written.

    With ``version`` named, ``df`` is that version, whole: its part is replaced
    even if no row is left.  The count comes from the write itself, not from a
    second pass.
    """
    seen = Observation()
    if version is not None:
        (
            df.drop(VERSION).observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite").option("maxRecordsPerFile", TARGET_FILE_ROWS)
            .format(fmt).save(f"{path}/{VERSION}={version}")
        )
        return seen.get["rows"]
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", TARGET_FILE_ROWS)
        .partitionBy(*parts).format(fmt).save(path)
    )
    return seen.get["rows"]


def replace_tables(frames: Mapping[str, DataFrame], root: str, version: str) -> tuple[list[str], int]:
    """Raw tables of one version: names written and rows in total."""
    written, rows = [], 0
    for name, df in frames.items():
        rows += replace_version(df, f"{root}/{name.replace('-', '_')}", version=version)
        written.append(name.replace("-", "_"))
    return written, rows


def write_entities(entities: Mapping[str, DataFrame], root: str, version: str) -> dict[str, int]:
    """Typed tables of one version.  An empty entity still gets a readable, empty part."""
    counts = {}
    for name, df in entities.items():
        path = f"{root}/{name}/{VERSION}={version}"
        seen = Observation()
        (
            df.drop(VERSION).observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite").option("maxRecordsPerFile", TARGET_FILE_ROWS).parquet(path)
        )
        counts[name] = seen.get["rows"]
    return counts


def append_entities(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy(VERSION).parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str) -> None:
    """A catalog table bucketed and sorted by key.

    Snapshots saved with the same keys and bucket number are compared and
    joined on the key without moving a row.
    """
    (
        df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
        .format("parquet").saveAsTable(table)
    )


def publish(replaced: Mapping[str, DataFrame], kept: Mapping[str, DataFrame], root: str) -> dict[str, int]:
    """Write serving tables; returns the rows written to each.

    Tables in ``replaced`` overwrite their versions.  Tables in ``kept`` hold
    what people edit: only firms that are not there yet are added.
    """
    counts = {name: replace_version(df, f"{root}/{name}") for name, df in replaced.items()}
    for name, df in kept.items():
        path, spark = f"{root}/{name}", df.sparkSession
        fresh = df
        if _exists(spark, path):
            fresh = absent_rows(spark.read.schema(df.schema).parquet(path), df, ["firm_id", VERSION])
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(VERSION).parquet(path)
        counts[name] = seen.get["rows"]
    return counts


def publish_keyed(tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]], root: str) -> dict[str, dict[str, int]]:
    """Write serving tables whose rows have keys of their own; returns what changed in each.

    For every table: the incoming rows, their keys, and the columns that an
    incoming row changes in a row that is there already.  Without such columns
    the table keeps what it has and only takes new keys.  Only files with a changed row
    are written anew; ``copy_on_write.read_files`` reads the tables.
    """
    return {name: upsert_files(df, f"{root}/{name}", keys, update) for name, (df, keys, update) in tables.items()}


def save_refresh_queue(queue: DataFrame, root: str, version: str, generated_at: Column) -> dict[str, int]:
    """Store the refresh queue of a version; firms that are not in it any more leave it.

    The table ``queue`` holds one row per version and firm, ``runs`` when each version's queue was last made.
    """
    rows = queue.withColumn(VERSION, F.lit(version))
    done = upsert_files(rows, f"{root}/queue", [VERSION, "firm_id"], replaced=F.col(VERSION) == version)
    made = queue.sparkSession.range(1).select(F.lit(version).alias(VERSION), generated_at.alias("generated_at"))
    upsert_files(made, f"{root}/runs", [VERSION])
    return done


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upserted(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    precedence: Column | None = None,
) -> DataFrame:
    """The table after a keyed upsert; both sides have one row per key.

    An existing row takes the ``update`` columns of the incoming one (all but
    the keys when not given) and keeps the rest.  With ``precedence`` (an
    expression on either side's columns, higher wins) an incoming row of lower
    precedence changes nothing.
    """
    keys = list(keys)
    columns = old.columns
    update = [c for c in columns if c not in keys] if update is None else list(update)
    rank = F.lit(0) if precedence is None else precedence
    o = old.select(F.struct(*columns).alias("o"), *keys, rank.alias("_old_rank"))
    n = new.select(F.struct(*columns).alias("n"), *keys, rank.alias("_new_rank"))
    both = o.join(n, keys, "full")
    incoming = F.col("o").isNull() | (
        F.col("n").isNotNull() & (F.col("_new_rank") >= F.col("_old_rank"))
    )
    cells = []
    for c in columns:
        if c in keys:
            cells.append(F.col(c))
        elif c in update:
            cells.append(F.when(incoming, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cells.append(F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cells)


def absent_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the table lacks, once per key; NULL equals NULL."""
    others = [F.col(c).asc_nulls_first() for c in new.columns if c not in keys]
    # One incoming row per key first, so a repeated key cannot overload the join.
    once = newest_per_key(new, keys, others or [F.lit(1)])
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return once.join(o, match, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def history_csv(summaries: DataFrame) -> DataFrame:
    """Dataset history as it is exported: size 0 and score N/A when not known."""
    return summaries.select(
        F.col("dataset_version").alias("version"),
        F.col("download_timestamp").alias("date"),
        "status",
        F.coalesce("file_size", F.lit(0)).alias("size_bytes"),
        F.coalesce(F.nullif(F.col("quality_score"), F.lit(0.0)).cast("string"), F.lit("N/A")).alias("quality_score"),
    )


def write_history_csv(summaries: DataFrame, path: str) -> None:
    history_csv(summaries).write.mode("overwrite").option("header", True).csv(path)


def write_artifacts(reports: DataFrame, path: str) -> None:
    """Report rows below ``artifact_type=/dataset_version=``; the path is the index."""
    (
        reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False).partitionBy("artifact_type", VERSION).json(path)
    )


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column, as serving tables need it."""
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
            for f in df.schema.fields
        ]
    )
