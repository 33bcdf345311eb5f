"""Operational rollups of the dataset registry, report artifacts and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.keys import date_key, month_key

LOAD_ORDER = ("download_timestamp", "dataset_version")


# Rows per layer that a registry may have counted.
LAYER_ROWS = ("raw_rows", "typed_rows", "scored_rows")


def load_metrics(columns: Sequence[str] = ()) -> list[Column]:
    """What every period level reports about its loads; layers whose rows are in ``columns`` are summed."""
    status = F.col("status")
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"total_{c}") for c in LAYER_ROWS if c in columns]
    return totals + [
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(status == "success").alias("successful"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.round(F.count_if(status == "success") / F.count(F.lit(1)) * 100, 4).alias("success_rate"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_file_size"),
        F.round(F.avg("file_size"), 4).alias("avg_file_size"),
        F.round(F.avg("quality_score"), 4).alias("avg_quality_score"),
        F.coalesce(F.sum("checks_failed"), F.lit(0)).alias("total_warnings"),
        F.count("dataset_version").alias("datasets_processed"),
        F.max("download_timestamp").alias("latest_ingestion"),
        F.max_by("dataset_version", F.struct(*LOAD_ORDER)).alias("latest_dataset"),
    ]


def dated(loads: DataFrame) -> DataFrame:
    """Loads with a readable time, with their month and day keys."""
    ts = F.col("download_timestamp")
    return loads.filter(ts.isNotNull()).withColumns({"month": month_key(ts), "day": date_key(ts)})


def between_dates(loads: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; an end without a time part covers its whole day."""
    ts = F.col("download_timestamp")
    loads = loads.filter(ts.isNotNull())
    if start:
        loads = loads.filter(ts >= F.lit(start).cast("timestamp"))
    if end:
        limit = F.lit(end).cast("timestamp")
        loads = loads.filter(ts < limit + F.expr("INTERVAL 1 DAY") if len(end) == 10 else ts <= limit)
    return loads


def daily(loads: DataFrame) -> DataFrame:
    return dated(loads).groupBy("day").agg(*load_metrics(loads.columns))


def monthly(loads: DataFrame) -> DataFrame:
    """Half-open months: a load belongs to exactly one."""
    return dated(loads).groupBy("month").agg(*load_metrics(loads.columns))


def historical(loads: DataFrame) -> DataFrame:
    """Every month and the whole history (month NULL, level ``all``) in one job.

    Loads without a readable time belong to no month, but to the history; ask
    for ``between_dates`` first to leave them out.
    """
    keyed = loads.withColumn("month", month_key(F.col("download_timestamp")))
    return (
        keyed.rollup("month").agg(F.grouping("month").alias("_g"), *load_metrics(loads.columns))
        .filter((F.col("_g") == 1) | F.col("month").isNotNull())
        .withColumn("level", F.when(F.col("_g") == 1, "all").otherwise("month")).drop("_g")
    )


def period_members(loads: DataFrame) -> DataFrame:
    """(month, dataset_version, status): the versions behind a period, as rows."""
    return dated(loads).select("month", "dataset_version", "status", "download_timestamp")


def executions(registry: DataFrame) -> DataFrame:
    """Registry rows as execution rows; no duration was ever recorded."""
    return registry.select(
        "dataset_version", F.coalesce("status", F.lit("unknown")).alias("status"), "download_timestamp",
        "file_size", F.lit(None).cast("double").alias("execution_time"),
    )


def dataset_summaries(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Registry rows with quality, drift and change numbers and artifact counts.

    ``artifacts`` is one row per report: dataset_version, artifact_type,
    artifact_id, written_at, quality_score, passed, failed, missing, extra,
    added, modified.  They are reduced to one row per version in one pass.
    """
    def newest(kind: str, *columns: str) -> Column:
        # A report without its numbers says nothing, and an older one with them counts.
        told = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        hit = (F.col("artifact_type") == kind) & told
        return F.max_by(
            F.when(hit, F.struct(*columns)), F.when(hit, F.struct("written_at", "artifact_id"))
        ).alias(f"_{kind}")

    per_version = artifacts.groupBy("dataset_version").agg(
        F.count(F.lit(1)).alias("artifact_count"),
        F.count_if(F.col("artifact_type") == "quality").alias("quality_artifacts"),
        newest("quality", "quality_score", "passed", "failed"),
        newest("profiling", "quality_score", "passed", "failed"),
        newest("schema_diff", "missing", "extra"),
        newest("change_detection", "added", "modified"),
    )
    quality = F.coalesce("_quality", "_profiling")
    return registry.join(per_version, "dataset_version", "left").select(
        *registry.columns,
        quality["quality_score"].alias("quality_score"),
        quality["passed"].alias("checks_passed"),
        quality["failed"].alias("checks_failed"),
        F.col("_schema_diff.missing").alias("missing_columns"),
        F.col("_schema_diff.extra").alias("extra_columns"),
        F.col("_change_detection.added").alias("added_count"),
        F.col("_change_detection.modified").alias("modified_count"),
        F.coalesce("artifact_count", F.lit(0)).alias("artifact_count"),
        F.coalesce("quality_artifacts", F.lit(0)).alias("quality_artifacts"),
    )


def change_history(summaries: DataFrame) -> DataFrame:
    """Versions with a schema or data change report, as rows."""
    reported = F.col("missing_columns").isNotNull() | F.col("added_count").isNotNull()
    return summaries.filter(reported).select(
        "dataset_version", "missing_columns", "extra_columns", "added_count", "modified_count"
    )


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"))


def log_metrics(log: DataFrame) -> DataFrame:
    """Execution metrics of a parsed log (``EXEC|operation|0.1234s|OUTCOME``)."""
    message = F.col("message")
    run = message.startswith("EXEC|")
    seconds = F.when(
        run, F.replace(F.try_element_at(F.split(message, r"\|"), F.lit(3)), F.lit("s"), F.lit("")).try_cast("double")
    )
    ok, bad = run & message.contains("SUCCESS"), run & message.contains("FAILED")
    zero = F.lit(0.0)
    return log.agg(
        F.count_if(run).alias("total_executions"),
        F.count_if(ok).alias("successful"),
        F.count_if(bad).alias("failed"),
        F.coalesce(F.round(F.try_divide(F.count_if(ok), F.count_if(run)) * 100, 4), zero).alias("success_rate"),
        F.coalesce(F.round(F.avg(seconds), 4), zero).alias("avg_seconds"),
        F.coalesce(F.min(seconds), zero).alias("min_seconds"),
        F.coalesce(F.max(seconds), zero).alias("max_seconds"),
        F.max("ts").alias("last_entry"),
    )


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
