"""Research targets, source tasks, evidence and observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.rules import observation_violations, record_violations, source_violations
from snaplake.functions.text import source_address
from snaplake.operators.skew import lookup_join
from snaplake.sinks.tables import absent_rows

RECORD = ["firm_id", "dataset_version"]
TASK = [*RECORD, "source_type"]


def selected_targets(scored: DataFrame, categories: Sequence[str]) -> DataFrame:
    if not categories:
        raise ValueError("at least one priority category is required")
    return scored.filter(F.col("priority_category").isin(*categories))


def source_tasks(targets: DataFrame, types: Sequence[str] = fv.CORE_SOURCE_TYPES) -> DataFrame:
    """One task per target and source type.

    The closed list of source types travels as one array literal, so the
    output is made row by row and nothing is joined.
    """
    fields = ("source_type", "source_authority", "source_title", "taxonomy_url")
    chosen = [r for r in fv.SOURCE_TAXONOMY if r[0] in types]
    rows = F.array(*[
        F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, r)]) for r in chosen
    ])
    return targets.select("firm_id", "dataset_version", "website_address", F.inline(rows)).select(
        *TASK, "source_authority",
        source_address(F.col("source_type"), F.col("website_address"), F.col("taxonomy_url")).alias("source_url"),
        "source_title", F.lit("NOT_STARTED").alias("status"),
    )


def seed(
    scored: DataFrame, records: DataFrame, tasks: DataFrame, types: Sequence[str] = fv.CORE_SOURCE_TYPES,
    categories: Sequence[str] = ("PRIORITY_A", "PRIORITY_B"),
) -> tuple[DataFrame, DataFrame]:
    """(records, tasks) to append; what analysts already have is never touched."""
    targets = selected_targets(scored, tuple(dict.fromkeys(categories)))
    new_records = absent_rows(records, targets.select(*RECORD, F.lit("NOT_STARTED").alias("research_status")), RECORD)
    new_tasks = absent_rows(tasks, source_tasks(targets, types), TASK)
    return new_records, new_tasks


def seed_counts(targets: DataFrame, new_records: DataFrame) -> DataFrame:
    total = targets.select(*RECORD).distinct().agg(F.count(F.lit(1)).alias("total"))
    created = new_records.agg(F.count(F.lit(1)))
    return total.withColumn("created", created.scalar()).withColumn("existing", F.col("total") - F.col("created"))


def matching(tasks: DataFrame, **wanted) -> DataFrame:
    """Rows equal on every given column; columns given as None do not filter."""
    for column, value in wanted.items():
        if value is not None:
            tasks = tasks.filter(F.col(column) == F.lit(value))
    return tasks


def coverage(tasks: DataFrame) -> DataFrame:
    """Tasks by source type and status, with the number of distinct firms in all."""
    by_pair = tasks.groupBy("source_type", "status").agg(F.count(F.lit(1)).alias("n"))
    firms = tasks.agg(F.count_distinct("firm_id"))
    return by_pair.withColumn("target_count", firms.scalar())


def task_states(log: DataFrame, key: str, status: str, ts: str, tie: str) -> DataFrame:
    """Fold a task's status log: first discovered, last retrieved and reviewed, current."""
    s, t = F.col(status), F.col(ts)
    return log.groupBy(key).agg(
        F.min(F.when(s.isin(*fv.DISCOVERING_STATUSES), t)).alias("discovered_at"),
        F.max(F.when(s == "RETRIEVED", t)).alias("retrieved_at"),
        F.max(F.when(s.isin(*fv.REVIEWED_STATUSES), t)).alias("last_reviewed_at"),
        F.max_by(s, F.struct(ts, tie)).alias("status"),
    )


def judged_records(records: DataFrame) -> DataFrame:
    return records.withColumn("violations", record_violations(records.columns))


def judged_observations(observations: DataFrame) -> DataFrame:
    return observations.withColumn("violations", observation_violations())


def misplaced_observations(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations whose source does not belong to the same firm and version."""
    keys = ["source_id", *RECORD]
    return lookup_join(observations, sources, keys, "left_anti")


def supported_fields(sources: DataFrame, column: str = "field_supported") -> DataFrame:
    """Whole field names that each record's sources support."""
    names = F.split(F.col(column), r"[\s,;|]+")
    return (
        sources.select(*RECORD, F.explode(names).alias("field")).filter("field <> ''").distinct()
    )


def unsupported_fields(proposed: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposed (record, field) pairs that no linked source names."""
    pairs = proposed.select(*RECORD, "field").distinct()
    return pairs.join(supported_fields(sources), [*RECORD, "field"], "left_anti")


def refused_fields(proposed: DataFrame, sources: DataFrame) -> DataFrame:
    """(record, field, reason) of proposed facts that may not be stored: not a fact, or without evidence."""
    pairs = proposed.select(*RECORD, "field").distinct()
    fact = F.col("field").isin(*fv.FACTUAL_FIELDS)
    return pairs.filter(~F.coalesce(fact, F.lit(False))).withColumn("reason", F.lit("not a factual field")).unionByName(
        unsupported_fields(pairs.filter(fact), sources).withColumn("reason", F.lit("no evidence"))
    )


def judged_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("violations", source_violations(sources.columns))


def new_captures(pages: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Pages whose content hash is not stored yet, each content once."""
    hashed = pages.withColumn("content_hash", F.sha2(F.col(text), 256)).drop(text)
    return absent_rows(known, hashed, ["content_hash"])


def new_filings(known: DataFrame, incoming: DataFrame) -> DataFrame:
    return absent_rows(known, incoming, ["firm_id", "filing_date", "form_version", "content_hash"])


def child_counts(parents: DataFrame, children: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Parents with the number of their children; children are counted before the join."""
    counted = children.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counted, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


