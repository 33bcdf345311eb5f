"""Serving tables and the queries over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.keys import json_codes, pack_json, version_date
from snaplake.functions.labels import UNKNOWN, money_label, percent_label, text_or
from snaplake.functions.typing import lenient_flag
from snaplake.operators.rollup import category_counts
from snaplake.operators.skew import lookup_join, newest_per_key, with_neighbours
from snaplake.session import materialise
from snaplake.sources.snapshots import VERSION

FIRM_VERSION = ["firm_id", VERSION]
PAGE_SIZES = (10, 100)


# ------------------------------------------------------------ serving tables
FIRM_COLUMNS = (
    "name", "primary_business_name", "sec_number", "website_address", "organization_state", "sec_region",
    "sec_current_status",
)
FACT_COLUMNS = (
    "total_aum", "discretionary_aum", "non_discretionary_aum", "total_account_count", "average_account_size",
    "individual_hnw_share", "employee_count", "advisory_employee_count", "state_iar_count",
)
FLAG_COLUMNS = ("has_item_11_disclosure", "regulatory_review_flag")
SCORE_COLUMNS = ("acquisition_score", "priority_category", "priority_readiness", "review_required")
OFFICE_COLUMNS = (
    ("street_address_1", "main_office_street_address_1"), ("street_address_2", "main_office_street_address_2"),
    ("city", "main_office_city"), ("state", "main_office_state"), ("country", "main_office_country"),
    ("telephone", "main_office_phone"),
)


def main_offices(offices: DataFrame) -> DataFrame:
    """The first MAIN office of each firm, with every column as tie-break."""
    main = offices.filter("office_type = 'MAIN'")
    order = [F.col(c).asc_nulls_last() for c, _ in OFFICE_COLUMNS]
    return newest_per_key(main, FIRM_VERSION, order).select(
        *FIRM_VERSION, *[F.col(c).alias(out) for c, out in OFFICE_COLUMNS]
    )


# What a source or run that is published again may change.
SOURCE_STATE = ("source_url", "source_title", "retrieval_status", "content_hash", "source_notes", "updated_at")
RUN_STATE = ("status", "completed_at", "duration_seconds", "details")


def _have(df: DataFrame, names: Sequence[str], kind: str = "string") -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n in names]


def serving_tables(scored: DataFrame, offices: DataFrame, score_version: str, published_at: Column) -> dict[str, DataFrame]:
    """Projections of one scored snapshot: dataset_versions, firms, firm_facts, firm_scores, outreach_targets."""
    components = [c for c in fv.COMPONENT_SCORES if c in scored.columns]
    packed = pack_json(components) if components else F.lit(None).cast("string")
    flags = [
        (lenient_flag(F.col(c)) if c in scored.columns else F.lit(None).cast("boolean")).alias(c) for c in FLAG_COLUMNS
    ]
    counts = scored.groupBy(VERSION, "priority_category").agg(F.count(F.lit(1)).alias("n"))
    # A snapshot has a handful of priority categories.
    versions = counts.groupBy(VERSION).agg(
        F.sum("n").alias("gold_rows"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("priority_category", "n"))))).alias("priority_counts"),
    ).select(
        VERSION, F.substr(F.col(VERSION), F.lit(3)).alias("dataset_date"), F.lit(score_version).alias("score_version"),
        F.col("gold_rows").alias("silver_rows"), "gold_rows", "priority_counts", published_at.alias("published_at"),
    )
    return {
        "dataset_versions": versions,
        "firms": scored.select(*FIRM_VERSION, *_have(scored, FIRM_COLUMNS)),
        "firm_facts": scored.select(*FIRM_VERSION, *_have(scored, FACT_COLUMNS, "double"), *flags)
        .join(main_offices(offices), FIRM_VERSION, "left"),
        "firm_scores": scored.select(
            *FIRM_VERSION, *_have(scored, SCORE_COLUMNS), packed.alias("component_scores"),
            *_have(scored, ["reason_codes"]),
        ),
        "outreach_targets": scored.select(*FIRM_VERSION, F.lit("NOT_RESEARCHED").alias("status")),
    }


def operations_tables(
    research: DataFrame, sources: DataFrame, runs: DataFrame, alerts: DataFrame
) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Research, sources, runs and alerts as ``sinks.tables.publish_keyed`` takes them.

    Research and alerts belong to the people who edit them once they are there;
    a source or run that comes again brings its new state.
    """
    def changed(df: DataFrame, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c in df.columns]

    return {
        "firm_research": (research, list(FIRM_VERSION), []),
        "research_sources": (sources, ["source_id"], changed(sources, SOURCE_STATE)),
        "pipeline_runs": (runs, ["run_id"], changed(runs, RUN_STATE)),
        "alerts": (alerts, ["alert_id"], []),
    }


# ------------------------------------------------------------------- filters
def search(df: DataFrame, text: str | None, columns: Sequence[str] = ("name", "firm_id")) -> DataFrame:
    """Case-insensitive substring of any of the columns; no text, no filter."""
    if not text:
        return df
    return df.filter(reduce(Column.__or__, [F.col(c).ilike(f"%{text}%") for c in columns]))


def newest_version_rows(df: DataFrame, published: DataFrame) -> DataFrame:
    """Rows of the newest published version; the scalar prunes partitions at run time."""
    return df.filter(F.col(VERSION) == published.agg(F.max_by(VERSION, F.struct("published_at", VERSION))).scalar())


def with_details(firms: DataFrame, scores: DataFrame, *others: DataFrame) -> DataFrame:
    """Firms with their scores (inner) and any other per-firm tables (left)."""
    return reduce(
        lambda acc, other: acc.join(other, FIRM_VERSION, "left"), others, firms.join(scores, FIRM_VERSION)
    )


# ---------------------------------------------------------------------- pages
def page(df: DataFrame, sort: str, number: int = 1, size: int = 25, descending: bool = True, tie: str = "firm_id") -> DataFrame:
    """One page in a total order, NULLs last; the size is kept within 10 to 100."""
    size = min(PAGE_SIZES[1], max(PAGE_SIZES[0], size))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(order, F.col(tie)).offset((max(1, number) - 1) * size).limit(size)


def page_total(df: DataFrame, size: int = 25) -> DataFrame:
    size = min(PAGE_SIZES[1], max(PAGE_SIZES[0], size))
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def page_with_total(df: DataFrame, sort: str, number: int = 1, size: int = 25) -> DataFrame:
    """A page with the count of all matching rows beside each of its rows."""
    return page(df, sort, number, size).withColumn("total_count", df.agg(F.count(F.lit(1))).scalar())


def latest_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def candidates(df: DataFrame, score: str = "acquisition_score", threshold: float = fv.CANDIDATE_MIN_SCORE,
               limit: int = fv.CANDIDATE_LIMIT) -> DataFrame:
    return df.filter(F.col(score) >= threshold).orderBy(F.col(score).desc(), "firm_id").limit(limit)


def current_dataset(registry: DataFrame, ts: str = "download_timestamp") -> DataFrame:
    """One row: the newest successful load."""
    row = F.struct(*registry.columns)
    return registry.filter("status = 'success'").agg(
        F.max_by(row, F.struct(ts, VERSION)).alias("r")
    ).filter("r IS NOT NULL").select("r.*")


# --------------------------------------------------------------- per-key rows
def latest_per_key(df: DataFrame, keys: Sequence[str], version: str = VERSION) -> DataFrame:
    """The row of the newest version per key, newest by the label's date."""
    return newest_per_key(df, keys, [version_date(F.col(version)).desc_nulls_last(), F.col(version).desc()])


def transitions(log: DataFrame, key: str, status: str, ts: str, tie: str) -> DataFrame:
    """Status changes only: the first status of a key and each one that differs from the one before."""
    seen = with_neighbours(log.select(key, ts, tie, status), [key], (ts, tie), F.col(status), "from_status")
    return seen.filter(~F.col("from_status").eqNullSafe(F.col(status))).select(
        key, "from_status", F.col(status).alias("to_status"), F.col(ts).alias("changed_at"), tie
    )


def last_activity(targets: DataFrame, activities: DataFrame, key: str, ts: str) -> DataFrame:
    latest = activities.groupBy(key).agg(F.max(ts).alias("last_activity_at"))
    return targets.join(latest, key, "left")


# ------------------------------------------------------------------- overview
def overview(scores: DataFrame, research: DataFrame, outreach: DataFrame, published: DataFrame) -> DataFrame:
    """(metric, category, n) of the newest version, with the priority A and B subtotal."""
    def counted(df: DataFrame, metric: str, column: str) -> DataFrame:
        return category_counts(newest_version_rows(df, published), column).select(
            F.lit(metric).alias("metric"), F.col(column).alias("category"), "n"
        )

    priorities = counted(scores, "priority", "priority_category")
    targets = priorities.filter(F.col("category").isin("PRIORITY_A", "PRIORITY_B")).agg(
        F.lit("priority").alias("metric"), F.lit("A+B").alias("category"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    return reduce(DataFrame.unionByName, [
        priorities, targets, counted(research, "research", "research_status"), counted(outreach, "outreach", "status"),
    ])


def firm_detail(
    firms: DataFrame, facts: DataFrame, scores: DataFrame, research: DataFrame,
    sources: DataFrame, contacts: DataFrame, outreach: DataFrame, activities: DataFrame,
    firm_id: str | None = None,
) -> DataFrame:
    """Everything about a firm, or about every firm, as (firm_id, section, sort_key, payload).

    Lists stay rows, because a firm may have any number of sources or
    activities.  ``payload`` is JSON; order a section by ``sort_key``.
    """
    def section(df: DataFrame, name: str, key: Column, newest: bool) -> DataFrame:
        if firm_id is not None:
            df = df.filter(F.col("firm_id") == firm_id)
        if newest:
            df = latest_per_key(df, ["firm_id"])
        columns = [c for c in df.columns if c != "firm_id"]
        return df.select(
            "firm_id", F.lit(name).alias("section"), key.cast("string").alias("sort_key"),
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"),
        )

    version = F.col(VERSION)
    return reduce(DataFrame.unionByName, [
        section(firms, "firm", version, True),
        section(facts, "facts", version, True),
        section(scores, "scores", version, True),
        section(research, "research", version, True),
        section(sources, "sources", F.col("accessed_at"), False),
        section(contacts, "contacts", F.col("contact_name"), False),
        section(outreach, "outreach", version, True),
        section(activities, "activities", F.col("occurred_at"), False),
    ])


def provenance(sources: DataFrame) -> DataFrame:
    return sources.orderBy(*FIRM_VERSION, "source_id")


# -------------------------------------------------------------------- dossier
PLACEHOLDER = re.compile(r"\{(\w+)(?::(\w+))?(?:\|([^}]*))?\}")


def _rendered(line: str, fields: dict[str, Callable[[str, str], Column]]) -> Column:
    """One template line as a text expression."""
    parts, at = [], 0
    for hit in PLACEHOLDER.finditer(line):
        kind, name, default = hit.groups()
        parts += [F.lit(line[at:hit.start()]), fields[kind](name, default or UNKNOWN)]
        at = hit.end()
    return F.concat(*parts, F.lit(line[at:]))


def dossier_lines(
    scored: DataFrame, research: DataFrame, sources: DataFrame, generated_at: str, house: str = "We", draft: bool = False
) -> DataFrame:
    """Markdown dossiers as lines: firm_id, dataset_version, section, line_no, line.

    A firm gets a dossier when it has a research record.  Its fixed part is an
    array built in the row; its sources, of which there may be any number,
    stay one line per row.  Order by (firm_id, section, line_no).
    """
    kept = [c for c in research.columns if c not in FIRM_VERSION]
    # Written once: its text lines and both kinds of source lines are made from it.
    facts = materialise(scored.join(
        research.select(*FIRM_VERSION, *[F.col(c).alias(f"r_{c}") for c in kept]), FIRM_VERSION
    ))
    have = set(facts.columns)

    def text(prefix: str) -> Callable[[str, str], Column]:
        return lambda name, default: (
            text_or(F.col(prefix + name), default) if prefix + name in have else F.lit(default)
        )

    def cash(prefix: str) -> Callable[[str, str], Column]:
        return lambda name, _: money_label(F.col(prefix + name)) if prefix + name in have else F.lit(UNKNOWN)

    def share(*_) -> Column:
        known = {"discretionary_aum", "total_aum"} <= have
        return percent_label(F.col("discretionary_aum"), F.col("total_aum")) if known else F.lit(UNKNOWN)

    fields = {
        "g": text(""), "r": text("r_"), "cash": cash(""), "rcash": cash("r_"), "share": share,
        "house": lambda *_: F.lit(house), "generated_at": lambda *_: F.lit(generated_at),
    }
    codes = json_codes(F.col("reason_codes")) if "reason_codes" in have else F.array().cast("array<string>")
    bullets = F.when(F.size(codes) > 0, F.transform(codes, lambda c: F.concat(F.lit("- "), c))).otherwise(
        F.array(F.lit(fv.DOSSIER_NO_CODES))
    )

    def block(line: str) -> Column:
        """The lines that one template line stands for."""
        if line == "{codes}":
            return bullets
        if line == "{draft}":
            return F.array(F.lit(fv.DRAFT_NOTICE), F.lit("")) if draft else F.array().cast("array<string>")
        return F.array(_rendered(line, fields))

    def numbered(section: int, template: str) -> Column:
        lines = F.concat(*[block(line) for line in template.splitlines()])
        return F.transform(lines, lambda line, i: F.struct(
            F.lit(section).cast("bigint").alias("section"), i.cast("bigint").alias("line_no"), line.alias("line")
        ))

    fixed = facts.select(
        *FIRM_VERSION, F.inline(F.concat(numbered(1, fv.DOSSIER_TEMPLATE), numbered(3, fv.DOSSIER_TAIL)))
    )

    title = F.coalesce(F.nullif("source_title", F.lit("")), F.nullif("source_url", F.lit("")), F.col("source_type"))
    source_line = F.concat(
        F.lit("- ["), title, F.lit("]("), text_or(F.col("source_url"), ""), F.lit(") — supports `"),
        text_or(F.col("field_supported"), "None"), F.lit("`; accessed "), text_or(F.col("accessed_at"), "unknown"), F.lit("."),
    )
    second = F.lit(2).cast("bigint").alias("section")
    listed = lookup_join(sources, facts.select(*FIRM_VERSION), FIRM_VERSION, "left_semi").select(
        *FIRM_VERSION, second, F.col("source_id").cast("bigint").alias("line_no"), source_line.alias("line")
    )
    unlisted = facts.select(*FIRM_VERSION).join(
        sources.select(*FIRM_VERSION).distinct(), FIRM_VERSION, "left_anti"
    ).select(*FIRM_VERSION, second, F.lit(0).cast("bigint").alias("line_no"), F.lit(fv.DOSSIER_NO_SOURCES).alias("line"))
    return reduce(DataFrame.unionByName, [fixed, listed, unlisted])
