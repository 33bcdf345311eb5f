"""Table checks.  A check is a row: check, entity, metric, bad_count, severity, passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.keys import age_in_days
from snaplake.operators.skew import lookup_join


def _one_row_checks(df: DataFrame, check: str, entity: str, metrics: Mapping[str, Column], severity: str) -> DataFrame:
    """Several counts from one pass, one output row per metric."""
    names = list(metrics)
    counted = df.agg(*[F.count_if(metrics[m]).alias(f"_{i}") for i, m in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_{i}").alias("bad_count")) for i, m in enumerate(names)
    ])
    return counted.select(F.inline(rows)).select(
        F.lit(check).alias("check"), F.lit(entity).alias("entity"), "metric", "bad_count",
        F.lit(severity).alias("severity"), (F.col("bad_count") == 0).alias("passed"),
    )


def missing_keys(df: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    return _one_row_checks(df, "missing_keys", entity, {k: F.col(k).isNull() for k in keys}, "error")


def unexpected_nulls(df: DataFrame, entity: str, columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """NULLs in critical columns, counted together, optionally on some rows only."""
    scope = F.lit(True) if only is None else only
    return _one_row_checks(
        df, "unexpected_nulls", entity, {c: F.col(c).isNull() & scope for c in columns}, "error"
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with how many rows hold them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def duplicate_check(df: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    return _count_check(duplicate_keys(df, keys), "duplicate_keys", entity, ",".join(keys), "error")


def _count_check(bad: DataFrame, check: str, entity: str, metric: str, severity: str) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("bad_count")).select(
        F.lit(check).alias("check"), F.lit(entity).alias("entity"), F.lit(metric).alias("metric"),
        "bad_count", F.lit(severity).alias("severity"), (F.col("bad_count") == 0).alias("passed"),
    )


def broken_references(child: DataFrame, parent: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Child rows whose parent does not exist (a NULL reference has none)."""
    return lookup_join(child, parent.select(F.col(key).alias(foreign_key)), [foreign_key], "left_anti")


def broken_reference_counts(child: DataFrame, parent: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Missing parents with the child rows that name them; children are counted before the join."""
    named = child.groupBy(foreign_key).agg(F.count(F.lit(1)).alias("child_rows"))
    return named.join(parent.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def reference_check(child: DataFrame, parent: DataFrame, entity: str, foreign_key: str, key: str) -> DataFrame:
    bad = broken_reference_counts(child, parent, foreign_key, key)
    return bad.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("bad_count")).select(
        F.lit("broken_references").alias("check"), F.lit(entity).alias("entity"),
        F.lit(foreign_key).alias("metric"), "bad_count", F.lit("error").alias("severity"),
        (F.col("bad_count") == 0).alias("passed"),
    )


def orphan_parents(parent: DataFrame, child: DataFrame, key: str, foreign_key: str) -> DataFrame:
    """Parents without a child; child keys are made distinct before the join."""
    return parent.join(child.select(F.col(foreign_key).alias(key)).distinct(), key, "left_anti")


def orphan_check(parent: DataFrame, child: DataFrame, entity: str, key: str, foreign_key: str) -> DataFrame:
    return _count_check(orphan_parents(parent, child, key, foreign_key), "orphans", entity, key, "warning")


def reconcile(raw: DataFrame, typed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Raw against typed row counts, per version when ``by`` names it."""
    a = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_rows"))
    b = typed.groupBy(*by).agg(F.count(F.lit(1)).alias("typed_rows"))
    both = a.join(b, list(by), "full") if by else a.withColumn("typed_rows", b.scalar())
    return both.select(
        *by,
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"),
        F.coalesce("typed_rows", F.lit(0)).alias("typed_rows"),
    ).withColumn("passed", F.col("raw_rows") == F.col("typed_rows"))


def row_drops(counts: DataFrame, expected: str, actual: str, share: float = fv.ROW_DROP_SHARE) -> DataFrame:
    """Rows of a count table whose actual number is below a share of the expected one."""
    return counts.filter(F.col(actual) < F.col(expected) * share).withColumn(
        "kept_pct", F.round(F.col(actual) / F.col(expected) * 100, 1)
    )


def schema_alarms(missing: DataFrame, extra: DataFrame, table: str) -> DataFrame:
    """One alarm row when a source lacks or adds columns; no row otherwise."""
    counted = missing.agg(F.count(F.lit(1)).alias("missing_columns")).withColumn(
        "extra_columns", extra.agg(F.count(F.lit(1))).scalar()
    )
    return counted.filter("missing_columns > 0 OR extra_columns > 0").select(
        F.lit("SCHEMA_DRIFT").alias("alarm"), F.lit(table).alias("table_name"), "missing_columns", "extra_columns"
    )


def missing_tables(expected: DataFrame, found: DataFrame, key: str = "table_name") -> DataFrame:
    return expected.join(found.select(key).distinct(), key, "left_anti").select(
        F.lit("MISSING_TABLE").alias("alarm"), key
    )


def freshness(loads: DataFrame, ts: str, now: Column, max_days: int = fv.FRESHNESS_DAYS) -> DataFrame:
    """Age of the newest load; no load at all fails."""
    return loads.agg(F.max(ts).alias("latest")).select(
        "latest", age_in_days(F.col("latest"), now).alias("age_days")
    ).withColumn("passed", F.coalesce(F.col("age_days") < max_days, F.lit(False)))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def gate(checks: DataFrame) -> bool:
    """True when no check of severity error failed."""
    return checks.filter("severity = 'error' AND NOT passed").isEmpty()


def validate_snapshot(firms: DataFrame, offices: DataFrame, acquired: DataFrame) -> DataFrame:
    """Every key, reference and completeness check of one typed snapshot.

    Each table is read once and reduced to one row per firm, with its row,
    duplicate and NULL counts; the three are joined on the firm and summed.
    """
    def nulls(prefix: str, columns: Sequence[str], scope: Column) -> list[Column]:
        return [F.count_if(F.col(c).isNull() & scope).alias(f"{prefix}_{c}") for c in columns]

    n = F.count(F.lit(1))
    per_firm = firms.groupBy("firm_id").agg(
        n.alias("f_rows"), *nulls("f", fv.CRITICAL_FIRM_FIELDS, F.lit(True))
    )
    is_main = F.col("office_type") == "MAIN"
    office_null = [f"o_{c}" for c in fv.CRITICAL_OFFICE_FIELDS]
    per_office = (
        offices.groupBy("firm_id", "office_type").agg(n.alias("o_rows"), *nulls("o", fv.CRITICAL_OFFICE_FIELDS, is_main))
        .groupBy("firm_id").agg(
            F.sum("o_rows").alias("o_rows"), F.count_if(F.col("o_rows") > 1).alias("o_twice"),
            *[F.sum(c).alias(c) for c in office_null],
        )
    )
    per_acquired = acquired.groupBy(F.col("parent_firm_id").alias("firm_id")).agg(n.alias("a_rows"))
    joined = per_firm.join(per_office, "firm_id", "full").join(per_acquired, "firm_id", "full")

    no_key, no_firm = F.col("firm_id").isNull(), F.col("f_rows").isNull()
    bad = [
        ("missing_keys", "firms", "firm_id", F.when(no_key, F.col("f_rows")), "error"),
        ("missing_keys", "firm_offices", "firm_id", F.when(no_key, F.col("o_rows")), "error"),
        ("missing_keys", "firm_acquired_firms", "parent_firm_id", F.when(no_key, F.col("a_rows")), "error"),
        ("duplicate_keys", "firms", "firm_id", (F.col("f_rows") > 1).cast("bigint"), "error"),
        ("duplicate_keys", "firm_offices", "firm_id,office_type", F.col("o_twice"), "error"),
        ("broken_references", "firm_offices", "firm_id", F.when(no_firm, F.col("o_rows")), "error"),
        ("broken_references", "firm_acquired_firms", "parent_firm_id", F.when(no_firm, F.col("a_rows")), "error"),
        ("orphans", "firms", "firm_id", F.when(F.col("o_rows").isNull(), F.col("f_rows")), "warning"),
        *[("unexpected_nulls", "firms", c, F.col(f"f_{c}"), "error") for c in fv.CRITICAL_FIRM_FIELDS],
        *[("unexpected_nulls", "firm_offices", c, F.col(f"o_{c}"), "error") for c in fv.CRITICAL_OFFICE_FIELDS],
    ]
    counted = joined.agg(*[F.coalesce(F.sum(count), F.lit(0)).alias(f"b{i}") for i, (_, _, _, count, _) in enumerate(bad)])
    rows = F.array(*[
        F.struct(
            F.lit(check).alias("check"), F.lit(entity).alias("entity"), F.lit(metric).alias("metric"),
            F.col(f"b{i}").alias("bad_count"), F.lit(severity).alias("severity"),
        )
        for i, (check, entity, metric, _, severity) in enumerate(bad)
    ])
    return counted.select(F.inline(rows)).withColumn("passed", F.col("bad_count") == 0)
