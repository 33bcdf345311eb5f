"""Row rules.  Each returns an array naming every rule that a row breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.typing import iso_timestamp


def violations(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition is true, in the order given."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def outside(c: Column, allowed: Sequence[str]) -> Column:
    """Given, but not one of the allowed words."""
    return given(c) & ~c.isin(*allowed)


def negative_or_text(c: Column) -> Column:
    number = c.try_cast("double")
    return given(c) & (number.isNull() | (number < 0))


def not_a_timestamp(c: Column) -> Column:
    return given(c) & iso_timestamp(c.cast("string")).isNull()


def record_violations(columns: Sequence[str]) -> Column:
    """Rules of a research record, for those of its fields that the table has."""
    have = set(columns)
    rules = [("research_status", F.col("research_status").isNull()
              | ~F.col("research_status").isin(*fv.RESEARCH_STATUSES))]
    rules += [(f, outside(F.col(f), fv.CONFIDENCE_LEVELS)) for f in fv.CONFIDENCE_FIELDS if f in have]
    rules += [(f, outside(F.col(f), fv.ASSESSMENT_LEVELS)) for f in fv.ASSESSMENT_FIELDS if f in have]
    rules += [(f, negative_or_text(F.col(f))) for f in fv.NONNEGATIVE_FIELDS if f in have]
    low, high = "estimated_valuation_low", "estimated_valuation_high"
    if {low, high} <= have:
        rules.append(("valuation_range", F.col(low).try_cast("double") > F.col(high).try_cast("double")))
    rules += [(f, not_a_timestamp(F.col(f))) for f in fv.TIMESTAMP_FIELDS if f in have]
    return violations(*rules)


def observation_violations() -> Column:
    """Rules of a proposed observation."""
    return violations(
        ("value_type", ~F.coalesce(F.col("value_type").isin(*fv.OBSERVATION_VALUE_TYPES), F.lit(False))),
        ("confidence", outside(F.col("confidence"), fv.CONFIDENCE_LEVELS)),
        ("review_status", ~F.coalesce(F.col("review_status").isin(*fv.OBSERVATION_STATUSES), F.lit(False))),
        ("canonical_field", ~given(F.col("canonical_field"))),
    )


def source_violations(columns: Sequence[str]) -> Column:
    """Rules of an evidence source or a source task, for those of its fields that the table has."""
    have = set(columns)
    rules = [(f, ~given(F.col(f))) for f in ("source_type", "field_supported") if f in have]
    rules += [(f, not_a_timestamp(F.col(f))) for f in ("accessed_at", "published_at") if f in have]
    rules += [
        (f, ~F.coalesce(F.col(f).isin(*fv.TASK_STATUSES), F.lit(False))) for f in ("retrieval_status", "status") if f in have
    ]
    return violations(*rules)


def domain_violations(state: Column, id_number: Column, status: Column) -> Column:
    """Rules on the value domain of a state code, an id number and a status."""
    number = id_number.try_cast("bigint")
    return violations(
        ("state", outside(state, fv.STATE_CODES)),
        ("id_number", given(id_number) & ~F.coalesce(number.between(*fv.ID_NUMBER_RANGE), F.lit(False))),
        ("status", outside(status, fv.FIRM_STATUSES)),
    )
