"""Human-readable text from values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def money_label(c: Column) -> Column:
    """``$12.3M`` from a million up, ``$12,345`` below, ``Unknown`` for NULL."""
    amount = c.cast("double")
    return (
        F.when(amount.isNull(), UNKNOWN)
        .when(F.abs(amount) >= 1_000_000, F.format_string("$%.1fM", amount / 1_000_000))
        .otherwise(F.concat(F.lit("$"), F.format_number(amount, 0)))
    )


def percent_label(part: Column, whole: Column) -> Column:
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share)).otherwise(UNKNOWN)


def text_or(c: Column, default: str = UNKNOWN) -> Column:
    """The value as text, or the default when it is NULL or empty."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def slug(c: Column) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def file_key(firm_id: Column, name: Column, suffix: str = ".md") -> Column:
    return F.concat(firm_id, F.lit("_"), slug(name), F.lit(suffix))
