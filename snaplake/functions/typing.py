"""Text to typed columns.  Bad text becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake import fixed_values as fv

MONEY = T.DecimalType(20, 2)


def stripped(c: Column) -> Column:
    return F.trim(c, F.lit(fv.WHITESPACE))


def null_if_missing(c: Column, tokens: Iterable[str] = fv.NULL_TOKENS) -> Column:
    """NULL for a cell that only holds a missing-value token.

    The tokens travel as one comma-joined literal, which keeps a projection of
    hundreds of columns small.
    """
    listed = ",".join(tokens)
    return F.when(F.find_in_set(stripped(c), F.lit(listed)) == 0, c)


def missing_tokens_to_null(df: DataFrame, tokens: Iterable[str] = fv.NULL_TOKENS) -> DataFrame:
    """``null_if_missing`` over every text column of a frame."""
    tokens = tuple(tokens)
    return df.select(
        *[
            null_if_missing(F.col(f"`{f.name}`"), tokens).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def yes_no_flag(c: Column) -> Column:
    """Y is true, N is false, anything else is NULL."""
    word = F.upper(stripped(c))
    return F.when(word == "Y", True).when(word == "N", False)


def yes_only_flag(c: Column) -> Column:
    """Y is true, everything else (NULL too) is false."""
    return F.coalesce(F.upper(stripped(c)) == "Y", F.lit(False))


def lenient_flag(c: Column) -> Column:
    """Word lists first, then any number but zero; other text is NULL."""
    word = F.lower(stripped(c.cast("string")))
    return (
        F.when(word.isin(*fv.TRUE_WORDS), True)
        .when(word.isin(*fv.FALSE_WORDS), False)
        .otherwise(word.try_cast("double") != 0)
    )


def money(c: Column, decimal: T.DecimalType = MONEY) -> Column:
    return stripped(F.replace(c, F.lit(","), F.lit(""))).try_cast(decimal)


def whole_number(c: Column) -> Column:
    """``12`` and ``-3`` pass; ``1.0`` is not a count and becomes NULL."""
    text = stripped(c)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def us_date(c: Column) -> Column:
    """Month/day/year text to a timestamp at midnight."""
    return F.try_to_timestamp(stripped(c), F.lit("M/d/yyyy"))


def iso_timestamp(c: Column) -> Column:
    """ISO text with a whole date, with or without a time part or a zone; all else is NULL.

    Spark alone would complete a bare time or year with parts of its own.
    """
    text = stripped(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(text))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


TYPED = {
    "text": null_if_missing,
    "count": whole_number,
    "money": money,
    "flag": yes_no_flag,
    "date": us_date,
}


def typed(c: Column, kind: str) -> Column:
    return TYPED[kind](c)
