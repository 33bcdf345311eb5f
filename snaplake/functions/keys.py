"""Hashes, period keys, ages and version labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_MARK = "\x1f"
NULL_MARK = "\x1e"


def row_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of a row, independent of column order; NULL differs from empty."""
    cells = [
        F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(NULL_MARK))
        for name in sorted(columns)
    ]
    return F.sha2(F.concat_ws(FIELD_MARK, *cells), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def age_in_days(ts: Column, now: Column) -> Column:
    """Whole 24-hour days between two instants, rounded down."""
    return F.floor((micros(now) - micros(ts)) / F.lit(86_400_000_000)).cast("bigint")


def version_date(version: Column) -> Column:
    """The date inside a label such as ``ia07012026``; NULL when there is none."""
    return F.try_to_timestamp(F.substr(version, F.lit(3)), F.lit("MMddyyyy")).cast("date")


def pack_json(names: Iterable[str]) -> Column:
    """Several columns as one JSON object, NULL fields kept."""
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})


def json_codes(c: Column) -> Column:
    """A JSON list of codes; malformed text or another shape is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
