"""Raw roster text to typed firms, offices and acquired firms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake import fixed_values as fv
from snaplake.functions.keys import row_hash
from snaplake.functions.rules import violations
from snaplake.functions.typing import MONEY, null_if_missing, typed

SPARK_TYPE = {
    "text": T.StringType(), "count": T.LongType(), "money": MONEY,
    "flag": T.BooleanType(), "date": T.TimestampType(),
}
HASH = "_row_hash"


def _header(raw: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name and name in raw.columns else None


def _cell(raw: DataFrame, name: str, kind: str) -> Column:
    source = _header(raw, name)
    return F.lit(None).cast(SPARK_TYPE[kind]) if source is None else typed(source, kind)


def with_row_hash(raw: DataFrame) -> DataFrame:
    return raw.withColumn(HASH, row_hash(raw.columns))


def mapped(raw: DataFrame, mapping: Sequence[tuple[str, str, str]] = fv.FIRM_MAPPING) -> DataFrame:
    """Project a raw table through (target, header, type); no header means NULL."""
    kept = [HASH] if HASH in raw.columns else []
    return raw.select(*[_cell(raw, header, kind).alias(target) for target, header, kind in mapping], *kept)


def tracked(df: DataFrame, version: str, run_time: Column) -> DataFrame:
    """Tracking columns; one timestamp for the whole run."""
    return df.withColumns(
        {
            "dataset_version": F.lit(version),
            "created_timestamp": run_time,
            "source_dataset": F.lit(version),
            "record_hash": F.col(HASH) if HASH in df.columns else F.lit(None).cast("string"),
            "last_seen_version": F.lit(version),
            "current_status": F.lit("active"),
        }
    ).drop(HASH)


def missing_required(required: Sequence[str] = fv.REQUIRED_FIRM_FIELDS) -> Column:
    return violations(*[(f"missing {name}", F.col(name).isNull()) for name in required])


def split_required(df: DataFrame, required: Sequence[str] = fv.REQUIRED_FIRM_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined).  The second half keeps why a row was refused."""
    judged = df.withColumn("rejected_for", missing_required(required))
    return (
        judged.filter(F.size("rejected_for") == 0).drop("rejected_for"),
        judged.filter(F.size("rejected_for") > 0),
    )


def offices(raw: DataFrame, firm_id: str = "Organization CRD#") -> DataFrame:
    """One row per office column group whose first address line is present."""
    groups = []
    for office_type, prefix in fv.OFFICE_PREFIXES:
        fields = [F.lit(office_type).alias("office_type")]
        for target, suffix, kind, only in fv.OFFICE_FIELDS:
            header = f"{prefix} {suffix}" if not only or office_type in only else ""
            fields.append(_cell(raw, header, kind).alias(target))
        groups.append(F.struct(*fields))
    kept = [HASH] if HASH in raw.columns else []
    return (
        raw.select(null_if_missing(F.col(f"`{firm_id}`")).alias("firm_id"), *kept, F.array(*groups).alias("_offices"))
        .select("firm_id", *kept, F.inline(F.filter("_offices", lambda o: o["street_address_1"].isNotNull())))
    )


def acquired_firms(raw: DataFrame, mapping: Sequence[tuple[str, str]] = fv.ACQUIRED_MAPPING) -> DataFrame:
    """A child row for each roster row that names an acquired firm."""
    kept = [HASH] if HASH in raw.columns else []
    return raw.select(
        *[_cell(raw, header, "text").alias(target) for target, header in mapping], *kept
    ).filter("acquired_name IS NOT NULL")


def normalise_snapshot(raw: DataFrame, version: str, run_time: Column) -> dict[str, DataFrame]:
    """Firms, offices, acquired firms and quarantined rows of one raw snapshot.

    Children are taken from accepted rows only, in the same pass over the raw
    row, so no join back to the firms is needed.
    """
    hashed = with_row_hash(raw)
    accepted_firms, quarantine = split_required(mapped(hashed))
    spec = {target: header for target, header, _ in fv.FIRM_MAPPING}
    present = F.lit(True)
    for name in fv.REQUIRED_FIRM_FIELDS:
        present = present & null_if_missing(F.col(f"`{spec[name]}`")).isNotNull()
    accepted_raw = hashed.filter(present)
    return {
        "firms": tracked(accepted_firms, version, run_time),
        "firm_offices": tracked(offices(accepted_raw), version, run_time),
        "firm_acquired_firms": tracked(acquired_firms(accepted_raw), version, run_time),
        "quarantine": tracked(quarantine, version, run_time),
    }
