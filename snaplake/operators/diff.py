"""Snapshot, schema and fingerprint differences.

Keys must be unique in each snapshot (``quality.duplicate_keys`` shows those
that are not).  Both sides are joined once; every result below is read off
that join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.operators.skew import lookup_join
from snaplake.session import materialise


def compared_columns(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns of both sides without keys and tracking columns."""
    skip = {*keys, *fv.TRACKING_FIELDS}
    return [c for c in new.columns if c in set(old.columns) and c not in skip]


def _paired(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str) -> DataFrame:
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *[F.col(f"`{k}`") for k in keys], F.lit(True).alias(f"_{tag}"),
            *[F.col(f"`{c}`").alias(f"_{tag}_{i}") for i, c in enumerate(columns)],
        )

    return side(old, "old").join(side(new, "new"), list(keys), how)


def _any_change(columns: Sequence[str]) -> Column:
    changes = [~F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}")) for i in range(len(columns))]
    return reduce(or_, changes) if changes else F.lit(False)


def key_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with its state: added, removed, modified or unchanged."""
    columns = compared_columns(old, new, keys)
    state = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(_any_change(columns), "modified")
        .otherwise("unchanged")
    )
    return _paired(old, new, keys, columns, "full").select(*keys, state.alias("change"))


def cell_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per changed cell of a common key: column, old and new value as text."""
    columns = compared_columns(old, new, keys)
    cells = F.array_compact(F.array(*[
        F.when(
            ~F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}")),
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_old_{i}").cast("string").alias("old_value"),
                F.col(f"_new_{i}").cast("string").alias("new_value"),
            ),
        )
        for i, c in enumerate(columns)
    ]))
    both = _paired(old, new, keys, columns, "inner").filter(_any_change(columns))
    return both.select(*keys, F.inline(cells))


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common keys of rows that differ, found by 128-bit row hashes: of a wide row only its key and hash move."""
    columns = compared_columns(old, new, keys)

    def hashed(df: DataFrame, tag: str) -> DataFrame:
        # NULL leaves a hash as it is, so it is counted in where it stands.
        cells = [F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in columns]
        return df.select(*[F.col(f"`{k}`") for k in keys], F.struct(F.xxhash64(F.lit(0), *cells), F.xxhash64(F.lit(1), *cells)).alias(tag))

    return hashed(old, "_old").join(hashed(new, "_new"), list(keys)).where("_old <> _new").select(*keys)


def cell_changes_by_hash(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cell_changes`` for wide snapshots of which little changed: cells are only looked at where row hashes differ."""
    changed = materialise(changed_keys(old, new, keys))
    return cell_changes(lookup_join(old, changed, keys, "left_semi"), lookup_join(new, changed, keys, "left_semi"), keys)


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[
        F.count_if(F.col("change") == c).alias(f"{c}_count") for c in ("added", "removed", "modified", "unchanged")
    ])


def column_names(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name) rows of a frame's schema."""
    return df.sparkSession.createDataFrame(
        [(table, c) for c in df.columns], "table_name string, column_name string"
    )


def schema_drift(expected: DataFrame, found: DataFrame, column: str = "column_name") -> tuple[DataFrame, DataFrame]:
    """(missing, extra) names; both sides must speak of source headers."""
    return expected.select(column).subtract(found.select(column)), found.select(column).subtract(expected.select(column))


def fingerprint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables and columns that appeared or went, by name, from (table_name, column_name) rows."""
    tables_old, tables_new = old.select("table_name").distinct(), new.select("table_name").distinct()
    no_column = F.lit(None).cast("string").alias("column_name")

    def rows(df: DataFrame, change: str, column: Column | str) -> DataFrame:
        return df.select("table_name", column, F.lit(change).alias("change"))

    pair = ["table_name", "column_name"]
    common = tables_old.intersect(tables_new)
    added = new.select(*pair).distinct().join(old.select(*pair), pair, "left_anti").join(common, "table_name", "left_semi")
    removed = old.select(*pair).distinct().join(new.select(*pair), pair, "left_anti").join(common, "table_name", "left_semi")
    return reduce(DataFrame.unionByName, [
        rows(tables_new.subtract(tables_old), "new_table", no_column),
        rows(tables_old.subtract(tables_new), "missing_table", no_column),
        rows(added, "added_column", "column_name"),
        rows(removed, "removed_column", "column_name"),
    ])
