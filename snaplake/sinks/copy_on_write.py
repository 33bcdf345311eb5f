"""Keyed tables of immutable files, of which a change rewrites only those that hold a changed row.

A table is a folder of data files and of manifests.  A manifest lists the files of one
state with their rows; it is written after the files, and Spark marks it complete
last, so the newest complete manifest is the table, and a change that fails leaves the
state before it.  Files hold ranges of the keys, so keys that lie close are
in few files.  There is one writer at a time; a second one that ends later fails, as its manifest
exists already.  Key columns are never NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators.skew import lookup_join, newest_per_key
from snaplake.session import materialise_counted

# A file is sorted, written and read again by one task.
FILE_ROWS = 500_000


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def states(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete states, oldest first."""
    folder, fs = _folder(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return []
    numbers = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in numbers if fs.exists(_folder(spark, f"{root}/manifest/{n}/_SUCCESS")[0]))


def manifest(spark: SparkSession, root: str, state: int | None = None) -> DataFrame:
    """(file, rows) of a state, the newest one if none is named."""
    state = states(spark, root)[-1] if state is None else state
    return spark.read.schema("file string, rows long").parquet(f"{root}/manifest/{state:09d}")


def read_files(spark: SparkSession, root: str, state: int | None = None) -> DataFrame:
    """The table; the driver holds its file names, as for any table."""
    return spark.read.parquet(*[f"{root}/{r['file']}" for r in manifest(spark, root, state).orderBy("file").collect()])


def _file_of(root: str) -> Column:
    """The file of a row, relative to the table."""
    return F.regexp_extract("_metadata.file_path", r"(data/\d+/[^/]+)$", 1)


def _commit(rows: DataFrame, root: str, state: int, keys: Sequence[str], n: int, kept: DataFrame | None, file_rows: int) -> None:
    spark, name = rows.sparkSession, f"data/{state:09d}"
    rows.repartitionByRange(max(1, math.ceil(n / file_rows)), *keys).sortWithinPartitions(*keys).write.parquet(f"{root}/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/{name}").groupBy(_file_of(root).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # A file without rows still tells the columns of an empty table.
    if kept is None and not n:
        written = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{name}").select(_file_of(root).alias("file"), F.lit(0).cast("long").alias("rows"))
    (written if kept is None else written.unionByName(kept)).coalesce(1).write.parquet(f"{root}/manifest/{state:09d}")


def upsert_files(
    new: DataFrame, root: str, keys: Sequence[str], update: Sequence[str] | None = None, precedence: Column | None = None,
    replaced: Column | None = None, file_rows: int = FILE_ROWS,
) -> dict[str, int]:
    """Upsert ``new`` into the table at ``root``; returns rows changed, inserted and removed, and files rewritten.

    As ``tables.upserted``: a row that is there takes the ``update`` columns of the incoming one (all
    but the keys when not given; none for an empty list), unless ``precedence`` ranks it lower.  Of several
    incoming rows of a key one is taken, by their values.  With ``replaced`` the rows of the table that satisfy it and
    whose key does not come in are removed.  Rows that come out as they were count as unchanged;
    where nothing changes there is no new state.
    """
    keys, columns = list(keys), new.columns
    spark = new.sparkSession
    others = [F.col(c).desc_nulls_last() for c in columns if c not in keys]
    incoming, seen = materialise_counted(newest_per_key(new, keys, others or [F.lit(1)]), rows=F.count(F.lit(1)))
    known = states(spark, root)
    if not known:
        _commit(incoming, root, 1, keys, seen["rows"], None, file_rows)
        return {"changed": 0, "inserted": seen["rows"], "removed": 0, "files": 0}
    update = [c for c in columns if c not in keys] if update is None else list(update)
    rank = F.lit(0) if precedence is None else precedence
    held = read_files(spark, root).select(*columns, _file_of(root).alias("_file"), rank.alias("_rank"))
    side = incoming.select(*keys, F.struct(*columns, rank.alias("_rank")).alias("_in"))
    met = lookup_join(held, side, keys)
    takes = F.col("_in").isNotNull() & (F.col("_in._rank") >= F.col("_rank"))
    differs = reduce(or_, [~F.col(f"_in.{c}").eqNullSafe(F.col(c)) for c in update], F.lit(False))
    gone = F.col("_in").isNull() & F.coalesce(replaced, F.lit(False)) if replaced is not None else F.lit(False)
    marked = met.select(
        *keys, "_file", (takes & differs).alias("_changed"), gone.alias("_gone"), F.col("_in").isNotNull().alias("_known"),
    ).where("_changed OR _gone OR _known")
    marked, counts = materialise_counted(marked, changed=F.count_if("_changed"), removed=F.count_if("_gone"))
    inserted, more = materialise_counted(
        lookup_join(incoming, marked.where("_known").select(*keys), keys, "left_anti"), rows=F.count(F.lit(1))
    )
    result = {"changed": counts["changed"], "inserted": more["rows"], "removed": counts["removed"], "files": 0}
    if not (counts["changed"] or counts["removed"] or more["rows"]):
        return result
    listed = manifest(spark, root)
    touched = marked.where("_changed OR _gone").select(F.col("_file").alias("file")).distinct()
    old = {r["file"]: r["rows"] for r in listed.join(touched, "file", "left_semi").collect()}
    rows, n = inserted, more["rows"]
    if old:
        part = spark.read.schema(held.select(*columns).schema).parquet(*[f"{root}/{f}" for f in old]).select(*columns, rank.alias("_rank"))
        both = lookup_join(part, side, keys).where(~gone)
        after = [F.when(takes, F.col(f"_in.{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in columns]
        rows, n = both.select(*after).unionByName(inserted), n + sum(old.values())
    _commit(rows, root, known[-1] + 1, keys, n, listed.join(touched, "file", "left_anti"), file_rows)
    return {**result, "files": len(old)}


def drop_old_states(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` states and the files that only they held; returns how many files went."""
    known = states(spark, root)
    old, new = known[:-keep], known[-keep:]
    if not old:
        return 0
    listed = lambda numbers: reduce(DataFrame.unionByName, [manifest(spark, root, n) for n in numbers]).select("file").distinct()
    unused = [r["file"] for r in listed(old).subtract(listed(new)).collect()]
    for path in [f"{root}/manifest/{n:09d}" for n in old] + [f"{root}/{f}" for f in unused]:
        folder, fs = _folder(spark, path)
        fs.delete(folder, True)
    return len(unused)
