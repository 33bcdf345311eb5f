"""Inclusion dependencies between columns, and the foreign keys among them.

A column depends on another one if all its values occur there.  Values are
compared as text, NULL left out; a column without values depends on none and is
never referred to.  Each table is reduced to the distinct values of its columns
once.  Candidates by number, smallest and largest value are thinned out
on the values of a fixed share of the hash space, and only what is left is merged in full:
for each value the columns that hold it, for each such set of columns how often it
occurs, and every column of a set loses the candidates that are not in it.  No
pair of values is ever built, and a value is one row however often it occurs.
What reaches the driver is one row for each column and each pair of columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.operators.profile import value_counts
from snaplake.session import materialise

#: One value in so many takes part in the first merge.
SAMPLED = 64
PAIR = "table_name string, column_name string, referenced_table string, referenced_column string"


def _plain(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def column_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value, n) of all plain columns, NULL included."""
    parts = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if _plain(f.dataType)]
        if columns:
            parts.append(value_counts(df, columns).select(F.lit(name).alias("table_name"), "column_name", "value", "n"))
    return reduce(DataFrame.unionByName, parts)


def _contradicted(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` for which some value of column a does not occur in column b.

    ``values`` has (id, value), each once; ids are numbers of columns, so sets of them are small.
    """
    sets = values.groupBy("value").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    wanted = pairs.groupBy("a").agg(F.collect_set("b").alias("bs"))
    # As many rows as columns.
    judged = sets.select("ids", F.explode("ids").alias("a")).join(F.broadcast(wanted), "a")
    return judged.select("a", F.explode(F.array_except("bs", "ids")).alias("b")).distinct()


def inclusion_dependencies(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of different columns of which the first one's values all occur in the second one.

    Returns table_name, column_name, referenced_table, referenced_column, values (how many different
    ones the first has) and is_key (whether the second one has no NULL and no value twice).
    """
    spark = next(iter(tables.values())).sparkSession
    counts = materialise(column_values(tables))
    column = ["table_name", "column_name"]
    known = counts.groupBy(*column).agg(
        F.count("value").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
        (F.max(F.when(F.col("value").isNull(), F.lit(2)).otherwise(F.col("n"))) == 1).alias("is_key"),
    ).where("values > 0").orderBy(*column).collect()
    ids = spark.createDataFrame([(i, r["table_name"], r["column_name"]) for i, r in enumerate(known)], "id int, table_name string, column_name string")
    values = counts.where("value IS NOT NULL").join(F.broadcast(ids), column).select("id", "value")
    left = [
        (i, j) for i, a in enumerate(known) for j, b in enumerate(known)
        if i != j and a["values"] <= b["values"] and b["low"] <= a["low"] and a["high"] <= b["high"]
    ]
    some = values.where(F.pmod(F.xxhash64("value"), F.lit(SAMPLED)) == 0)
    for share in (some, values):
        if not left:
            break
        pairs = spark.createDataFrame(left, "a int, b int")
        inside = sorted({k for pair in left for k in pair})
        kept = share.join(F.broadcast(spark.createDataFrame([(k,) for k in inside], "id int")), "id", "left_semi")
        gone = {(r["a"], r["b"]) for r in _contradicted(kept, pairs).collect()}
        left = [pair for pair in left if pair not in gone]
    found = [
        (known[i]["table_name"], known[i]["column_name"], known[j]["table_name"], known[j]["column_name"], known[i]["values"], known[j]["is_key"])
        for i, j in left
    ]
    return spark.createDataFrame(found, f"{PAIR}, values long, is_key boolean")


def foreign_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Dependencies on a key of another table: (table_name, column_name, referenced_table, referenced_column, values)."""
    found = inclusion_dependencies(tables)
    return found.where("is_key AND table_name <> referenced_table").drop("is_key")


def entity_foreign_keys(entities: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Which column of each entity refers to the ``key`` column of the entity that owns it, as the data shows.

    The owner is an entity in which ``key`` is complete and unique; (entity, foreign_key, referenced_entity).
    """
    found = foreign_keys(entities).where(F.col("referenced_column") == key)
    return found.select(F.col("table_name").alias("entity"), F.col("column_name").alias("foreign_key"), F.col("referenced_table").alias("referenced_entity"))
