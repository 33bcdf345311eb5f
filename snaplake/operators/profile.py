"""Column and table profiles, for stored tables.

``value_counts`` turns a table into (column, value, rows), combined map-side.
Every column statistic is then computed from the distinct values and their
counts instead of from all rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake import fixed_values as fv
from snaplake.functions.text import name_class
from snaplake.session import materialise

# Tables are unpivoted this many columns at a time, to keep plans small.
CHUNK = 64
# Sketch precision (log2 of its buckets): about 1.6 % relative error.
SKETCH_LOG_K = 12


def type_names(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in columns}


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): each column's distinct values as text, NULL included.

    Columns of one type are unpivoted together, in chunks, and combined map-side
    in that type; only distinct values are turned into text.  Both zeros of a
    floating-point column are one value.
    """
    by_type: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    parts = []
    for kind, named in by_type.items():
        # A type that cannot be grouped is compared as text.
        grouped = kind if not kind.startswith(("map", "variant")) else "string"
        for start in range(0, len(named), CHUNK):
            cells = F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(grouped).alias("value")) for c in named[start:start + CHUNK]
            ])
            counts = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            parts.append(counts.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def _by_name(names: Sequence[str], yes: Column) -> Column:
    return F.col("column_name").isin(*names) & yes if names else F.lit(False)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: rows, nulls, empties, zeros, distinct values and two ratios.

    Exact distinct counts come from ``value_counts``.  ``approximate`` replaces
    them with a sketch of value hashes and needs no shuffle of values at all.
    """
    columns = list(columns or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if isinstance(fields[c], T.StringType)]
    numbers = [c for c in columns if _is_numeric(fields[c])]
    if approximate:
        stats = reduce(
            DataFrame.unionByName,
            [_sketch_profile(df, columns[i:i + CHUNK], texts, numbers) for i in range(0, len(columns), CHUNK)],
        )
    else:
        v = F.col("value")
        stats = value_counts(df, columns).groupBy("column_name").agg(
            F.sum("n").alias("total_rows"),
            F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.coalesce(
                F.sum(F.when(_by_name(texts, v.isNull() | (F.trim(v) == "")), F.col("n"))), F.lit(0)
            ).alias("empty_count"),
            F.coalesce(
                F.sum(F.when(_by_name(numbers, v.try_cast("double") == 0), F.col("n"))), F.lit(0)
            ).alias("zero_count"),
            F.count("value").alias("unique_values"),
        )
    filled = F.col("total_rows") - F.col("null_count")
    return stats.withColumns(
        {
            "completeness_pct": F.coalesce(F.round(F.try_divide(filled, F.col("total_rows")) * 100, 2), F.lit(0.0)),
            "distinctiveness_pct": F.coalesce(F.round(F.try_divide(F.col("unique_values"), filled) * 100, 2), F.lit(0.0)),
        }
    )


def _sketch_profile(df: DataFrame, columns: Sequence[str], texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for i, c in enumerate(columns):
        cell = F.col(f"`{c}`")
        aggs += [
            F.count_if(cell.isNull()).alias(f"null_{i}"),
            (F.count_if(cell.isNull() | (F.trim(cell) == "")) if c in texts else F.lit(0).cast("bigint")).alias(f"empty_{i}"),
            (F.count_if(cell == 0) if c in numbers else F.lit(0).cast("bigint")).alias(f"zero_{i}"),
            F.hll_sketch_estimate(
                F.hll_sketch_agg(F.when(cell.isNotNull(), F.xxhash64(cell)), F.lit(SKETCH_LOG_K))
            ).alias(f"distinct_{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col("total_rows"), F.col(f"null_{i}").alias("null_count"),
            F.col(f"empty_{i}").alias("empty_count"), F.col(f"zero_{i}").alias("zero_count"),
            F.col(f"distinct_{i}").alias("unique_values"),
        )
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def profile_totals(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.sum("total_rows").alias("total_cells"), F.sum("null_count").alias("null_cells")
    ).select(
        "total_cells", "null_cells", (F.col("total_cells") - F.col("null_cells")).alias("non_null_cells"),
        F.coalesce(F.round(F.try_divide(F.col("null_cells"), F.col("total_cells")) * 100, 2), F.lit(0.0)).alias("null_pct"),
    )


def row_uniqueness(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and groups of equal rows.

    What is grouped are fingerprints of 192 bits, so no row moves however wide the table is; at a
    trillion rows the chance that any two different ones share one is below 1e-33.
    """
    # NULL leaves a hash as it is, so it is counted in where it stands.
    cells = [x for c in df.columns for x in (_hashable(df, c), F.col(f"`{c}`").isNull())]
    marked = df.select(*[F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in ((0, "_a"), (1, "_b"), (2, "_c"))])
    groups = marked.groupBy("_a", "_b", "_c").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
    )


def _hashable(df: DataFrame, column: str) -> Column:
    """A cell whose hash is equal where a grouping would take it as equal: both zeros are one value, a map is its sorted entries."""
    kind, cell = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return cell + F.lit(0).cast(kind)
    return F.sort_array(F.map_entries(cell)) if isinstance(kind, T.MapType) else cell


def quality_score(profile: DataFrame, uniqueness: DataFrame) -> DataFrame:
    """0-100 score from cell completeness, row uniqueness and column means."""
    cells, rows, columns, distinct = fv.QUALITY_WEIGHTS
    means = profile.agg(F.struct(
        F.coalesce(F.round(F.try_divide(F.sum("null_count"), F.sum("total_rows")) * 100, 2), F.lit(0.0)).alias("null_pct"),
        F.coalesce(F.avg("completeness_pct"), F.lit(0.0)).alias("complete"),
        F.coalesce(F.avg("distinctiveness_pct"), F.lit(0.0)).alias("distinct"),
    ))
    unique_pct = F.coalesce(F.try_divide(F.col("distinct_rows"), F.col("total_rows")) * 100, F.lit(0.0))
    return uniqueness.withColumn("_m", means.scalar()).select(
        "total_rows", "distinct_rows", "duplicate_groups",
        F.round(
            (100 - F.col("_m.null_pct")) * cells + unique_pct * rows
            + F.col("_m.complete") * columns + F.col("_m.distinct") * distinct,
            2,
        ).alias("quality_score"),
    )


def rule_report(profile: DataFrame, score: DataFrame) -> DataFrame:
    """Three rules and a status that depends on the score only."""
    nulls_ok = profile.agg(F.coalesce(F.min("completeness_pct") >= fv.MIN_COLUMN_COMPLETENESS, F.lit(True)))
    report = score.select(
        nulls_ok.scalar().alias("null_threshold"),
        (F.col("quality_score") >= fv.MIN_QUALITY_SCORE).alias("quality_score_rule"),
        (F.col("total_rows") > 0).alias("data_presence"),
    )
    rules = [F.col(c).cast("bigint") for c in ("null_threshold", "quality_score_rule", "data_presence")]
    passed = reduce(Column.__add__, rules)
    return report.withColumns(
        {
            "validation_status": F.when(F.col("quality_score_rule"), "passed").otherwise("failed"),
            "total_rules": F.lit(len(rules)).cast("bigint"),
            "passed": passed,
            "failed": F.lit(len(rules)).cast("bigint") - passed,
        }
    )


def _holds(pattern: str) -> Column:
    return F.bool_and(F.when(F.col("value").isNotNull(), F.col("value").rlike(pattern)))


def column_patterns(values: DataFrame) -> DataFrame:
    """The first pattern that all non-NULL values of a column follow; NULL without values."""
    tests = values.groupBy("column_name").agg(
        _holds(r"^\p{Nd}+$").alias("digits"),
        _holds(r"^\p{L}+$").alias("letters"),
        _holds(r"^[\p{L}\p{Nd}]+$").alias("alnum"),
        F.bool_and(F.when(F.col("value").isNotNull(),
                          F.contains(F.col("value"), F.lit("@")) & F.contains(F.col("value"), F.lit(".")))).alias("email"),
        _holds(r"^\d{4}-\d{2}-\d{2}$").alias("iso_date"),
    )
    return tests.select(
        "column_name",
        F.when(F.col("digits").isNull(), None)
        .when(F.col("digits"), r"^\d+$")
        .when(F.col("letters"), "^[A-Za-z]+$")
        .when(F.col("alnum"), "^[A-Za-z0-9]+$")
        .when(F.col("email"), "email")
        .when(F.col("iso_date"), "date_iso")
        .otherwise("mixed").alias("pattern"),
    )


def sample_values(values: DataFrame, size: int = fv.SAMPLE_VALUES) -> DataFrame:
    """The first few distinct values of each column in text order.

    The limit per column is applied before the shuffle (window group limit),
    so a column with many values sends only ``size`` of them per partition.
    """
    w = W.partitionBy("column_name").orderBy("value")
    return (
        values.filter("value IS NOT NULL")
        .select("column_name", "value", F.row_number().over(w).alias("position"))
        .filter(F.col("position") <= size)
    )


def schema_profile(df: DataFrame, columns: Sequence[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """Per column: type, nullable, nulls, pattern and sample values."""
    columns = list(columns or df.columns)
    # Counts, patterns and samples read the distinct values, which are computed once.
    values = materialise(value_counts(df, columns)) if values is None else values
    counts = values.groupBy("column_name").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )
    # At most SAMPLE_VALUES rows per column reach this list.
    samples = sample_values(values).groupBy("column_name").agg(
        F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values")
    )
    types = F.create_map(*[F.lit(x) for pair in type_names(df, columns).items() for x in pair])
    return (
        counts.join(column_patterns(values), "column_name").join(samples, "column_name", "left")
        .select(
            "column_name", types[F.col("column_name")].alias("type"),
            (F.col("null_count") > 0).alias("nullable"), "null_count", "total_count",
            F.coalesce(F.round(F.try_divide(F.col("null_count"), F.col("total_count")) * 100, 2), F.lit(0.0)).alias("null_pct"),
            "pattern", F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        )
    )


def data_dictionary(schema: DataFrame, meanings: DataFrame | None = None) -> DataFrame:
    """Field descriptions and the constraints that the data suggests."""
    described = F.concat(
        F.col("column_name"), F.lit(" ("), F.col("type"), F.lit(")"),
        F.when(F.col("nullable"), " - nullable").otherwise(""),
    )
    constraints = F.array_compact(F.array(
        F.when(F.col("null_pct") == 100, "all_null").when(F.col("null_pct") > 50, "mostly_null"),
        F.concat(F.lit("pattern:"), F.col("pattern")),
    ))
    out = schema.select(
        "column_name", "type", described.alias("description"), "nullable", "pattern", "sample_values",
        F.array_join(constraints, "|").alias("constraints"),
    )
    if meanings is None:
        return out
    return out.join(meanings, out["column_name"] == meanings["field"], "left").drop("field")


def key_discovery(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and blank keys; keys are grouped first, so no key is hot."""
    keys = df.groupBy(F.col(f"`{key}`").cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    blank = F.col("_k").isNull() | (F.trim("_k") == "")
    return keys.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count("_k").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).alias("blank_keys"),
    )


def classify_names(names: DataFrame, column: str) -> DataFrame:
    return names.withColumn("name_class", name_class(F.col(column)))


def entity_attributes(names: DataFrame, column: str) -> DataFrame:
    """(entity, attribute, key_column, foreign_key, description): which names each suggested entity takes, and how it refers to the firm."""
    rules = [
        (entity, name_class_, key, out or "", *fv.ENTITY_TEXTS[entity])
        for entity, classes, key, out in fv.ENTITY_RULES for name_class_ in classes
    ]
    rules = names.sparkSession.createDataFrame(
        rules, "entity string, name_class string, key_column string, left_out string, foreign_key string, description string"
    )
    distinct = classify_names(names.select(column).distinct(), column)
    return (
        distinct.join(F.broadcast(rules), "name_class")
        .filter((F.col("left_out") == "") | ~F.regexp_like(F.col(column), F.col("left_out")))
        .select("entity", F.col(column).alias("attribute"), "key_column", "foreign_key", "description")
    )


def profile_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """Column profiles of several tables as one table."""
    return reduce(
        DataFrame.unionByName,
        [column_profile(df).withColumn("table_name", F.lit(name)) for name, df in frames.items()],
    )


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """Documents in all and the distinct report types (a closed list of names)."""
    return artifacts.agg(
        F.count(F.lit(1)).alias("artifact_count"),
        F.array_join(F.sort_array(F.collect_set("artifact_type")), "|").alias("artifact_types"),
    )
