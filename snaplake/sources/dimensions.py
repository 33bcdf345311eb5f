"""Small fixed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from snaplake import fixed_values as fv


def source_taxonomy(spark: SparkSession, types: Sequence[str] | None = None) -> DataFrame:
    rows = [r for r in fv.SOURCE_TAXONOMY if types is None or r[0] in types]
    return spark.createDataFrame(
        rows,
        "source_type string, source_authority string, source_title string, "
        "taxonomy_url string, collection_mode string, description string",
    )


def core_sources(spark: SparkSession) -> DataFrame:
    return source_taxonomy(spark, fv.CORE_SOURCE_TYPES)


def field_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.FIELD_DICTIONARY, "field string, item string, meaning string")


def category_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.CATEGORY_WEIGHTS, "category string, weight double")
