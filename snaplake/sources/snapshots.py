"""Raw extracts and stored snapshots."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.functions.keys import version_date
from snaplake.functions.text import plain_path

VERSION = "dataset_version"
CSV_OPTIONS = {
    "header": True, "encoding": "ISO-8859-1", "escape": '"', "multiLine": False,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "pathGlobFilter": "*.[cC][sS][vV]", "inferSchema": False,
    # A file whose header is another one is an error, not a shift of columns.
    "enforceSchema": False,
}


def scan_csv(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    """One extract file or a folder of files with the same header, all text.

    A file with newlines inside quotes cannot be split, so ``quoted_newlines``
    costs one task per file; leave it off for extracts that have none.
    """
    return spark.read.options(**{**CSV_OPTIONS, "multiLine": quoted_newlines}).csv(path)


def scan_csv_folder(spark: SparkSession, folder: str, quoted_newlines: bool = False) -> dict[str, DataFrame]:
    """One frame per CSV file stem.  Only file names reach the driver."""
    names = (
        spark.read.format("binaryFile").option("pathGlobFilter", CSV_OPTIONS["pathGlobFilter"])
        .load(folder).select("path").orderBy("path").collect()
    )
    frames = {}
    for (path,) in names:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        frames[stem] = scan_csv(spark, path, quoted_newlines)
    return frames


def header_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The CSV files of a folder by their first line, from one job; file names reach the driver, as they do for any scan."""
    lines = spark.read.option("pathGlobFilter", CSV_OPTIONS["pathGlobFilter"]).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("place"), "value"
    )
    firsts = lines.where("place.file_block_start = 0").groupBy("path").agg(F.min_by("value", "place").alias("header"))
    found: dict[str, list[str]] = {}
    for path, header in firsts.orderBy("path").collect():
        # The metadata writes paths as URIs.
        found.setdefault(header, []).append(unquote(path))
    return found


def scan_csv_union(spark: SparkSession, folder: str, quoted_newlines: bool = False) -> DataFrame:
    """All files of a folder as one table, each read by its own header; a column that a file lacks is NULL.

    Files of one header are one scan, so the plan grows with the different headers and not with the files.
    A file without a line has no rows.
    """
    scans = [
        spark.read.options(**{**CSV_OPTIONS, "multiLine": quoted_newlines}).csv(paths)
        .withColumn("source_file", F.regexp_replace(plain_path(F.col("_metadata.file_name")), r"\.[^.]*$", ""))
        for paths in header_files(spark, folder).values()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def scan_entity(spark: SparkSession, path: str) -> DataFrame:
    """Every stored snapshot of an entity, older ones missing new columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def scan_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One snapshot; the filter prunes to its folder."""
    return spark.read.parquet(path).filter(F.col(VERSION) == version)


def list_versions(entity: DataFrame) -> DataFrame:
    """Snapshots of an entity with their date and row count, for time order."""
    return entity.groupBy(VERSION).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "version_date", version_date(F.col(VERSION))
    )


def union_snapshots(*snapshots: DataFrame) -> DataFrame:
    """All snapshots as one table; a column that one of them lacks is NULL there."""
    first, *rest = snapshots
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def column_sample(df: DataFrame, name: str, rows: int = 100) -> DataFrame:
    """Some non-NULL values of one column (which ones is not defined)."""
    return df.select(F.col(f"`{name}`").cast(T.StringType()).alias("value")).filter("value IS NOT NULL").limit(rows)


def newest_version(versions: DataFrame, order: Column) -> DataFrame:
    """One row: the newest version label."""
    return versions.agg(F.max_by(VERSION, order).alias(VERSION))
