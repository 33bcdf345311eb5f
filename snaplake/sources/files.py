"""Report artifacts, logs, filings and file fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.functions.keys import FIELD_MARK, NULL_MARK
from snaplake.functions.text import plain_path
from snaplake.functions.typing import iso_timestamp, missing_tokens_to_null
from snaplake.operators.skew import with_positions
from snaplake.session import materialise, materialise_counted

ARTIFACT_SCHEMA = T.StructType(
    [
        T.StructField("summary", T.StructType([
            T.StructField("quality_score", T.DoubleType()),
            T.StructField("passed", T.LongType()),
            T.StructField("failed", T.LongType()),
            T.StructField("added_count", T.LongType()),
            T.StructField("removed_count", T.LongType()),
            T.StructField("modified_count", T.LongType()),
        ])),
        T.StructField("quality", T.StructType([
            T.StructField("quality_score", T.DoubleType()),
            T.StructField("checks_passed", T.LongType()),
            T.StructField("checks_failed", T.LongType()),
        ])),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("extra", T.ArrayType(T.StringType())),
        T.StructField("artifact_id", T.LongType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("_corrupt_record", T.StringType()),
        T.StructField("artifact_type", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
    ]
)


def scan_artifacts(spark: SparkSession, root: str, one_per_file: bool = False) -> DataFrame:
    """Report documents below ``artifact_type=/dataset_version=`` folders.

    Unreadable documents are left out.  Type and version come from the path,
    so a filter on either one prunes folders.  ``one_per_file`` reads files
    that hold one document over many lines.
    """
    return (
        spark.read.schema(ARTIFACT_SCHEMA)
        .option("multiLine", one_per_file).option("mode", "PERMISSIVE").option("basePath", root)
        .json(root)
        .withColumn("source_file", F.col("_metadata.file_path"))
        .withColumn("written_at", F.coalesce("written_at", F.col("_metadata.file_modification_time")))
        .filter(F.col("_corrupt_record").isNull())
        .drop("_corrupt_record")
    )


def flat_artifacts(documents: DataFrame) -> DataFrame:
    """Scanned documents as the flat rows that ``rollup.dataset_summaries`` takes.

    Quality numbers stand in the summary of a quality report and in the quality
    part of a profile; a schema difference counts its missing and extra columns.
    A document without an id gets one from its file.
    """
    kind = F.col("artifact_type")
    quality, profile = (kind == "quality"), (kind == "profiling")
    differs = (kind == "schema_diff") & (F.col("missing").isNotNull() | F.col("extra").isNotNull())

    def counted(c: str):
        return F.when(differs, F.coalesce(F.size(c), F.lit(0)).cast("bigint")).alias(c)

    def told(of_quality: str, of_profile: str, name: str):
        return F.when(quality, F.col(f"summary.{of_quality}")).when(profile, F.col(f"quality.{of_profile}")).alias(name)

    changes = kind == "change_detection"
    return documents.select(
        "dataset_version", "artifact_type", F.coalesce("artifact_id", F.xxhash64("source_file")).alias("artifact_id"), "written_at",
        told("quality_score", "quality_score", "quality_score"), told("passed", "checks_passed", "passed"),
        told("failed", "checks_failed", "failed"), counted("missing"), counted("extra"),
        F.when(changes, F.col("summary.added_count")).alias("added"), F.when(changes, F.col("summary.modified_count")).alias("modified"),
    )


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``time | level | message`` lines; a line with fewer parts is left out."""
    parts = F.split(F.col(column), r" \| ", 3)
    return (
        lines.filter(F.size(parts) >= 3)
        .select(parts[0].alias("ts"), parts[1].alias("level"), parts[2].alias("message"))
    )


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def filings(raw: DataFrame) -> DataFrame:
    """Filing metadata rows from a historical filing extract (all text)."""
    clean = missing_tokens_to_null(raw)
    return clean.select(
        F.col("`Organization CRD#`").alias("firm_id"),
        F.col("`Organization CRD#`").alias("crd_number"),
        iso_timestamp(F.col("`Latest ADV Filing Date`")).alias("filing_date"),
        F.col("`Form Version`").alias("form_version"),
        F.sha2(F.concat_ws(FIELD_MARK, *[F.coalesce(F.col(f"`{c}`"), F.lit(NULL_MARK)) for c in sorted(raw.columns)]), 256)
        .alias("content_hash"),
        F.lit("REGISTERED").alias("retrieval_status"),
    ).filter("firm_id IS NOT NULL AND filing_date IS NOT NULL")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: header columns, data rows, bytes and a content hash.

    Files are read as splittable text, so a file of any size is hashed by many
    tasks: line hashes are combined by operations whose order does not matter
    (bit xor and sum), together with the line count and the size.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
        .select(
            "value",
            F.xxhash64("value").alias("_h"),
            F.monotonically_increasing_id().alias("_position"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    cell = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'
    per_file = lines.groupBy("file_path", "file_name", "file_size").agg(
        (F.count(F.lit(1)) - 1).alias("row_count"),
        F.min_by("value", F.struct("_block", "_position")).alias("_header"),
        F.bit_xor("_h").alias("_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).alias("_sum"),
    )
    header = F.col("_header")
    cells = F.regexp_extract_all(header, F.lit(cell), F.lit(1))
    # The pattern also matches the empty end of the line once.
    cells = F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1)))
    return per_file.select(
        "file_name", "file_size", "row_count",
        F.transform(cells, lambda c: F.regexp_replace(c, '^"|"$', "")).alias("column_names"),
        F.sha2(F.concat_ws("|", "file_size", "row_count", "_xor", "_sum"), 256).alias("file_hash"),
    ).withColumn("column_count", F.size("column_names").cast("bigint"))


def ordered_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str, fan: int = 1024) -> DataFrame:
    """One digest per key over its ``digest`` texts in order: a tree in which ``fan`` of them become one.

    A single digest stays what it is.  A task holds ``fan`` digests at a time, however many a key has.
    """
    keys = list(keys)
    level, seen = materialise_counted(with_positions(rows.select(*keys, *order, digest), keys, order, "_place"), last=F.max("_place"))
    level = level.select(*keys, "_place", F.col(digest).alias("_digest"))
    while (seen["last"] or 0) > 0:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_digest"))), lambda x: x["_digest"]), "")
        upper = level.groupBy(*keys, F.expr(f"_place div {fan}").alias("_above")).agg(
            F.when(F.max("_place") > 0, F.sha2(joined, 256)).otherwise(F.max("_digest")).alias("_digest")
        ).withColumnRenamed("_above", "_place")
        level, seen = materialise_counted(upper, last=F.max("_place"))
    return level.select(*keys, F.col("_digest").alias(digest))


def byte_hashes(spark: SparkSession, path: str, chunk: int = 1 << 18) -> DataFrame:
    """One row per file with a hash of its bytes, so other line ends or another order are another file.

    A file of any size is read in splits by many tasks.  Lines get their offsets from the
    bytes before them, the lines that begin in the same ``chunk`` bytes are hashed in order, and
    the chunks' hashes in a tree; the size of the file tells whether its last line ends.  How
    the file was split leaves no trace.  One line must fit into memory; a file without a byte has no row.
    """
    option = ("pathGlobFilter", "*.[cC][sS][vV]")
    lines = spark.read.option(*option).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), (F.octet_length("value") + 1).cast("long").alias("_bytes"), F.sha2("value", 256).alias("_hash"),
    )
    lines = materialise(lines)
    split = ["file_path", "_block"]
    # One row per split of a file.
    along = W.partitionBy("file_path").orderBy("_block")
    before = lines.groupBy(*split).agg(F.sum("_bytes").alias("_all")).select(*split, (F.sum("_all").over(along) - F.col("_all")).alias("_before"))
    inside = F.sum("_bytes").over(W.partitionBy(*split).orderBy("_line")) - F.col("_bytes")
    placed = lines.withColumn("_inside", inside).join(before, split).withColumn("_chunk", F.floor((F.col("_before") + F.col("_inside")) / chunk))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_line", "_hash"))), lambda x: x["_hash"])
    chunks = placed.groupBy("file_path", "_chunk").agg(F.sha2(F.array_join(in_order, ""), 256).alias("_digest"))
    roots = ordered_digest(chunks, ["file_path"], ["_chunk"], "_digest")
    # Only names and sizes are read here.
    found = spark.read.format("binaryFile").option(*option).load(path).select(
        "_metadata.file_path", "_metadata.file_name", F.col("length").alias("file_size")
    )
    return found.join(roots, "file_path").select(
        plain_path(F.col("file_name")).alias("file_name"), "file_path", "file_size", F.sha2(F.concat_ws(":", F.col("file_size").cast("string"), F.col("_digest")), 256).alias("byte_hash"),
    )


def dataset_bytes(files: DataFrame) -> DataFrame:
    """One row for all files of ``byte_hashes``, in the order of their paths."""
    return ordered_digest(files.withColumn("_all", F.lit(0)), ["_all"], ["file_path"], "byte_hash").select("byte_hash")


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One row for a whole extract, whatever the order and number of its files."""
    whole = files.agg(F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("row_count"))
    named = files.withColumns({"_all": F.lit(0), "_order": F.col("file_hash")})
    content = ordered_digest(named, ["_all"], ["_order"], "file_hash").select(F.col("file_hash").alias("content_hash"))
    # One row on either side.
    return whole.withColumn("_all", F.lit(0)).join(content.withColumn("_all", F.lit(0)), "_all", "left").drop("_all")
