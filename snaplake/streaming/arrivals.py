"""Extract files picked up once each, as they arrive.

The same raw table as a batch load; Spark's own file-source log remembers
which files were taken, so a rerun with nothing new writes nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.sources.snapshots import CSV_OPTIONS, VERSION

VERSION_IN_PATH = r"([A-Za-z]{2}\d{8})"


QUARANTINE = "quarantine"
WRONG_ROW = "_wrong_row"


def load_arrivals(spark: SparkSession, folder: str, columns: list[str], table: str, progress: str) -> None:
    """Append new extract files to the raw table and stop.

    ``columns`` is the header (all text), ``progress`` a folder in shared
    storage.  The version label is the first one found in the file's path.  A
    file with another header stops the load with an error.  Rows with too many
    or too few fields, and files without a version in their path, are kept under
    the version ``quarantine``, whole rows in the column ``_wrong_row``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, WRONG_ROW]])
    version = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), VERSION_IN_PATH, 1), F.lit(""))
    arrivals = (
        spark.readStream.schema(schema).options(**CSV_OPTIONS).option("columnNameOfCorruptRecord", WRONG_ROW).csv(folder)
        .withColumn(VERSION, F.when(F.col(WRONG_ROW).isNull() & version.isNotNull(), version).otherwise(QUARANTINE))
    )
    query = (
        arrivals.writeStream.format("parquet").partitionBy(VERSION)
        .option("checkpointLocation", progress).option("path", table)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
