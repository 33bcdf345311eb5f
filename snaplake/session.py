"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "snaplake", cpus: str = "*") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Without call-site capture, wide projections build several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session may fall back on a temporary folder; a cluster
    without ``spark.checkpoint.dir`` is a configuration error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="snaplake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses, below a folder of this application."""
    return os.path.join(shared_folder(spark), spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all that this application wrote below the shared folder.

    Results are read from there, so this is for the application's owner to call,
    once they are stored elsewhere; what a crashed application left behind has
    its id in the path.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_folder(spark), spark.sparkContext.applicationId))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames, once nothing will read them any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it once to the shared folder.

    The files survive lost executors and later plans read them instead of
    computing ``df`` again.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def materialise_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialise`` with aggregates that are taken while the rows are written."""
    seen = Observation()
    kept = materialise(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return kept, seen.get
