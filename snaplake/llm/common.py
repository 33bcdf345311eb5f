"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a worker turns into Python objects together.
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_package(df: DataFrame) -> DataFrame:
    """Tell Python workers where this package lies, for sessions that were started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on, and the next stage's need room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; memory is given back after the last."""
    yield from batches
    give_back()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-empty pieces of at most ``ROWS_AT_ONCE`` rows; a worker gives back what a batch took before it reads on."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(begin, ROWS_AT_ONCE)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def per_batch(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """Run a function over pieces of ``df``; ``build`` makes it once per task, so that it may keep caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for piece in _slices(batches):
            yield step(piece)

    return with_package(df).mapInArrow(run, schema)


def per_task(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run a function that sees all pieces of a task one after the other, and may sum them up."""
    return with_package(df).mapInArrow(lambda batches: run(_slices(batches)), schema)


def kept_rows(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df`` that a function says to keep, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = build()
        for piece in _slices(batches):
            yield piece.filter(pa.array(judge(piece), pa.bool_()))

    return with_package(df).mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def bucket_of(id_column: str, buckets: int) -> Column:
    """The CRC-32 of an id written as text, modulo ``buckets``; a null id falls into bucket 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % buckets, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Labelled documents (doc_id, text, label), at most ``rows`` of them, spread evenly by a hash of the id.

    The sample of labels is bounded by ``rows``, so it may be broadcast to the documents.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def flat(lists: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, dtype)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from rows sorted by ``keys``, which hold no null."""
    held: pa.Table | None = None
    for batch in tidied(batches):
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        same = None
        for k in keys:
            equal = pc.equal(rows.column(k), rows.column(k)[-1])
            same = equal if same is None else pc.and_(same, equal)
        cut = rows.num_rows - pc.sum(same).as_py()
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if held is not None and held.num_rows:
        yield held
