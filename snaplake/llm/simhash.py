"""SimHash near-duplicate classes found through a segment-popcount embedding.

A 64-bit fingerprint is cut into two halves and each half into segments of a few
bits.  The vector of bit counts per segment moves by at most one per flipped bit,
so its Manhattan distance is a lower bound of the Hamming distance.  If two
fingerprints differ in at most ``2 r`` bits, one half differs in at most ``r``,
and both of its count vectors then lie within ``r / 2`` of some common grid
point.  Every fingerprint is therefore sent to the grid points within that
radius, in either half, and only fingerprints that meet at a point are compared,
first by Manhattan distance of all counts and then exactly.  No link is lost.

Odd input: a null text is an empty one; a text without words has fingerprint
zero and is linked like any other; a null ``doc_id`` is kept as a row but never
names a class unless all rows of the class lack an id.  Further columns of the
input are ignored, repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import flat, per_batch, texts_of, tidied
from snaplake.llm.components import components
from snaplake.operators.skew import lookup_join
from snaplake.session import materialise

SEED = 42
#: More members of one grid point than this are compared block by block in separate tasks.
BLOCK = 2048
HALF = 32


def fingerprint(text: str, words: int = 4) -> int:
    """Bit ``b`` is set if more than half of the shingle hashes have it."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) > words:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
        n = len(parts) - words + 1
    else:
        shingles, n = [b" ".join(parts)], 1
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def majority(hashed: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n, ones = len(hashed), np.zeros(64, np.int64)
    # Pieces keep the unpacked bits small for very long texts.
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashed[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed 64-bit number."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(t, words) for t in texts_of(batch)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return step

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(picked, build, "doc_id long, fp long")


def segment_counts(half: np.ndarray, segment_bits: int) -> np.ndarray:
    """Bit counts per segment of 32-bit numbers, one row each."""
    at = np.arange(0, HALF, segment_bits, dtype=np.uint64)
    return np.bitwise_count((half[:, None] >> at) & np.uint64((1 << segment_bits) - 1)).astype(np.int8)


def grid_points(fps: np.ndarray, segment_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, fingerprint) for every grid point within ``radius`` of the counts of either half."""
    points, members = [], []
    for side in (0, 1):
        counts = segment_counts((fps.view(np.uint64) >> np.uint64(HALF * side)) & np.uint64(0xFFFFFFFF), segment_bits)
        m = counts.shape[1]
        # The number of a point: its coordinates written in base (segment_bits + 1), and the half it belongs to.
        base = np.array([(segment_bits + 1) ** i for i in range(m)], np.int64)
        number = counts.astype(np.int64) @ base
        moves = [()] + [c for k in range(1, radius + 1) for c in combinations_with_replacement(range(2 * m), k)]
        for move in moves:
            shift = np.zeros(m, np.int8)
            for axis in move:
                shift[axis // 2] += 1 if axis % 2 else -1
            if np.abs(shift).sum() != len(move):
                continue  # steps that undo each other were seen with fewer steps
            moved = counts + shift
            inside = ((moved >= 0) & (moved <= segment_bits)).all(axis=1)
            points.append((number[inside] + int(shift.astype(np.int64) @ base)) * 2 + side)
            members.append(fps[inside])
    return flat(points, np.int64), flat(members, np.int64)


def _close(a: np.ndarray, b: np.ndarray, segment_bits: int, bits: int) -> np.ndarray:
    """Which pairs link: the Manhattan bound of all segment counts first, then the Hamming distance."""
    low = np.zeros(len(a), np.int16)
    mask = np.uint64((1 << segment_bits) - 1)
    for at in range(0, 64, segment_bits):
        low += np.abs(
            np.bitwise_count((a >> np.uint64(at)) & mask).astype(np.int8)
            - np.bitwise_count((b >> np.uint64(at)) & mask).astype(np.int8)
        )
    near = np.flatnonzero(low <= bits)
    return near[np.bitwise_count(a[near] ^ b[near]) <= bits]


def _stars(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b between positions, reduced to one link per position to the smallest of its class."""
    low = np.arange(len(fps))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(fps)))
    return fps[moved], fps[low[moved]]


def linked_in_groups(group: np.ndarray, side: np.ndarray, fps: np.ndarray, segment_bits: int, bits: int):
    """Star links within runs of equal ``group``; pairs of two ``side`` 1 rows are left to another group."""
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(group)]))
    left, right, k = [], [], 1
    alive = np.arange(len(group))
    while True:
        alive = alive[alive + k < len(group)]
        alive = alive[run[alive] == run[alive + k]]
        if not len(alive):
            break
        here = alive[(side[alive] == 0) | (side[alive + k] == 0)]
        hit = here[_close(fps[here].view(np.uint64), fps[here + k].view(np.uint64), segment_bits, bits)]
        left.append(hit)
        right.append(hit + k)
        k += 1
    return _stars(fps, flat(left, np.int64), flat(right, np.int64))


def links(fps: DataFrame, bits: int = 4, segment_bits: int = 2) -> DataFrame:
    """Links (node, root) that join all fingerprints at ``bits`` or fewer differing bits into classes.

    ``fps`` holds distinct fingerprints in column ``fp``.  Two fingerprints are in
    one class of these links exactly if a chain of close ones joins them.
    """
    if HALF % segment_bits:
        raise ValueError("segments must divide a half evenly")
    radius = -(-(bits // 2) // 2)

    def spread():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            point, fp = grid_points(batch.column("fp").to_numpy(zero_copy_only=False), segment_bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(point), pa.array(fp)], ["point", "fp"])

        return step

    at = per_batch(fps.select("fp"), spread, "point long, fp long")
    crowded = materialise(at.groupBy("point").count().where(F.col("count") > BLOCK))
    if crowded.isEmpty():
        placed = at.select("point", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    else:
        # Blocks of a crowded point meet pairwise, each pair of blocks in a group of its own.
        mine = at.join(crowded, "point", "left").select(
            "point", "fp", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int").alias("blocks")
        ).withColumn("mine", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
        placed = mine.select("point", "fp", "mine", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
            "point", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
            F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "fp",
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            node, root = linked_in_groups(np.stack(rows[:3], axis=1), rows[3], rows[4], segment_bits, bits)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        held: list[np.ndarray] | None = None
        for batch in tidied(batches):
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            # The last group may go on in the next batch.
            differs = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = differs[-1] + 1 if len(differs) else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield found([r[:cut] for r in rows])
        if held is not None and len(held[0]):
            yield found(held)

    keys = ["point", "a", "b"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, root long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, segment_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the class of a document is the smallest id that links reach."""
    marked = materialise(fingerprints(docs, words))
    first = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = components(links(first, bits, segment_bits))
    linked = first.join(classes.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    named = linked.join(lowest, "root").select("fp", "lowest")
    by_fp = first.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    # A third of the documents may share one fingerprint.
    return lookup_join(marked, by_fp, ["fp"]).select("doc_id", "fp", "component_id")


def unique_rows(docs: DataFrame) -> DataFrame:
    """One document of each class of similar texts, with all its columns: the one with the smallest id.

    Similar are texts with a five-word Jaccard similarity of 0.8 or more, which is too far apart
    for a few bits of a fingerprint; fingerprints join copies, and ``similar`` finds the rest.
    Texts, not ids, are what is compared: rows that repeat an id with another text stand for
    themselves, and of rows equal in id and text one stays.  Documents without an id come after all others.
    """
    from snaplake.llm import similar

    key = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text": F.xxhash64(F.coalesce("text", F.lit("")))}
    names = list(key)
    keyed = docs.withColumns(key)
    numbered = keyed.withColumn("__row", F.xxhash64(*names))
    classes = similar.near_duplicates(numbered.select(F.col("__row").alias("row"), "text"))
    first = numbered.select("__row", F.struct(*names).alias("r")).join(classes.withColumnRenamed("row", "__row"), "__row").groupBy("class").agg(F.min("r").alias("r"))
    return keyed.join(materialise(first.select("r.*")), names, "left_semi").dropDuplicates(names).select(*docs.columns)


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
