"""Nearest vectors by largest inner product: inverted lists scanned by adaptive dimension sampling.

Vectors get one more component that makes all of them equally long, so that the
largest inner product is the smallest distance, and are then rotated at random.
Each is kept in the list of its nearest centre.  A query scans the lists of its
nearest centres: distances grow over blocks of rotated components, and after
each block a hypothesis test drops candidates whose distance so far says that
they will not come among the nearest.  What is left is compared exactly, in double
precision on the original vectors.  How many lists a query scans is set on a
sample, so that the wanted recall is reached there.

Equal vectors are searched for once and joined back by id, so a vector that very
many rows share costs no more than another.

Odd input: rows take no part if their id or vector is null, if the vector is
zero, or if it has a null or non-finite component or another length than most.
Other columns of the input are ignored; an id that occurs twice with one vector
counts once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.common import per_batch
from snaplake.session import materialise

#: Vectors that centres and the number of scanned lists are fitted on.
SAMPLE, TRIALS = 20_000, 256
#: Lists: one for so many vectors, within these bounds.
PER_LIST, FEWEST, MOST = 800, 8, 2048
#: Vectors and queries that meet in one task.
TASK_VECTORS, TASK_QUERIES = 20_000, 20_000
#: The wanted recall on the sample, and how sure a candidate must be to fail before it is dropped.
RECALL, SURE = 0.965, 2.1
COLUMNS = 16
#: Share of candidates up to which they are followed one by one.
DENSE = 0.05
#: Further candidates that are compared exactly, beyond the wanted number.
SPARE = 12
#: Query-candidate pairs that are held at once.
CELLS = 4_000_000


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part, each pair once."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Model:
    """Centres, rotation, and where the vectors of a list go."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, k: int):
        rng = np.random.default_rng(7)
        self.longest = longest
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x = self.turned(sample)
        lists = int(min(max(FEWEST, rows // PER_LIST), MOST, len(x)))
        self.centres = x[rng.choice(len(x), lists, replace=False)].copy()
        for _ in range(10):
            at = self.order(x, 1)[:, 0]
            total = np.zeros_like(self.centres)
            np.add.at(total, at, x)
            n = np.bincount(at, minlength=lists)
            self.centres[n > 0] = total[n > 0] / n[n > 0, None]
        self.probes = self._probes(sample, x, k)
        self.first, self.blocks = np.zeros(lists, np.int64), np.ones(lists, np.int64)

    def turned(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Rotated vectors with the component that evens out their lengths; queries get none."""
        rest = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32) @ self.rotation

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest centres of every row, nearest first."""
        far = (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)
        return np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(axis=1)[:, None]

    def _probes(self, sample: np.ndarray, x: np.ndarray, k: int) -> int:
        """Lists to scan so that the sample's own nearest are found at the wanted rate."""
        trial = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        value = sample[trial] @ sample.T
        value[np.arange(len(trial)), trial] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centres)
        near = np.argpartition(-value, k - 1, axis=1)[:, :k]
        order = self.order(self.turned(sample[trial], queries=True), len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        at = np.sort(np.take_along_axis(place, self.order(x, 1)[:, 0][near], axis=1).ravel())
        return int(at[min(len(at) - 1, math.ceil(RECALL * len(at)))]) + 1

    def pack(self, counts: dict[int, int]) -> None:
        """Put neighbouring lists together into groups of bounded size; a larger list is spread over several."""
        group, room = -1, 0
        for i in range(len(self.centres)):
            n = counts.get(i, 0)
            if n > TASK_VECTORS:
                self.first[i], self.blocks[i] = group + 1, -(-n // TASK_VECTORS)
                group, room = group + self.blocks[i], 0
            else:
                if n > room:
                    group, room = group + 1, TASK_VECTORS
                self.first[i], room = max(group, 0), room - n


def scan(vectors: np.ndarray, lists: np.ndarray, ids: np.ndarray, queries: np.ndarray, probes: np.ndarray, model: Model, k: int):
    """(query, vector id, score) of the nearest found by each query among the vectors of its lists."""
    order = np.lexsort((ids, lists))
    vectors, lists, ids = vectors[order], lists[order], ids[order]
    x, q = model.turned(vectors), model.turned(queries, queries=True)
    d, wide = x.shape[1], k + SPARE
    best = np.full((len(q), wide), np.inf, np.float32)
    which = np.zeros((len(q), wide), np.int64)
    names, begins = np.unique(lists, return_index=True)
    ends = np.r_[begins[1:], len(lists)]
    probed = np.zeros((len(q), len(names)), bool)
    for i, name in enumerate(names):
        probed[:, i] = (probes == name).any(axis=1)
    for i in range(len(names)):
        asking = np.flatnonzero(probed[:, i])
        step = max(1, min(256, CELLS // max(1, len(asking))))
        for a in range(begins[i], ends[i], step):
            b = min(a + step, ends[i])
            if len(asking):
                _scan_block(x[a:b], a, q, asking, best, which, d, k)
    found = np.isfinite(best)
    row, col = np.nonzero(found)
    pick = which[row, col]
    score = np.empty(len(row))
    for a in range(0, len(row), 100_000):
        part = slice(a, a + 100_000)
        # Row sums add in one order wherever the row stands, so equal vectors score equal.
        score[part] = (vectors[pick[part]] * queries[row[part]]).sum(axis=1)
    order = np.lexsort((ids[pick], -score, row))
    row, pick, score = row[order], pick[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = place < k
    return row[keep], ids[pick[keep]], score[keep]


def _scan_block(x: np.ndarray, offset: int, q: np.ndarray, asking: np.ndarray, best: np.ndarray, which: np.ndarray, d: int, k: int) -> None:
    """Scan some vectors of a list for all queries that ask for it, and note what is nearer than before."""
    # The k-th nearest so far; what is spare beyond it need not be kept exact.
    limit = np.partition(best[asking], k - 1, axis=1)[:, k - 1]
    near = np.zeros((len(asking), len(x)), np.float32)
    done, alive = 0, near.size
    while done < d and alive > DENSE * near.size:
        # While many candidates are left, a block of columns is one matrix product.
        part = slice(done, done + COLUMNS)
        left, right = q[asking, part], x[:, part]
        near += (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None] - 2 * (left @ right.T)
        done = min(done + COLUMNS, d)
        stays = near <= _bound(limit, done, d)[:, None]
        alive = np.count_nonzero(stays)
    row, col = np.nonzero(stays)
    far = near[row, col]
    while done < d and len(row):
        more = slice(done, done + COLUMNS)
        far += ((q[asking[row], more] - x[col, more]) ** 2).sum(axis=1)
        done = min(done + COLUMNS, d)
        keep = far <= _bound(limit[row], done, d)
        row, col, far = row[keep], col[keep], far[keep]
    if not len(row):
        return
    touched, at = np.unique(row, return_inverse=True)
    full = np.full((len(touched), len(x)), np.inf, np.float32)
    full[at, col] = far
    rows = asking[touched]
    joined = np.concatenate([best[rows], full], axis=1)
    from_ = np.concatenate([which[rows], np.broadcast_to(np.arange(offset, offset + len(x)), full.shape)], axis=1)
    top = np.argpartition(joined, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
    best[rows], which[rows] = np.take_along_axis(joined, top, axis=1), np.take_along_axis(from_, top, axis=1)


def _bound(limit: np.ndarray, done: int, d: int) -> np.ndarray:
    """The squared distance over ``done`` components beyond which a candidate is taken to fail ``limit``."""
    if done == d:
        return limit
    return limit * (done / d) * (1 + SURE / math.sqrt(done)) ** 2


def nearest(vectors: DataFrame, queries, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row for which ``queries`` holds.

    ``queries`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_column, vector_column))
    place = Window.partitionBy("v").orderBy("id")
    # Of equal vectors the first k + 1 ids can be among the nearest, and one of them stands for all.
    members = materialise(
        rows.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
        .withColumn("rep", F.min("id").over(Window.partitionBy("v"))).select("id", "rep", "v")
    )
    reps = members.where("id = rep").select("rep", "v")
    about = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2)).alias("m")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not about["n"]:
        return empty
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
    model = Model(_matrix(sample.column("v")), math.sqrt(about["m"]), about["n"], k + 1)

    def listed():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = model.order(model.turned(_matrix(batch.column("v"))), 1)[:, 0]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["rep", "v", "list"])

        return step

    kind = reps.schema["v"].dataType.simpleString()
    base = materialise(per_batch(reps, listed, f"rep long, v {kind}, list int"))
    model.pack({r["list"]: r["count"] for r in base.groupBy("list").count().collect()})
    own = rows.where(queries)
    asked = own.groupBy("v").agg(F.min("id").alias("qid"))
    blocks = -(-own.count() // TASK_QUERIES) or 1

    def routed():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            probes = model.order(model.turned(_matrix(batch.column("v")), queries=True), model.probes).astype(np.int32)
            groups = [
                np.unique(np.concatenate([np.arange(model.first[i], model.first[i] + model.blocks[i]) for i in own])).tolist()
                for own in probes
            ]
            return pa.RecordBatch.from_arrays(
                [batch.column("qid"), batch.column("v"), pa.array(list(probes), pa.list_(pa.int32())), pa.array(groups, pa.list_(pa.int64()))],
                ["qid", "v", "probes", "groups"],
            )

        return step

    sent = per_batch(asked.select("qid", "v"), routed, f"qid long, v {kind}, probes array<int>, groups array<long>").select(
        F.explode("groups").alias("group"), F.expr(f"cast(pmod(xxhash64(qid), {blocks}) as int)").alias("block"), "qid", "v", "probes"
    )
    where = spark.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(model.first, model.blocks))], "list int, first long, blocks long"
    )
    held = base.join(F.broadcast(where), "list").select(
        F.expr("first + pmod(xxhash64(rep), blocks)").alias("group"),
        F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"), "rep", "v", "list",
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            row, ids, score, qid = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        else:
            qid = right.column("qid").to_numpy()
            row, ids, score = scan(
                _matrix(left.column("v")), left.column("list").to_numpy(), left.column("rep").to_numpy(),
                _matrix(right.column("v")), _matrix(right.column("probes")).astype(int), model, k + 1,
            )
        return pa.table({"qid": qid[row], "rep": ids, "score": score})

    keys = ["group", "block"]
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, "qid long, rep long, score double")
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "rep")
    # k + 1 different vectors hold at least k + 1 rows, one of which may be the query's own.
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    hits = found.join(members.select("id", "rep"), "rep").select("qid", "id", "score")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.distinct().join(asked, "v").select(F.col("id").alias("query_id"), "qid").join(hits, "qid")
        .where(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), "score")
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
