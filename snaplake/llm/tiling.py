"""Benchmark passages in documents by greedy string tiling.

Runs of a few words that a document shares with a test item, found by rolling
(Karp-Rabin) hashes of both, are the seeds.  For each document and item that share
a seed, the longest common runs that do not overlap earlier ones are marked one
after the other, so a passage whose parts stand in another order is covered as
well.  An item is in a document if its marked share reaches a threshold.

Test items are broadcast in blocks of bounded size, one pass over the documents
for each block; documents are never compared with each other, and how many of
them share a passage does not matter.

Odd input: null and empty texts on either side match nothing; an item of fewer
words than a seed must occur whole.  Documents without an id are looked at like
any other.  Repeated documents give repeated rows, repeated items count once;
other columns are ignored, empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import kept_rows, per_batch, texts_of

SEED_WORDS, COVERED = 5, 0.6
#: Characters of test items that are broadcast together.
BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def word_hashes(text: str) -> np.ndarray:
    """One number for each word; only good within a process, which both sides share."""
    words = _WORD(text.lower())
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * _BASE + words[i : i + len(total)]
    return total ^ (total >> np.uint64(32))


class Items:
    """Test items of one block: their words, and where each seed stands in them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(SEED_WORDS, len(w)) for w in self.words if len(w)}):
            own = [i for i, w in enumerate(self.words) if min(SEED_WORDS, len(w)) == n]
            hashed = [rolling(self.words[i], n) for i in own]
            seed = np.concatenate(hashed)
            item = np.repeat(own, [len(h) for h in hashed])
            place = np.concatenate([np.arange(len(h)) for h in hashed])
            order = np.argsort(seed, kind="stable")
            slots = np.zeros(1 << _SLOTS, bool)
            slots[seed >> np.uint64(64 - _SLOTS)] = True
            self.seeds[n] = seed[order], item[order], place[order], slots

    def hits(self, words: np.ndarray):
        """(item, seed length, places in the document, places in the item) of every item with a shared seed."""
        for n, (seed, item, place, slots) in self.seeds.items():
            own = rolling(words, n)
            at = np.flatnonzero(slots[own >> np.uint64(64 - _SLOTS)])
            if not len(at):
                continue
            begin = np.searchsorted(seed, own[at], "left")
            count = np.searchsorted(seed, own[at], "right") - begin
            if not count.any():
                continue
            pick = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            here, there, whose = np.repeat(at, count), place[pick], item[pick]
            order = np.argsort(whose, kind="stable")
            here, there, whose = here[order], there[order], whose[order]
            cuts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(whose)]):
                yield int(whose[a]), n, here[a:b], there[a:b]


def tiles(here: np.ndarray, there: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words), longest first, from the places of shared seeds.

    Seeds one behind the other on both sides make a run.  The longest run is
    marked; what it takes away from the other runs is cut off them, and pieces that
    are still as long as a seed stay in the queue.
    """
    order = np.lexsort((here, here - there))
    here, there = here[order], there[order]
    new = np.r_[True, ((here - there)[1:] != (here - there)[:-1]) | (here[1:] != here[:-1] + 1)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(here)]) + seed - 1
    queue = [(-int(n), int(here[f]), int(there[f])) for f, n in zip(first, size)]
    heapq.heapify(queue)
    taken_here: set[int] = set()
    taken_there: set[int] = set()
    marked = []
    while queue:
        n, p, q = heapq.heappop(queue)
        n = -n
        free = [p + i not in taken_here and q + i not in taken_there for i in range(n)]
        if all(free):
            marked.append((p, q, n))
            taken_here.update(range(p, p + n))
            taken_there.update(range(q, q + n))
            continue
        begin = None
        for i, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                if i - begin >= seed:
                    heapq.heappush(queue, (begin - i, p + begin, q + begin))
                begin = None
    return marked


def contained(words: np.ndarray, items: Items, covered: float) -> list[tuple[int, float, int, int]]:
    """(item number, covered share, tiles, longest tile) of every item that a document holds."""
    found = []
    for item, seed, here, there in items.hits(words):
        size = len(items.words[item])
        # No tiling covers more than the words that seeds touch.
        touched = np.zeros(size + 1, np.int64)
        np.add.at(touched, there, 1)
        np.add.at(touched, there + seed, -1)
        if (np.cumsum(touched)[:size] > 0).sum() < covered * size:
            continue
        own = tiles(here, there, seed)
        share = sum(n for *_, n in own) / size
        if share >= covered:
            found.append((item, share, len(own), max(n for *_, n in own)))
    return found


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_CHARS``, one block on the driver at a time when iterated."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & (F.length("text") > 0)
    ).distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_CHARS)
    for b in range(blocks):
        part = rows.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) for every document and item found in it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def build(shared=shared):
            items = Items(shared.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [(i, *f) for i, t in enumerate(texts_of(batch)) for f in contained(word_hashes(t), items, covered)]
                at, item, share, n, longest = zip(*found) if found else ((),) * 5
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([items.ids[i] for i in item], pa.int64()),
                     pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(longest, pa.int32())],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                )

            return step

        result = result.unionByName(per_batch(picked, build, schema))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def build(shared=shared):
            items = Items(shared.value)
            return lambda batch: [not contained(word_hashes(t), items, covered) for t in texts_of(batch)]

        docs = kept_rows(docs, build)
    return docs
