"""Cross-entropy difference of two n-gram models over one vocabulary.

A target model is counted from documents that are wanted, a background model from
all documents; both are bigram models with the same vocabulary, the same
smoothing and the same slots.  A document's score is the mean over its words of the target
model's loss less the background model's loss: the lower, the more it is like the
target.

A document's own words are taken out of the counts before it is scored, or the
documents that the target was counted from would look better than their like.

Words and bigrams of all documents are counted by 64-bit keys over the whole corpus; no word or
bigram is left out or shares a count, and nothing but four sums is gathered.  Different texts
are dealt to chunks, and each chunk asks once for each of its keys: it sends its own counts,
in slices of the key space, as sorted differences.  A slice sums what all chunks sent and
sends back to each the counts of all, in the order in which it asked.  Chunks, which lie where they
were dealt to, then score their texts.  A text is one however often it is there, and counts as often.

Odd input: a null text is an empty one; a text without words has no loss, and its
score is null.  Documents without an id or label belong to the background only.
A corpus without target documents gives null scores.  Other columns are ignored,
repeated rows stay and count as often as they stand, an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import flat, per_task, texts_of, whole_groups, with_package
from snaplake.operators.skew import lookup_join
from snaplake.session import materialise, materialise_counted

#: Words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Texts of a chunk, and bytes of text whose keys a slice should sum, which are about three to a key.
CHUNK_TEXTS, SLICE_BYTES = 2000, 6_000_000
#: Weight of the word's own frequency against what follows its predecessor, and what every word counts beforehand.
KAPPA, ALPHA = 20.0, 0.5
#: The key of the mark before a text.
START = 1


def words_of(text: str) -> list[str]:
    return text.lower().split()


def vocabulary(docs: DataFrame, size: int = 30_000) -> list[str]:
    """The most frequent words of all documents, to look at; of equally frequent ones the first in order."""

    def run(pieces):
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )
            seen.clear()
            return batch

        for piece in pieces:
            for t in texts_of(piece):
                seen.update(words_of(t))
            if len(seen) > HELD_WORDS:
                yield told()
        yield told()

    counts = per_task(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def word_keys(text: str) -> np.ndarray:
    """Keys of the words with the start mark in front; keys of words are odd and those of bigrams even."""
    words = words_of(text)
    keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)) | np.uint64(1)
    return np.r_[np.uint64(START), keys]


def bigram_keys(keys: np.ndarray) -> np.ndarray:
    """A key for each word and its predecessor."""
    mixed = (keys[:-1] ^ (keys[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + keys[1:]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) & ~np.uint64(1)


def all_keys(text: str) -> np.ndarray:
    """Signed keys of all words and bigrams of a text, with repeats; none if it has no words.

    A word that ends a text has no successor, yet counts as a predecessor: ending is
    what is left of its probability.
    """
    keys = word_keys(text)
    return np.concatenate([keys, bigram_keys(keys)]).view(np.int64) if len(keys) > 1 else np.zeros(0, np.int64)


def loss_of(keys: np.ndarray, counts: tuple[np.ndarray, np.ndarray], target: bool, sums: tuple[int, int, int]) -> tuple[int, float | None, float | None]:
    """(words, mean loss under the target, mean loss under the background) of a text's keys.

    ``counts`` are those of all texts and of the target, for the different keys in order; ``sums`` the words
    of all texts, those of the target, and how many different ones there are.  The background's
    counts are scaled to as many words as the target has, so that both models are as sure of what
    they have seen.  A document's own words are taken out of the models that it was counted for.
    """
    n = len(keys) // 2
    if not n:
        return 0, None, None
    _, at, repeats = np.unique(keys, return_inverse=True, return_counts=True)
    (everywhere, wanted), (total, total_target, words) = counts, sums
    losses = []
    for known, share, scale, all_words in ((wanted, int(target), 1.0, total_target), (everywhere, 1, total_target / max(total, 1), total)):
        rest = (scale * (known - share * repeats))[at]
        before, pair = rest[: n + 1], rest[n + 1 :]
        alone = (before[1:] + ALPHA) / (scale * (all_words - share * n) + ALPHA * (words + 1))
        losses.append(float(-np.log((pair + KAPPA * alone) / (before[:-1] + KAPPA)).mean()))
    return n, *losses


# ------------------------------------------------------- chunks and slices
def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of all of them, so that the zeros of small ones lie together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


class Chunk:
    """The different texts of a chunk with how often each is there, in all and in the target, and their keys."""

    def __init__(self, rows: pa.Table):
        texts: dict[int, str] = {}
        times: dict[int, tuple[int, int]] = {}
        for row, text, n, t in zip(*[rows.column(c).to_pylist() for c in ("row", "text", "n", "t")]):
            if n is None:
                texts[row] = text
            else:
                times[row] = (n, t)
        self.rows, self.times = list(texts), [times[r] for r in texts]
        self.keys = [all_keys(t).view(np.uint64) for t in texts.values()]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys in order, and how often each occurs in all texts and in those of the target."""
        keys, at = np.unique(flat(self.keys, np.uint64), return_inverse=True)
        sizes = [len(k) for k in self.keys]
        times = np.array(self.times, np.int64).reshape(-1, 2)
        n, t = (np.bincount(at, weights=np.repeat(times[:, i], sizes), minlength=len(keys)).astype(np.int64) for i in (0, 1))
        return keys, n, t


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the ``2 ** bits`` slices of sorted keys begins, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])


def dealt_texts(docs: DataFrame, marked: DataFrame, chunks: int) -> DataFrame:
    """(chunk, row, text, n, t): every different text at least once, and a row without text with its numbers."""

    def run(pieces):
        told: set[int] = set()
        for piece in pieces:
            rows = piece.column("row").to_pylist()
            yield piece.take(pa.array([i for i, r in enumerate(rows) if r not in told and not told.add(r)], pa.int64()))

    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    some = per_task(texts, run, "row long, text string").withColumns({"n": F.lit(None).cast("long"), "t": F.lit(None).cast("long")})
    times = marked.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_if("target").alias("t")).select("row", F.lit(None).cast("string").alias("text"), "n", "t")
    return some.unionByName(times).select(F.pmod("row", F.lit(chunks)).alias("chunk"), "row", "text", "n", "t").repartition("chunk")


def requests(dealt: DataFrame, bits: int) -> DataFrame:
    """(slice, chunk, keys, n, t): what each chunk counted, by slices of the key space."""

    def run(batches):
        for rows in whole_groups(batches, ["chunk"]):
            numbers = rows.column("chunk").to_numpy()
            for number in np.unique(numbers):
                keys, n, t = Chunk(rows.filter(pa.array(numbers == number))).counts()
                at = _bounds(keys, bits)
                some = np.flatnonzero(at[1:] > at[:-1])
                parts = [(keys[at[s] : at[s + 1]], n[at[s] : at[s + 1]], t[at[s] : at[s + 1]]) for s in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int64()), pa.array(np.full(len(some), number), pa.int64()),
                    pa.array([_planes(np.diff(k, prepend=np.uint64(0))) for k, _, _ in parts], pa.binary()),
                    pa.array([_planes(x) for _, x, _ in parts], pa.binary()), pa.array([_planes(x) for *_, x in parts], pa.binary()),
                ], ["slice", "chunk", "keys", "n", "t"])

    return with_package(dealt.sortWithinPartitions("chunk", "row")).mapInArrow(run, "slice long, chunk long, keys binary, n binary, t binary")


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, slice, n, t, words, all, wanted): the counts of all chunks in the order each asked; a slice's sums stand in one of its rows."""

    def run(batches):
        for rows in whole_groups(batches, ["slice"]):
            numbers = rows.column("slice").to_numpy()
            for number in np.unique(numbers):
                own = rows.filter(pa.array(numbers == number))
                lists = [np.cumsum(_numbers(k), dtype=np.uint64) for k in own.column("keys").to_pylist()]
                keys, at = np.unique(flat(lists, np.uint64), return_inverse=True)
                n, t = (
                    np.bincount(at, weights=flat([_numbers(x) for x in own.column(c).to_pylist()], np.uint64), minlength=len(keys)).astype(np.int64)
                    for c in ("n", "t")
                )
                word = ((keys & np.uint64(1)) == 1) & (keys != START)
                ends = np.cumsum([len(x) for x in lists])
                sums = np.zeros((3, len(lists)), np.int64)
                sums[:, 0] = word.sum(), n[word].sum(), t[word].sum()
                split = lambda values: [_planes(x) for x in np.split(values[at], ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [own.column("chunk").combine_chunks(), own.column("slice").combine_chunks(), pa.array(split(n), pa.binary()),
                     pa.array(split(t), pa.binary()), *map(pa.array, sums)],
                    ["chunk", "slice", "n", "t", "words", "all", "wanted"],
                )

    dealt = with_package(asked).repartition("slice").sortWithinPartitions("slice", "chunk")
    return dealt.mapInArrow(run, "chunk long, slice long, n binary, t binary, words long, all long, wanted long")


def score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_words, loss_target, loss_background, score) of every document; ``wanted`` holds the ids of the target."""
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    text = F.coalesce("text", F.lit(""))
    numbers = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.octet_length(text).cast("long").alias("bytes"))
    marked, seen = materialise_counted(
        lookup_join(numbers, ids.withColumn("target", F.lit(True)), ["doc_id"]).withColumn("target", F.coalesce("target", F.lit(False))),
        rows=F.count(F.lit(1)), bytes=F.sum("bytes"), some=F.count_if("target"),
    )
    chunks = max(1, -(-seen["rows"] // CHUNK_TEXTS))
    bits = max(0, ((seen["bytes"] or 0) // SLICE_BYTES).bit_length())
    dealt = dealt_texts(docs, marked, chunks)
    told = answers(requests(dealt, bits))
    # One row of three numbers, which every chunk needs.
    sums = told.agg(F.struct(F.sum("all").alias("all"), F.sum("wanted").alias("wanted"), F.sum("words").alias("words"))).scalar()

    def build(given: pa.Table, back: pa.Table) -> pa.Table:
        chunk, out = Chunk(given), []
        keys, _, _ = chunk.counts()
        back = back.take(pc.sort_indices(back.column("slice"))) if back.num_rows else back
        n, t = (flat([_numbers(x) for x in back.column(c).to_pylist()], np.uint64).astype(np.int64) for c in ("n", "t"))
        total = given.column("sums")[0].as_py()
        total = (total["all"] or 0, total["wanted"] or 0, total["words"] or 0)
        for row, own, (times, among) in zip(chunk.rows, chunk.keys, chunk.times):
            at = np.searchsorted(keys, np.unique(own))
            for target in (True, False):
                if among if target else times > among:
                    out.append((row, target, *loss_of(own, (n[at], t[at]), target, total)))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "target", "n_words", "loss_target", "loss_background"])

    both = dealt.withColumn("sums", sums).groupBy("chunk").cogroup(with_package(told).select("chunk", "slice", "n", "t").groupBy("chunk"))
    found = materialise(both.applyInArrow(build, "row long, target boolean, n_words long, loss_target double, loss_background double"))
    each = lookup_join(marked.select("doc_id", "row", "target"), found, ["row", "target"])
    target = F.col("loss_target") if seen["some"] else F.lit(None).cast("double")
    return each.select("doc_id", "n_words", target.alias("loss_target"), "loss_background", (target - F.col("loss_background")).alias("score"))
