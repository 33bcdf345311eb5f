"""Languages of a text as a mixture, by expectation-maximisation over letter trigrams.

Each language is a distribution over hashed letter trigrams, learned from labelled
texts.  A document is taken as a mixture: expectation-maximisation finds the
proportions that make its trigrams likeliest.  Then one, two or more of its
leading languages are fitted alone, and the set with the best likelihood less a
penalty for each further language is kept.

Odd input: a null text or one without letters is ``und`` with score 0.  Rows
without a language are not learned from.  Other columns of the input are ignored,
repeated rows stay, an empty table gives an empty result; without any labelled
row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.common import bucket_of, kept_rows, per_batch, texts_of

UNKNOWN, BUCKETS = "und", 8192
#: Labelled rows per language that the trigram counts are taken from.
ROWS_PER_LANGUAGE, SHARES = 1536, 32
#: Trigrams overlap, so a likelihood counts every letter about three times.
OVERLAP = 3.0
PENALTY = 4.0
ROUNDS = 10
#: Nats a trigram that a kept document's mixture may fall short of chance: documents of the learned languages have 2 to 4 more
#: than chance, unlearned scripts and random letters 4 to 9 less.
LEAST_GAIN = -2.0
#: Characters that are counted at once.
PORTION = 200_000

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """By code point, made once in a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the letters of a text, with one gap between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, 32).astype(np.uint64)
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(51)).astype(np.int64)


def portions(texts: list[str]):
    """Runs of texts of about ``PORTION`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PORTION or i - begin >= 128:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_matrix(texts: list[str]) -> np.ndarray:
    """Trigram counts, a row for each text."""
    grams = [trigrams(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    return np.bincount(row * BUCKETS + np.concatenate(grams), minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def fit(docs: DataFrame, held_out: int = 2, folds: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, from a bounded sample of labelled rows outside the held-out fold."""
    usable = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
        & (bucket_of("doc_id", folds) != held_out)
    )
    # A language is drawn from in shares, so that a frequent one is not ranked in one task.
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES))
    place = Window.partitionBy("lang", "share").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", "lang", share.alias("share")).withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= ROWS_PER_LANGUAGE // SHARES).select("doc_id", "lang").distinct()
    )

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, langs = texts_of(batch), np.array(batch.column("lang").to_pylist())
            total: dict[str, np.ndarray] = {}
            for a, b in portions(texts):
                counts = count_matrix(texts[a:b])
                for lang in np.unique(langs[a:b]):
                    total[lang] = total.get(lang, 0) + counts[langs[a:b] == lang].sum(axis=0)
            seen = [(lang, np.flatnonzero(c), c) for lang, c in total.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, at, _ in seen for _ in at], pa.string()),
                 pa.array(np.concatenate([at for _, at, _ in seen]).astype(np.int32)),
                 pa.array(np.concatenate([c[at] for _, at, c in seen]).astype(np.int64))],
                ["lang", "bucket", "n"],
            )

        return step

    # The chosen ids are bounded for each language, so they go to the documents and not the other way.
    learned = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    counts = per_batch(learned, build, "lang string, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    # Add-one smoothing towards what all languages share keeps every trigram possible.
    shared = (table.sum(axis=0) + 1) / (table.sum() + BUCKETS) if len(langs) else np.zeros(BUCKETS)
    table = table + 200 * shared
    return langs, table / np.maximum(table.sum(axis=1, keepdims=True), 1)


def mixtures(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions of the chosen set of languages for every row of counts."""
    used = np.flatnonzero(counts.any(axis=0))
    counts, theta = counts[:, used].astype(np.float32), table[:, used].astype(np.float32)
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def fitted(shares: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            shares = shares * ((counts / np.maximum(shares @ theta, 1e-12)) @ theta.T) / n
        return shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)

    langs = len(table)
    whole = fitted(np.full((len(counts), langs), 1 / langs, np.float32), ROUNDS)
    order = np.argsort(-whole, axis=1, kind="stable")
    alone = counts @ np.log(theta.T)
    # One language: the likeliest; more: the leading ones of the full mixture.
    best = np.eye(langs, dtype=np.float32)[alone.argmax(axis=1)]
    value = alone.max(axis=1) / OVERLAP
    for k in range(2, langs + 1):
        allowed = np.zeros_like(whole)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        trial = fitted(np.where(allowed > 0, np.maximum(whole, 1e-3), 0), ROUNDS // 2)
        score = (counts * np.log(np.maximum(trial @ theta, 1e-12))).sum(axis=1) / OVERLAP
        score -= PENALTY * (k - 1) * np.log(n[:, 0] + 1)
        better = score > value
        if not better.any():
            break
        best[better], value[better] = trial[better], score[better]
    return best


def judged(texts: list[str], names: list[str], theta: np.ndarray) -> tuple[list[str], list[float], list[list[str]], list[float]]:
    """Leading language, its proportion, the chosen set of languages and the ``gain`` of every text.

    The gain is how much likelier a trigram is in the chosen mixture than if all were alike, in
    nats; texts in none of the languages, and noise, are below zero.
    """
    pred, score, sets, gain = [], [], [], []
    for a, b in portions(texts):
        counts = count_matrix(texts[a:b])
        known = counts.any(axis=1) if names else np.zeros(b - a, bool)
        shares = mixtures(counts, theta) if names else np.zeros((b - a, 1))
        for ok, row, own in zip(known, shares, counts):
            top = int(row.argmax())
            pred.append(names[top] if ok else UNKNOWN)
            score.append(min(1.0, float(row[top])) if ok else 0.0)
            sets.append([names[i] for i in np.flatnonzero(row > 0)] if ok else [])
            used = np.flatnonzero(own) if ok else []
            gain.append(float(own[used] @ np.log(np.maximum(row @ theta[:, used], 1e-12) * BUCKETS) / own[used].sum()) if ok else 0.0)
    return pred, score, sets, gain


def judge(texts: list[str], names: list[str], theta: np.ndarray) -> tuple[list[str], list[float], list[list[str]]]:
    """Leading language, its proportion, and the chosen set of languages of every text."""
    return judged(texts, names, theta)[:3]


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, languages): the leading language, its proportion, and all of the chosen set."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pred, score, sets = judge(texts_of(batch), *shared.value)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                ["doc_id", "lang_pred", "score", "languages"],
            )

        return step

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(picked, build, "doc_id long, lang_pred string, score double, languages array<string>")


def recognised_rows(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The documents with a known language that makes up at least ``least`` of them and explains them, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def build():
        def keep(batch: pa.RecordBatch) -> list[bool]:
            pred, score, _, gain = judged(texts_of(batch), *shared.value)
            return [p != UNKNOWN and s >= least and g >= LEAST_GAIN for p, s, g in zip(pred, score, gain)]

        return keep

    return kept_rows(docs, build)
