"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad.  The evidence of a line are its own features and some
of those of the lines before and after it; neighbouring labels influence each
other through learned weights.  Forward and backward passes give the probability
that a line is good, and a document's quality is the mean of these, each line
weighing as much as it is long.  The weights maximise the likelihood of a bounded
sample of labelled documents, whose lines all take the document's label.

Odd input: a null or empty text is one empty line.  Labels that are null are not
learned from; without any usable label every score is 0.5.  Other columns of the
input are ignored, repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import bucket_of, kept_rows, labelled_sample, per_batch, texts_of

#: Labelled documents that are looked at, and the most lines of one that is learned from.
ROWS, LINES = 4000, 400
ROUNDS, RATE, SHRINK = 150, 0.15, 2e-3
#: Characters whose features are computed at once.
PORTION = 1_000_000
OWN = 14
#: Own features that a line also sees of its neighbours.
SHOWN = (0, 1, 2, 3, 4, 6, 7, 8)
WIDTH = OWN + 2 * len(SHOWN) + 3

_kinds: np.ndarray | None = None


def _kind_of() -> np.ndarray:
    """By code point: 0 other, 1 lower-case or caseless letter, 2 upper case, 3 digit, 4 space, 5 everyday punctuation, 6 symbol."""
    global _kinds
    if _kinds is None:
        _kinds = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                _kinds[c] = 2 if ch.isupper() else 1
            elif ch.isdigit():
                _kinds[c] = 3
            elif ch.isspace():
                _kinds[c] = 4
            elif ch in ".,;:?'\"-()":
                _kinds[c] = 5
            elif c < 0x3000 and ch.isprintable():
                _kinds[c] = 6
    return _kinds


def line_features(lines: list[str]) -> np.ndarray:
    """Own features of each line; every column is of the order of one."""
    size = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(at * 8 + _kind_of()[points], minlength=8 * len(lines)).reshape(-1, 8).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    split = [x.split() for x in lines]
    words = np.array([len(w) for w in split], float)
    distinct = np.array([len(set(w)) for w in split], float)
    repeats = np.array([sum(map(str.__eq__, w, w[1:])) for w in split], float)
    odd_ends = np.array([sum(not x[-1].isalnum() for x in w) for w in split], float)
    closes = np.array([x.rstrip()[-1:] in (".", "?", "!", '"') and x != "" for x in lines], float)
    some = np.maximum(words, 1)
    return np.stack([
        share[:, 6] * 4, share[:, 3] * 4, counts[:, 2] / letters, distinct / some * (words > 8), np.log1p(words) / 4,
        (words == 0) * 1.0, repeats / some, odd_ends / some, (counts[:, 1] + counts[:, 2]) / np.maximum(size, 1),
        np.minimum(size / some, 40) / 10, closes, (words < 4) * 1.0, share[:, 5] * 4, share[:, 0] * 4,
    ], axis=1)


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Adds a constant, the neighbours' shown features, and whether a line has no line before or after it."""
    shown = own[:, SHOWN]
    before = np.where(first[:, None], 0, np.roll(shown, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(shown, -1, axis=0))
    return np.concatenate([np.ones((len(own), 1)), own, before, after, first[:, None], last[:, None]], axis=1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, lines per text, and characters per line."""
    lines = [t.split("\n") for t in texts]
    n = np.array([len(x) for x in lines])
    flat = [x for own in lines for x in own]
    ends = np.cumsum(n)
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[ends - n] = last[ends - 1] = True
    own, begin, total = [], 0, 0
    for i, x in enumerate(flat):
        total += len(x)
        if total >= PORTION:
            own.append(line_features(flat[begin : i + 1]))
            begin, total = i + 1, 0
    if begin < len(flat):
        own.append(line_features(flat[begin:]))
    return with_neighbours(np.concatenate(own), first, last), n, np.array([len(x) for x in flat])


def marginals(evidence: np.ndarray, n: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, summed P(neighbouring labels) per text, and the log of each text's normaliser.

    ``evidence`` is the score of "good" of each line ("bad" scores 0), ``n`` the
    lines per text and ``moves`` the 2 x 2 scores of neighbouring labels.  Texts
    are taken longest first, so that the t-th lines of all texts that have one
    are a prefix.
    """
    order = np.argsort(-n, kind="stable")
    begin = (np.cumsum(n) - n)[order]
    longest = int(n.max()) if len(n) else 0
    alive = np.searchsorted(-n[order], -np.arange(longest), side="left")  # texts with more than t lines
    emit = np.stack([np.zeros_like(evidence), evidence], axis=1)
    factor = np.exp(moves)
    peak = emit.max(axis=1)
    weight = np.exp(emit - peak[:, None])
    ahead, scale = np.empty_like(weight), np.empty(len(weight))
    for t in range(longest):
        at = begin[: alive[t]] + t
        now = weight[at] if t == 0 else (ahead[at - 1] @ factor) * weight[at]
        scale[at] = now.sum(axis=1)
        ahead[at] = now / scale[at][:, None]
    behind = np.ones_like(weight)
    pairs = np.zeros((len(n), 2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        right = weight[at + 1] * behind[at + 1] / scale[at + 1][:, None]
        behind[at] = right @ factor.T
        pairs[order[: alive[t + 1]]] += ahead[at][:, :, None] * factor[None] * right[:, None, :]
    both = ahead * behind
    ends = np.r_[0, np.cumsum(np.log(scale) + peak)]
    stop = np.cumsum(n)
    return both[:, 1] / both.sum(axis=1), pairs, ends[stop] - ends[stop - n]


def train(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and neighbour scores of largest likelihood, by adaptive gradient steps.

    ``good`` is the label of each text.  Every text weighs the same however many
    lines it has, or a few long ones would decide.
    """
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    label = np.repeat(good, n).astype(float)
    share = np.repeat(1 / np.sqrt(n), n)
    told = np.zeros((len(n), 2, 2))
    told[np.arange(len(n)), good, good] = n - 1
    mean, square = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        p, pairs, _ = marginals(x @ weights, n, moves)
        slope = np.concatenate([
            x.T @ ((label - p) * share) / len(n) - SHRINK * weights,
            ((told - pairs) / np.sqrt(n)[:, None, None]).mean(axis=0).ravel() - 10 * SHRINK * moves.ravel(),
        ])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + move[:WIDTH], moves + move[WIDTH:].reshape(2, 2)
    return weights, moves


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The model, from a bounded sample of labelled documents outside the held-out fold."""
    usable = labels.where(bucket_of("doc_id", folds) != held_out)
    sample = labelled_sample(docs, usable, "quality", ROWS)

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, n, _ = features(texts_of(batch))
            # Of a longer text a run of lines, where its id says, stands for all of it.
            more = np.maximum(n - LINES, 0)
            drawn = np.array([zlib.crc32(str(i).encode()) for i in batch.column("doc_id").to_pylist()], np.int64) % (more + 1)
            starts = np.cumsum(n) - n + drawn
            blobs = [x[s : s + min(k, LINES)].astype(np.float32).tobytes() for s, k in zip(starts, n)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "x"])

        return step

    rows = per_batch(sample.select("doc_id", "label", "text"), build, "doc_id long, label int, x binary").orderBy("doc_id").toPandas()
    if rows["label"].nunique() < 2:
        return np.zeros(WIDTH), np.zeros((2, 2))
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]]
    return train(np.concatenate(x).astype(float), np.array([len(a) for a in x]), rows["label"].to_numpy().astype(int))


def judge(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, lines, and rather bad lines of every text."""
    weights, moves = model
    x, n, size = features(texts)
    p, _, _ = marginals(x @ weights, n, moves)
    starts, length = np.cumsum(n) - n, np.maximum(size, 1).astype(float)
    quality = np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts)
    return np.clip(quality, 0.0, 1.0), n.astype(np.int64), np.add.reduceat((p < 0.5).astype(np.int64), starts)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score, n_lines, bad_lines): quality, lines, and how many of them are rather bad."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judge(texts_of(batch), model)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], ["doc_id", "score", "n_lines", "bad_lines"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(picked, lambda: step, "doc_id long, score double, n_lines long, bad_lines long")


def good_rows(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """The documents whose quality is at least ``least``, with all their columns."""
    return kept_rows(docs, lambda: lambda batch: judge(texts_of(batch), model)[0] >= least)
