"""Toxic documents from a support vector machine over a string-subsequence kernel.

The kernel of two words counts the letter subsequences of three and four letters
that they share, each weighing less the more it is stretched, so that gaps and
inserted characters cost a little but do not hide a word.  A sentence is read as
its words, together with words that are spelled out letter by letter; its margin
is the largest of theirs, and so is a document's.  Labels belong to documents, so
the machine is trained in turns: sentences of clean documents are negative, and
of a toxic document the words that carry it are positive, which the machine of
the turn before picks.  Landmark words give the kernel a finite space (Nyström),
and a logistic curve turns margins into scores.

A subsequence kernel is the inner product of sparse subsequence vectors, so the
machine's sum over landmarks collapses into one weight per subsequence.  Scoring
a word then reads its own subsequences only, whatever the number of landmarks.

Odd input: a null or empty text, or one without words, gets the score of the
margin of a word without letters.  Labels that are null are not learned from;
without toxic and clean labels every score is the share of toxic ones, or 0.
Other columns of the input are ignored, repeated rows stay, an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import bucket_of, labelled_sample, per_batch, texts_of

#: Labelled documents that are learned from.
TOXIC_ROWS, CLEAN_ROWS = 2500, 2500
#: Decay for each character that stretches a subsequence, and the most characters that it may span.
DECAY, SPAN = 0.6, {3: 5, 4: 7}
SLOTS = 1 << 20
LANDMARKS, TURNS, NEGATIVES = 240, 3, 3000
#: A word that no clean document holds is an example by itself from this share of the toxic documents on.
OFTEN = 0.012
#: A word is read up to this many characters at a time; longer ones in overlapping stretches.
STRETCH, OVERLAP = 40, 10
REMEMBERED = 400_000
#: Characters of text whose words are looked at together.
PORTION = 2_000_000

_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_EDGE, _INNER = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[\W_]+")
#: Offsets of a subsequence's letters from its first, and its weight by the kernel.
_SHAPES = [
    (0, *rest) for letters, span in SPAN.items() for rest in combinations(range(1, span), letters - 1)
]


def stem(word: str) -> str:
    """A word without the punctuation round it."""
    return _EDGE.sub("", word)


def stretches(word: str) -> list[str]:
    """A word as the pieces that are compared; nearly always itself, and once more without inner punctuation."""
    word = stem(word)
    found = []
    for form in dict.fromkeys((word, _INNER.sub("", word))):
        if len(form) > STRETCH:
            found += [form[i : i + STRETCH] for i in range(0, len(form) - OVERLAP, STRETCH - OVERLAP)]
        elif form:
            found.append(form)
    return found


def spelled_out(text: str) -> list[str]:
    """Runs of single characters, joined: "i d i o t" is a word too."""
    return ["".join(m.group().split()) for m in _SPELLED.finditer(text)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words one after the other, with a mark before each word and a gap after it, and whose they are.

    Gap characters, which are no letters, have code 0.
    """
    room = max(s for s in SPAN.values())
    joined = "".join("^" + w + "\0" * room for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.fromiter(map(str.isalnum, joined), bool, len(joined))
    codes = np.where(letters, points, 0).astype(np.uint64)
    size = np.array([len(w) + 1 + room for w in words])
    codes[np.cumsum(size) - size] = ord("^")
    return codes, np.repeat(np.arange(len(words)), size)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of the vector of every word, scaled to length one; equal slots of a word are summed."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, owner = _codes(words)
    keys = []
    for shape in _SHAPES:
        n = len(codes) - shape[-1]
        whole = np.ones(n, bool)
        mixed = np.full(n, len(shape), np.uint64)
        for offset in shape:
            at = codes[offset : offset + n]
            whole &= at > 0
            mixed = (mixed ^ at) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        start = np.flatnonzero(whole)
        # The first letter of the next word lies beyond the gap, so a subsequence never leaves its word.
        slot = (mixed[start] >> np.uint64(44)).astype(np.int64)
        keys.append(((owner[start] * SLOTS + slot) << 3) | (shape[-1] + 1 - len(shape)))
    keys = np.sort(np.concatenate(keys))
    weight = DECAY ** (keys & 7).astype(float)
    place = keys >> 3
    if not len(place):
        return place, place, weight
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    total = np.add.reduceat(weight, first)
    word, slot = place[first] // SLOTS, place[first] % SLOTS
    norm = np.sqrt(np.bincount(word, total**2, minlength=len(words)))
    return word, slot, total / norm[word]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised subsequence kernel between two lists of words."""
    own, own_slot, own_weight = subsequences(right)
    order = np.argsort(own_slot, kind="stable")
    own, own_slot, own_weight = own[order], own_slot[order], own_weight[order]
    starts = np.searchsorted(own_slot, np.arange(SLOTS + 1))
    out = []
    for i in range(0, len(left), 1000):
        part = left[i : i + 1000]
        word, slot, weight = subsequences(part)
        n = starts[slot + 1] - starts[slot]
        pick = np.repeat(starts[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(word, n) * len(right) + own[pick]
        out.append(np.bincount(place, np.repeat(weight, n) * own_weight[pick], minlength=len(part) * len(right)))
    return np.concatenate(out).reshape(len(left), len(right))


def distinct_bags(bags: list[list[str]]) -> list[list[str]]:
    """Bags without near copies of earlier ones, whose every word would look like the cause of a label.

    The longest words of a document are nearly its own, so copies share them; a
    bag is compared with the latest that share one of these.
    """
    by_word: dict[str, list[set[str]]] = {}
    kept = []
    for bag in bags:
        own = set(bag)
        longest = sorted(own, key=lambda w: (-len(w), w))[:5]
        near = (other for w in longest for other in by_word.get(w, ())[-20:])
        if own and not any(2 * len(own & other) > len(own | other) for other in near):
            kept.append(bag)
            for w in longest:
                by_word.setdefault(w, []).append(own)
    return kept


def linear_machine(x: np.ndarray, y: np.ndarray, c: float = 3000.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights of a linear support vector machine with squared hinge loss, by Newton steps; classes weigh alike."""
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, held = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        short = np.flatnonzero(y * (x @ w) < 1)
        if held is not None and np.array_equal(short, held):
            break
        held = short
        part = x[short] * (c * weigh[short])[:, None]
        w = np.linalg.solve(ridge + part.T @ x[short], part.T @ y[short])
    return w[:-1], float(w[-1])


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of every word."""
    word, slot, weight = subsequences(words)
    return np.bincount(word, weight * weights[slot], minlength=len(words)) + bias


def shared_odds(names: list[str], counts: np.ndarray, toxic: int, clean: int):
    """Mean log odds of the subsequences of every word, a portion of words at a time.

    ``counts`` has the clean and toxic documents of each word.
    """
    seen = np.zeros((SLOTS, 2))
    portions = [slice(i, i + 8000) for i in range(0, len(names), 8000)]
    for part in portions:
        word, slot, _ = subsequences(names[part])
        for side in (0, 1):
            seen[:, side] += np.bincount(slot, counts[part][word, side], minlength=SLOTS)
    odds = np.log((seen[:, 1] + 0.5) / (toxic + 1)) - np.log((seen[:, 0] + 0.5) / (clean + 1))
    for part in portions:
        word, slot, weight = subsequences(names[part])
        n = len(names[part])
        yield np.bincount(word, weight * odds[slot], minlength=n) / np.maximum(np.bincount(word, weight, minlength=n), 1e-9)


def train(toxic: list[list[str]], clean: list[list[str]]) -> tuple[np.ndarray, float, float, float]:
    """(weight per slot, bias, slope and offset of the logistic curve) from the distinct words of labelled documents."""
    every = toxic, clean
    toxic, clean = distinct_bags(toxic), distinct_bags(clean)
    seen: dict[str, list[float]] = {}
    for side, bags in enumerate((clean, toxic)):
        for bag in bags:
            for w in set(bag):
                seen.setdefault(w, [0, 0])[side] += 1
    names = sorted(seen)
    counts = np.array([seen[w] for w in names], float)
    odds = np.log((counts[:, 1] + 0.2) / (len(toxic) + 0.4)) - np.log((counts[:, 0] + 0.2) / (len(clean) + 0.4))
    number = {w: i for i, w in enumerate(names)}
    bags = [np.array(sorted({number[w] for w in bag})) for bag in toxic if bag]
    # To begin with, a word is as toxic as the documents that hold its subsequences, and a little as those that hold itself.
    value = np.concatenate([*shared_odds(names, counts, len(toxic), len(clean))]) + 0.25 * odds if names else odds
    # Negative words: those of most clean documents, and then the ones the machine takes for toxic.
    common = np.argsort(-counts[:, 0], kind="stable")
    common = common[counts[common, 0] > 0]
    negative = np.unique(np.r_[common[: NEGATIVES // 2], common[:: max(1, len(common) // (NEGATIVES // 2))]])
    weights, bias = np.zeros(SLOTS), 0.0
    often = max(3.0, OFTEN * len(toxic))
    strong = set(np.flatnonzero((odds > 2) & (counts[:, 1] >= often) & (counts[:, 0] == 0)))
    for _ in range(TURNS):
        # Of each toxic document its strongest word, and words that many of them hold and no clean one.
        picked = {b[np.argmax(value[b])] for b in bags}
        positive = np.array(sorted(strong | {i for i in picked if counts[i, 1] > counts[i, 0]}), int)
        if not len(positive):
            break
        here = np.setdiff1d(negative, positive)
        # Landmarks: positive words by how many toxic documents hold them, and as many negative ones.
        lead = positive[np.argsort(-counts[positive, 1], kind="stable")][: LANDMARKS // 2]
        other = here[:: max(1, len(here) // (LANDMARKS // 2))][: LANDMARKS // 2]
        landmarks = [names[i] for i in np.r_[lead, other]]
        between = kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        keep = values > 1e-6
        map_ = vectors[:, keep] / np.sqrt(values[keep])
        rows = np.r_[positive, here]
        x = kernel([names[i] for i in rows], landmarks) @ map_
        y = np.r_[np.ones(len(positive)), -np.ones(len(here))]
        w, bias = linear_machine(x, y)
        # The sum over landmarks as one weight per subsequence slot.
        word, slot, weight = subsequences(landmarks)
        weights = np.bincount(slot, weight * (map_ @ w)[word], minlength=SLOTS)
        value = np.concatenate([margins(names[i : i + 8000], weights, bias) for i in range(0, len(names), 8000)])
        wrong = np.flatnonzero((counts[:, 0] > 0) & (value > -0.5))
        negative = np.unique(np.r_[here, wrong[np.argsort(-value[wrong], kind="stable")][:NEGATIVES]])
    empty = float(margins([""], weights, bias)[0])
    known = dict(zip(names, value))
    extra = sorted({w for side in every for bag in side for w in bag} - known.keys())
    known |= dict(zip(extra, margins(extra, weights, bias)))
    m = np.array([max((known[w] for w in bag), default=empty) for side in every for bag in side])
    y = np.r_[np.ones(len(every[0])), np.zeros(len(every[1]))]
    slope, offset = logistic(m, y)
    return weights, bias, slope, offset


def logistic(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) as a logistic curve of ``m``, kept from becoming a step."""
    a = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (y - p) - 0.05 * a
        a = a + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), slope), -2, 2)
    return float(a[0]), float(a[1])


def words_of(text: str) -> list[str]:
    """All pieces of a text that are compared."""
    text = text.lower()
    return [s for w in [*text.split(), *spelled_out(text)] for s in stretches(w)]


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> tuple[np.ndarray, float, float, float]:
    """The model, from a bounded sample of labelled documents outside the held-out fold."""
    usable = labels.where(bucket_of("doc_id", folds) != held_out)
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled_sample(docs, one.where("toxic = 1"), "toxic", TOXIC_ROWS).unionByName(
        labelled_sample(docs, one.where("toxic = 0"), "toxic", CLEAN_ROWS)
    )

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = pa.array([sorted(set(words_of(t))) for t in texts_of(batch)], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), words], ["doc_id", "label", "words"])

        return step

    picked = sample.select("doc_id", "label", "text")
    rows = per_batch(picked, build, "doc_id long, label int, words array<string>").orderBy("doc_id").toArrow().to_pylist()
    toxic, clean = ([r["words"] for r in rows if r["label"] == k] for k in (1, 0))
    if not toxic or not clean:
        return np.zeros(SLOTS), 0.0, 0.0, -30.0 if not toxic else 30.0
    return train(toxic, clean)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float]) -> DataFrame:
    """(doc_id, score, worst): the score, and the word with the largest margin."""
    weights, bias, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def build():
        slots = shared.value
        known: dict[str, float] = {}
        empty = float(margins([""], slots, bias)[0])

        def learn(words: set[str]) -> None:
            """Margins of words that were not met before."""
            new = sorted(words - known.keys())
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                pieces = [stretches(w) for w in part]
                flat = sorted({s for own in pieces for s in own})
                value = dict(zip(flat, margins(flat, slots, bias).tolist()))
                known.update((w, max((value[s] for s in own), default=empty)) for w, own in zip(part, pieces))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.lower() for t in texts_of(batch)]
            best, worst = [], []
            begin = 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= PORTION):
                    size += len(texts[stop])
                    stop += 1
                words = [t.split() + spelled_out(t) for t in texts[begin:stop]]
                if len(known) > REMEMBERED:
                    known.clear()
                learn(set().union(*words))
                for own in words:
                    top = max(own, key=known.__getitem__, default=None)
                    best.append(empty if top is None else known[top])
                    worst.append(top)
                begin = stop
            p = 1 / (1 + np.exp(-np.clip(slope * np.array(best) + offset, -30, 30)))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array(worst, pa.string())], ["doc_id", "score", "worst"]
            )

        return step

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(picked, build, "doc_id long, score double, worst string")
