"""Language, quality and toxicity: parts against brute force, wholes by held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest

from snaplake.llm import language, line_quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def area(scores, truth):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, truth) if x for b, y in zip(scores, truth) if not y]
    return sum(pairs) / len(pairs)


def test_language_query(spark, docs):
    rows = queries.op4_language_mixture(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.98


def test_mixture_is_found(docs):
    by = {}
    for r in docs.values():
        by.setdefault(r["lang"], []).append(r["text"] or "")
    names = sorted(by)
    table = np.stack([language.count_matrix(by[n][20:120]).sum(axis=0) for n in names]) + 0.05
    theta = table / table.sum(axis=1, keepdims=True)
    long = {n: max(by[n][:20], key=len)[:1500] for n in names}
    for a, b in itertools.combinations(names, 2):
        row = language.mixtures(language.count_matrix([long[a] + " " + long[b]]), theta)[0]
        share = len(long[a]) / len(long[a] + long[b])
        assert set(np.flatnonzero(row > 0)) == {names.index(a), names.index(b)}
        assert abs(row[names.index(a)] - share) < 0.12
        alone = language.mixtures(language.count_matrix([long[a]]), theta)[0]
        assert alone[names.index(a)] == 1


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, w, lang, 0) for i, (w, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
        + [(None, "the", "en", 0), (900, None, "en", 0), (901, "123 !?", "en", 0), (902, "", None, 0), (903, "the dog", None, 0), (903, "the dog", None, 0)],
        "doc_id long, text string, lang string, score int",
    )
    rows = language.detect(docs, language.fit(docs)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == 46 and got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == got[None][0] == "en"
    none = docs.where("lang is null")
    assert {r["lang_pred"] for r in language.detect(none, language.fit(none)).collect()} == {"und"}
    assert language.detect(docs.limit(0), language.fit(docs.limit(0))).count() == 0
    assert language.recognised_rows(docs, language.fit(docs)).columns == docs.columns


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    n = np.array([3, 1, 5, 2])
    evidence, moves = rng.normal(size=n.sum()), rng.normal(size=(2, 2))
    p, pairs, log_norm = line_quality.marginals(evidence, n, moves)
    start = 0
    for i, size in enumerate(n):
        own = evidence[start : start + size]
        weights = {}
        for path in itertools.product((0, 1), repeat=int(size)):
            weights[path] = np.exp(sum(e for e, y in zip(own, path) if y) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        assert np.isclose(np.log(total), log_norm[i])
        for t in range(size):
            assert np.isclose(sum(w for y, w in weights.items() if y[t]) / total, p[start + t])
        for a, b in itertools.product((0, 1), repeat=2):
            expected = sum(w * sum(x == (a, b) for x in zip(y, y[1:])) for y, w in weights.items()) / total
            assert np.isclose(expected, pairs[i, a, b])
        start += size


def test_quality_query(spark, docs, labels):
    rows = queries.op7_line_quality(spark, SF).collect()
    assert len(rows) == len(docs) and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in labels and fold(r["doc_id"], 3) == 1]
    assert all(r["held_out"] for r in held)
    truth = [labels[r["doc_id"]]["quality"] for r in held]
    assert area([r["score"] for r in held], truth) > 0.97
    assert np.mean([r["predicted"] == t for r, t in zip(held, truth)]) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "Good words stand here.\nAnd more of them." if i % 2 else "a | b | c\n%% ** %% | |", 0.0) for i in range(60)]
        + [(None, "x", 0.0), (99, None, 0.0), (98, "", 0.0), (98, "", 0.0), (97, "line\n" * 5000, 0.0)], "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (97, None)], "doc_id long, quality int")
    model = line_quality.fit(docs, labels)
    rows = line_quality.score(docs, model).collect()
    assert len(rows) == 65 and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows if r["doc_id"] is not None and r["doc_id"] < 60)
    nothing = line_quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in line_quality.score(docs, nothing).collect()} == {0.5}
    assert line_quality.score(docs.limit(0), model).count() == 0
    assert line_quality.good_rows(docs, model).columns == docs.columns


def brute_kernel(a, b):
    def vector(word):
        seen = {}
        chars = "^" + word
        for letters, span in toxicity.SPAN.items():
            for places in itertools.combinations(range(len(chars)), letters):
                width = places[-1] - places[0] + 1
                key = "".join(chars[i] for i in places)
                if width <= span and all(c == "^" or c.isalnum() for c in key):
                    seen[key] = seen.get(key, 0) + toxicity.DECAY ** (width - letters)
        return seen
    x, y = vector(a), vector(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_kernel_by_enumeration():
    words = ["idiot", "i.d.i.o.t", "idioot", "the", "banana", "an", "", "clownish", "réeux", "x1y2z3"]
    found = toxicity.kernel(words, words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert np.isclose(found[i, j], brute_kernel(words[i], words[j]), atol=1e-9), (words[i], words[j])


def test_collapsed_weights_equal_the_machine():
    words, landmarks = ["idiot", "moron", "there", "idioot"], ["idiot", "there", "nothing"]
    alpha = np.array([0.7, -0.4, 0.2])
    word, slot, weight = toxicity.subsequences(landmarks)
    slots = np.bincount(slot, weight * alpha[word], minlength=toxicity.SLOTS)
    assert np.allclose(toxicity.margins(words, slots, 0.5), toxicity.kernel(words, landmarks) @ alpha + 0.5)


def test_toxicity_query(spark):
    # The smaller tables hold a handful of toxic texts in some languages, too few to learn from.
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op8_toxic_subsequences(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in labels and fold(r["doc_id"], 4) == 2]
    truth = [labels[r["doc_id"]]["toxic"] for r in held]
    assert area([r["score"] for r in held], truth) > 0.92
    assert np.mean([r["predicted"] for r, t in zip(held, truth) if t]) > 0.9
    assert np.mean([r["predicted"] for r, t in zip(held, truth) if not t]) < 0.1


def test_toxicity_odd_rows_and_disguises(spark):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(["ba", "ko", "ti", "ren", "sul"], 3)) for _ in range(400)]
    bad = ["vexgrump", "zorfling"]
    make = lambda i: " ".join(list(rng.choice(plain, 20)) + ([bad[i // 2 % 2]] if i % 2 else []))
    docs = spark.createDataFrame(
        [(i, make(i), "x") for i in range(400)]
        + [(1000, "a v e x g r u m p b", "x"), (1001, "zorf-ling", "x"), (1002, "zorfliing!", "x"), (1003, " ".join(plain[:50]), "x"),
           (1004, None, "x"), (1005, "", "x"), (None, "ba", "x"), (1006, "w" * 5000, "x"), (1006, "w" * 5000, "x")],
        "doc_id long, text string, predicted string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (1003, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 409
    assert all((score[i] >= 0.3) == (i % 2 == 1) for i in range(400))
    assert score[1000] >= 0.3 and score[1001] >= 0.3 and score[1002] >= 0.3
    assert max(score[i] for i in (1003, 1004, 1005, 1006, None)) < 0.3
    assert {r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_every_set_of_languages_by_enumeration():
    """A text of four languages keeps all four: no smaller set has a better penalised likelihood."""
    rng = np.random.default_rng(3)
    theta = rng.dirichlet(np.full(60, 0.1), 5).astype(np.float32)
    table = np.zeros((5, language.BUCKETS), np.float32)
    table[:, :60] = np.maximum(theta, 1e-5)
    table /= table.sum(axis=1, keepdims=True)
    for size in (1, 2, 4, 5):
        counts = np.zeros((1, language.BUCKETS), np.float32)
        counts[0] = sum(rng.multinomial(6000 // size, table[i].astype(float) / table[i].astype(float).sum()) for i in range(size))
        found = language.mixtures(counts, table)[0]
        values = {}
        for k in range(1, 6):
            for chosen in itertools.combinations(range(5), k):
                shares = np.full(k, 1 / k)
                for _ in range(200):
                    p = shares @ table[list(chosen)]
                    shares = shares * (table[list(chosen)] @ (counts[0] / np.maximum(p, 1e-12))) / counts.sum()
                value = (counts[0] * np.log(np.maximum(shares @ table[list(chosen)], 1e-12))).sum() / language.OVERLAP
                values[chosen] = value - language.PENALTY * (k - 1) * np.log(counts.sum() + 1)
        assert tuple(np.flatnonzero(found > 0)) == max(values, key=values.get) == tuple(range(size))


def test_language_stage_rejects_noise_and_unlearned_scripts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(k)) for k in (5, 20, 200)]
    odd = [*noise, "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "12345", "x " * 300_000]
    more = docs.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language.recognised_rows(more, language.fit(docs)).collect()}
    assert not kept & {-1, -2, -3, -4, -5}
    plain = {r["doc_id"] for r in docs.where("length(text) > 200").collect()}
    assert len(plain - kept) <= 0.01 * len(plain)


def test_long_documents_are_learned_from(spark):
    good, bad = "A quiet sentence that reads well from its start to its end.", "BUY!!! $$$ NOW >>> click 99%"
    rows = [(i, "\n".join([good if i % 2 else bad] * 1000)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = line_quality.fit(docs, labels)
    low, high = line_quality.judge([bad, good], model)[0]
    assert low < 0.5 < high
