"""Cross-entropy difference by recomputation, and the pipeline against a brute-force version of its stages."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from snaplake.llm import bpe, cross_entropy, language, line_quality, queries, tiling
from test_pairs import tiles_by_force
from test_similar import classes_by_force

SF = "/root/testdata/sf0.001"


def losses_by_force(texts, wanted, vocabulary):
    number = {w: i + 2 for i, w in enumerate(vocabulary)}
    numbered = {i: [number.get(w, 1) for w in t.lower().split()] for i, t in texts.items()}
    def counts(skip, inside):
        one, two = Counter(), Counter()
        for i, own in numbered.items():
            if i != skip and own and (i in wanted or not inside):
                one.update([0, *own])
                two.update(zip([0, *own], own))
        return one, two
    scale = sum(len(numbered[i]) for i in wanted) / sum(map(len, numbered.values()))
    out = {}
    for i, own in numbered.items():
        found = []
        for inside in (True, False):
            one, two = counts(i, inside)
            by = 1 if inside else scale
            total, places = by * sum(n for w, n in one.items() if w), len(vocabulary) + 1
            loss = []
            for h, w in zip([0, *own], own):
                alone = (by * one[w] + cross_entropy.ALPHA) / (total + cross_entropy.ALPHA * places)
                loss.append(-np.log((by * two[h, w] + cross_entropy.KAPPA * alone) / (by * one[h] + cross_entropy.KAPPA)))
            found.append(float(np.mean(loss)) if loss else None)
        out[i] = found
    return out


def test_losses_by_recomputation(spark):
    texts = {1: "The cat sat on the mat", 2: "the dog sat on the cat", 3: "a dog and a cat", 4: "zzz", 5: "", 6: "the the the the"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, target int")
    wanted = spark.createDataFrame([(1,), (3,), (3,), (None,), (77,)], "doc_id long")
    words = cross_entropy.vocabulary(docs)
    assert words[:2] == ["the", "cat"]
    force = losses_by_force(texts, {1, 3}, words)
    rows = cross_entropy.score(docs, wanted).collect()
    assert len(rows) == len(texts)
    for r in rows:
        target, background = force[r["doc_id"]]
        if target is None:
            assert r["score"] is None and r["n_words"] == 0
        else:
            assert np.isclose(r["loss_target"], target, atol=1e-5) and np.isclose(r["loss_background"], background, atol=1e-5)
            assert np.isclose(r["score"], target - background, atol=1e-5)


def test_cross_entropy_query_and_odd_rows(spark):
    rows = {r["doc_id"]: r["score"] for r in queries.op10_cross_entropy(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    side = {k: [rows[r["doc_id"]] for r in labels if r["quality"] == k and rows.get(r["doc_id"]) is not None] for k in (0, 1)}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.median(side[1]) < np.median(side[0])
    docs = spark.createDataFrame([(None, "a b", 1.0), (1, None, 1.0), (2, "a b", 1.0), (2, "a b", 1.0)], "doc_id long, text string, score double")
    got = cross_entropy.score(docs, docs.where("doc_id = 2").select("doc_id")).collect()
    assert sorted((str(r["doc_id"]), r["score"] is None) for r in got) == [("1", True), ("2", False), ("2", False), ("None", False)]
    assert all(r["score"] is None for r in cross_entropy.score(docs, docs.limit(0)).collect())
    assert cross_entropy.score(docs.limit(0), docs).count() == 0


def pipeline_by_force(spark, docs, sf_dir):
    """The stages one document at a time; only the trained models are shared."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_quality.fit(docs, labels)
    rows = [r for r in docs.collect() if line_quality.judge([r["text"] or ""], model)[0][0] >= 0.5]
    names, theta = language.fit(docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows])))
    kept = []
    for r in rows:
        pred, score, _, gain = language.judged([r["text"] or ""], names, theta.astype(np.float32))
        kept += [r] if pred[0] != "und" and score[0] >= 0.5 and gain[0] >= language.LEAST_GAIN else []
    low = classes_by_force([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if low[r["doc_id"]] == r["doc_id"]]
    items = [tiling._WORD(r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    def leaks(words):
        seen = set(zip(*(words[i:] for i in range(5))))
        near = [i for i in items if any(s in seen for s in zip(*(i[k:] for k in range(5))))]
        return any(sum(tiles_by_force(words, i, 5)) >= 0.6 * len(i) for i in near)
    return [r for r in kept if not leaks(tiling._WORD((r["text"] or "").lower()))]


def test_pipeline_by_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5 and any("near-dedup" in n for n in names)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    wanted = pipeline_by_force(spark, docs, SF)
    assert sorted(rows) == sorted(r["doc_id"] for r in wanted)
    assert 0 < len(rows) < docs.count()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.RANKS), special_tokens={})
    for r in wanted:
        assert list(memoryview(bytes(rows[r["doc_id"]]["token_ids"])).cast("I")) == encoding.encode_ordinary(r["text"] or "")


def test_stages_keep_columns_and_stand_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, None, None, None, None), (None, "", "en", "s", 0), (-5, None, "de", None, None), (-6, "x " * 50_000, None, "s", 1), (-6, "x " * 50_000, None, "s", 1)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("score", F.lit(1)).withColumn("token_ids", F.lit("t"))
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            done = stage(spark, given, SF)
            rows = done.collect()
            assert len(rows) <= docs.count()
            if at < len(corpus_pipeline.STAGES) - 1:
                assert done.columns == given.columns
