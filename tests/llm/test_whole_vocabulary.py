"""Language models over more words and bigrams than any fixed table."""

import random

import numpy as np
import pytest

from snaplake.llm import cross_entropy
from test_pipeline import losses_by_force


@pytest.mark.parametrize("chunk, part", [(2000, 6_000_000), (2, 20_000)])
def test_no_word_is_left_out(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(cross_entropy, "CHUNK_TEXTS", chunk)
    monkeypatch.setattr(cross_entropy, "SLICE_BYTES", part)
    rng = random.Random(6)
    # 45,000 words that occur twice or more, in two documents each.
    words = [f"w{i}" for i in range(45_000)]
    texts = {i: " ".join(words[i % 6 * 7500 : (i % 6 + 1) * 7500] + rng.choices(words, k=500)) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    force = losses_by_force(texts, {0, 1, 8}, words)
    rows = cross_entropy.score(docs, spark.createDataFrame([(0,), (1,), (8,)], "doc_id long")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.allclose([r["loss_target"], r["loss_background"]], force[r["doc_id"]], atol=1e-9)
