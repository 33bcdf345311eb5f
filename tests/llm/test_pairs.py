"""SimHash classes, components, nearest vectors and benchmark passages against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snaplake.llm import adaptive_scan, components, queries, simhash, tiling

SF = "/root/testdata/sf0.001"


def lowest(nodes, links):
    """Smallest node of the component of every node."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def classes(prints):
    """(id, fingerprint) rows to the smallest id that links of four bits reach."""
    near = [(a, b) for i, (a, _) in enumerate(prints) for j, (b, _) in enumerate(prints[:i]) if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4]
    return lowest([a for a, _ in prints], near)


def test_fingerprint_by_definition():
    text = "The quick  BROWN\tfox\njumps over\x0bthe lazy dog ÄÖ The quick brown fox"
    words = "the quick brown fox jumps over the lazy dog ÄÖ the quick brown fox".split(" ")
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(len(words) - 3)]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    assert simhash.fingerprint(text) == sum(1 << b for b, on in enumerate(bits) if on)
    assert simhash.fingerprint("One two") == xxhash.xxh64(b"one two", seed=42).intdigest()
    assert simhash.fingerprint("") == simhash.fingerprint(" \n ") == 0


@pytest.mark.parametrize("segment_bits", [1, 2, 4])
def test_grid_meets_every_close_pair(segment_bits):
    rng = random.Random(8)
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        point, fp = simhash.grid_points(np.array([a, b], np.uint64).view(np.int64), segment_bits, 1)
        own = np.array([a], np.uint64).view(np.int64)[0]
        assert set(point[fp == own]) & set(point[fp != own])


def prints_with_clusters(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(n // 6):
            fp = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << bit
            out.append(fp)
    return sorted(set(out))


@pytest.mark.parametrize("block", [2048, 7])
def test_links_join_what_brute_force_joins(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = np.array(prints_with_clusters(9, 240), np.uint64).view(np.int64).tolist()
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()
    low = lowest(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4])
    assert {r["node"]: r["root"] for r in found} == {a: b for a, b in low.items() if list(low.values()).count(b) > 1}


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, i) for i in range(2000, 2400)]
    rows = components.components(spark.createDataFrame(chain + star + [(5, 5), (None, 7)], "node long, root long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) == 301 + 401
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for _, i in star)
    assert components.components(spark.createDataFrame([], "node long, root long")).count() == 0


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r["doc_id"], simhash.fingerprint(r["text"] or "")) for r in docs]
    low = classes(prints)
    rows = queries.op9_simhash_segments(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{fp:016x}", low[i]) for i, fp in prints}
    assert len(rows) == len(docs)


def test_simhash_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (7, None, 1), (8, "", 1), (9, "other words stand here now", 1), (None, "alone", 1)],
        "doc_id long, text string, fp int",
    )
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("7", "7"), ("8", "7"), ("9", "9"), ("None", "None")])
    kept = simhash.unique_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [
        ("3", text), ("7", None), ("9", "other words stand here now"), ("None", "alone")
    ]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def nearest_by_force(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = set()
    for q, v in rows:
        if q % 20:
            continue
        others = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in rows if i != q)
        out |= {(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(others[:k])}
    return out


def as_set(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


def test_nearest_with_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "TASK_VECTORS", 60)
    monkeypatch.setattr(adaptive_scan, "TASK_QUERIES", 7)
    # All lists are scanned and no candidate is dropped on a guess, so the result must be exact.
    monkeypatch.setattr(adaptive_scan, "RECALL", 1.0)
    monkeypatch.setattr(adaptive_scan, "SURE", 1e6)
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=12)).tolist()) for i in range(240)]
    copy = np.float32(rng.normal(size=12)).tolist()
    rows += [(i, copy) for i in range(240, 400)]
    odd = [(500, None), (501, [0.0] * 12), (502, [None] * 12), (503, [float("nan")] * 12), (504, [float("inf")] * 12), (505, [1.0] * 5), (None, copy)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<float>, score double")
    assert as_set(adaptive_scan.nearest(df, F.col("id") % 20 == 0, k=5)) == nearest_by_force(rows, 5)
    few = df.where("vec_id < 3 or vec_id in (20, 40)")
    assert as_set(adaptive_scan.nearest(few, F.col("id") % 20 == 0, k=20)) == nearest_by_force([r for r in rows if r[0] < 3 or r[0] in (20, 40)], 20)
    assert adaptive_scan.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert adaptive_scan.nearest(df.where("vec_id = 20"), F.col("id") % 20 == 0).count() == 0


def test_nearest_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    force, found = nearest_by_force(rows, 20), as_set(queries.op5_adaptive_scan(spark, SF))
    assert len(found) == len(force)
    pairs = lambda s: {(q, v) for q, _, v, _ in s}
    assert len(pairs(force) & pairs(found)) >= 0.9 * len(force)


def test_probed_lists_reach_the_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32)) + 2 * rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)]
    x *= rng.uniform(0.5, 2, (6000, 1))
    model = adaptive_scan.Model(x, float(np.sqrt((x**2).sum(axis=1).max())), 100_000, 11)
    lists = model.order(model.turned(x), 1)[:, 0]
    asked = x[:200]
    probes = model.order(model.turned(asked, queries=True), model.probes)
    row, ids, score = adaptive_scan.scan(x, lists, np.arange(6000), asked, probes, model, 11)
    hits = 0
    for q in range(200):
        value = x @ asked[q]
        hits += len(set(np.argsort(-value)[:11]) & set(ids[row == q]))
        assert np.allclose(score[row == q], value[ids[row == q]])
    assert model.probes < len(model.centres) and hits >= 0.9 * 200 * 11


def tiles_by_force(a, b, least):
    """Greedy string tiling by looking at all pairs of places again and again."""
    used_a, used_b, total = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        total.append(n)
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


def test_tiling_by_force():
    rng = random.Random(10)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(3, 14))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 10))] + item[len(item) // 2 :] + ["x"] + item[: len(item) // 2]
        items = tiling.Items([(1, " ".join(item))])
        seed = min(tiling.SEED_WORDS, len(item))
        found = tiling.contained(tiling.word_hashes(" ".join(doc)), items, 1e-9)
        wanted = tiles_by_force(doc, item, seed)
        assert [round(f[1] * len(item)) for f in found] == ([sum(wanted)] if wanted else [])


def test_reordered_and_edited_passages(spark):
    parts = [" ".join(f"{w}{i}" for i in range(8)) for w in ("one", "two", "three")]
    benchmark = spark.createDataFrame(
        [(1, ". ".join(parts), 0), (1, ". ".join(parts), 0), (2, "short item", 0), (3, None, 0), (4, "", 0), (None, "x", 0)], "item_id long, text string, doc_id int"
    )
    docs = spark.createDataFrame(
        [(1, f"before {parts[2].upper()}, between {parts[0]} and {parts[1]}", 0), (2, f"only {parts[1]}", 0), (3, "a Short, item!", 0),
         (4, None, 0), (5, "", 0), (6, "short of an item", 0), (None, ". ".join(parts), 0), (3, "a Short, item!", 0)],
        "doc_id long, text string, item_id int",
    )
    rows = sorted((str(r["doc_id"]), r["item_id"], round(r["coverage"], 6), r["n_tiles"]) for r in tiling.contaminated(docs, benchmark).collect())
    assert rows == [("1", 1, 1.0, 3), ("3", 2, 1.0, 1), ("3", 2, 1.0, 1), ("None", 1, 1.0, 1)]
    kept = tiling.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]
    assert tiling.contaminated(docs.limit(0), benchmark).count() == tiling.contaminated(docs, benchmark.limit(0)).count() == 0


def test_item_blocks_change_nothing(spark, monkeypatch):
    whole = sorted(queries.op6_string_tiling(spark, SF).collect())
    monkeypatch.setattr(tiling, "BLOCK_CHARS", 1500)
    assert sorted(queries.op6_string_tiling(spark, SF).collect()) == whole


def test_tiling_query(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, u in items if u in t}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op6_string_tiling(spark, SF).collect()}
    assert whole and whole <= found
