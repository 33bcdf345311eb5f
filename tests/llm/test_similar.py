"""Classes of similar texts against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

from snaplake.llm import simhash, similar
from test_pairs import lowest

SF = "/root/testdata/sf0.01"


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def classes_by_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if 5 * len(a & b) >= 4 * len(a | b)]
    return lowest([i for i, _ in rows], links)


def edited(seed, n):
    """Texts of which some are copies with a few words changed, a common passage in a third of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            parts = rng.choice(texts).split()
            for _ in range(rng.randrange(5)):
                parts[rng.randrange(len(parts))] = word()
        else:
            parts = [word() for _ in range(rng.randint(4, 150))]
            if rng.random() < 0.4:
                parts[2:2] = passage
        texts.append(" ".join(parts))
    return [*enumerate(texts), (n, None), (n + 1, " ")]


@pytest.mark.parametrize("block", [2048, 7])
def test_classes_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = edited(3, 250)
    found = similar.near_duplicates(spark.createDataFrame(rows, "row long, text string")).collect()
    assert {r["row"]: r["class"] for r in found} == classes_by_force(rows)


def test_lightly_edited_copies_leave_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    low = classes_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in simhash.unique_rows(docs).collect()} == {i for i, j in low.items() if i == j}


def test_rows_that_repeat_an_id_stand_for_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, b), (5, a), (5, b), (None, a + " more"), (None, None), (9, ""), (5, a), (2, b.upper())]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = simhash.unique_rows(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[:2] for r in got.collect()) == sorted([(1, b), (5, a), (9, "")])
    assert simhash.unique_rows(docs.limit(0)).count() == 0


def test_fine_counts_are_lower_bounds():
    rng = np.random.default_rng(5)
    for n in (300, 700, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        two = np.unique(np.r_[one[rng.random(len(one)) < 0.7], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)])
        differ = len(np.setxor1d(one, two))
        assert 0.2 * differ < similar.apart(similar.fine_parts_of(one), similar.fine_parts_of(two)) <= differ
        assert similar.apart(similar.fine_parts_of(one), similar.fine_parts_of(one[:200])) == 0


def test_bounds_lose_no_link():
    """Counts by parts, prefixes and sizes allow every pair that links."""
    rng = random.Random(1)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    for _ in range(200):
        n = rng.choice([rng.randint(1, 200), rng.randint(900, 1300)])
        one = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        two = np.unique(np.r_[rng.sample(list(one), len(one) - rng.randint(0, len(one) // 5)), np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 6))], np.uint64)])
        if similar.enough(len(np.intersect1d(one, two)), len(one), len(two)):
            sizes = [np.array([len(x)]) for x in (one, two)]
            assert similar.near(similar.parts_of(one)[None], sizes[0], similar.parts_of(two)[None], sizes[1]).all()
            assert similar.link_left(len(one), similar.fine_parts_of(one), len(two), similar.fine_parts_of(two))
            odd = [np.unpackbits(similar.odd_parts_of(x)).astype(int) for x in (one, two)]
            assert np.abs(odd[0] - odd[1]).sum() <= len(np.setxor1d(one, two))
            assert similar.near_enough(np.abs(odd[0] - odd[1]).sum(), len(one), len(two))
            some = rng.sample(list(one), len(one) // 2)
            for frequent in (none, (np.sort(np.array(some, np.uint64)), np.arange(len(some), dtype=np.int32) + 1)):
                assert len(np.intersect1d(similar.prefix(one, frequent), similar.prefix(two, frequent)))


def test_a_pair_is_told_where_it_meets_first(spark, monkeypatch):
    """Texts that nearly link meet at many shingles; what is told must not grow with their number."""
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(3000)], []
    for i in range(10):
        parts = list(base)
        for at in rng.sample(range(3000), 43):
            parts[at] = f"x{i}_{at}"
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[0] + " and more"), (99, texts[0] + " and more")], "row long, text string")
    found, other_pairs, per_group = [], similar.other_pairs, similar.per_group

    def spied(df, keys, then, find):
        if find is other_pairs:
            table = df.orderBy(*keys, *then).toArrow()
            a, b = find([c.to_numpy() for c in table.columns])
            found.append((len(a), len(set(zip(np.minimum(a, b), np.maximum(a, b))))))
        return per_group(df, keys, then, find)

    monkeypatch.setattr(similar, "per_group", spied)
    low = classes_by_force([(i, t) for i, t in enumerate(texts)])
    got = {r["row"]: r["class"] for r in similar.near_duplicates(docs).collect()}
    assert {i: got[i] for i in low} == low and got[99] == got[0]
    ((told, pairs),) = found
    assert pairs > 30 and told <= 8 * pairs


def test_fingerprints_join_what_simhash_links(spark):
    """Candidates by fingerprints reach as far as simhash does by itself, not only to texts that are nearly copies."""
    rows = edited(3, 250)
    sets = similar.marked_sets(spark.createDataFrame(rows, "row long, text string")).dropDuplicates(["node"])
    prints = {similar.node_of(similar.shingle_set(t or "")): simhash.fingerprint(t or "", 5) for _, t in rows}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    low = lowest(list(prints), close)
    assert any((prints[a] ^ prints[b]).bit_count() > 1 for a, b in close)
    assert sorted(map(tuple, similar.fingerprint_pairs(sets).collect())) == sorted((j, i) for i, j in low.items() if i != j)


def test_all_texts_of_a_repeated_number_are_compared(spark):
    a, b = ([f"{x}{i}" for i in range(100)] for x in "ab")
    rows = [(1, a), (1, b), (2, [*b[:50], "x", *b[51:]]), (3, [*b[:20], "y", *b[21:]])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "row long, text string").coalesce(1)
    assert sorted(map(tuple, similar.near_duplicates(docs).collect())) == [(1, 1), (1, 1), (2, 1), (3, 1)]
