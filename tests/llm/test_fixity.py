"""Merkle fixity audit against a plain comparison of all records."""

import random

from snaplake.llm import fixity, queries

SCHEMA = "file string, offset long, record binary, hash int"


def plain(ours, theirs):
    a, b = ({(f, o): sorted({bytes(r or b"") for g, p, r in rows if (g, p) == (f, o)}) for f, o, _ in rows} for rows in (ours, theirs))
    return sorted(
        (*k, "missing" if k not in b else "surplus" if k not in a else "damaged") for k in {*a, *b} if a.get(k) != b.get(k)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_audit_equals_a_plain_comparison(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 50)
    monkeypatch.setattr(fixity, "FANOUT", 3)
    rng = random.Random(2)
    ours = [(f, o, rng.randbytes(9)) for f in ("a", "b", "same") for o in range(0, 2000, 10)]
    theirs = [(f, o, r if f == "same" or rng.random() > 0.02 else r[:-1]) for f, o, r in ours if f == "same" or rng.random() > 0.02]
    theirs += [("a", 5005, b"new"), ("c", 0, b"file"), ("same", 0, ours[-200][2])]
    found = fixity.audit(frame(spark, ours), frame(spark, theirs)).collect()
    assert sorted((r["file"], r["offset"], r["kind"]) for r in found) == plain(ours, theirs)


def test_odd_rows(spark):
    rows = [("a", 0, None), ("a", 10, b"x"), ("a", 10, b"x")]
    odd = frame(spark, rows + [(None, 1, b"y"), ("a", None, b"z")])
    assert fixity.audit(odd, frame(spark, [("a", 0, b""), ("a", 10, b"x")])).count() == 0
    assert {r["kind"] for r in fixity.audit(odd, odd.limit(0)).collect()} == {"missing"}
    assert {r["kind"] for r in fixity.audit(odd.limit(0), odd).collect()} == {"surplus"}
    assert fixity.audit(odd.limit(0), odd.limit(0)).count() == 0


def test_layout_does_not_depend_on_the_order_of_rows(spark):
    """Repeated ids, none at all, and a very long record; offsets are running sums."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.randbytes(rng.randrange(40))) for _ in range(400)] + [(7, b"x" * 2_000_000), (8, None)]
    given = spark.createDataFrame([(i, r, "f", "x") for i, r in rows], "id long, record binary, file string, offset string").drop("offset")
    first = fixity.laid_out(fixity.described(given), "file", "id")
    for other in (given.repartition(7), given.orderBy("record"), given.repartition(3, "id")):
        assert fixity.audit(first, fixity.laid_out(fixity.described(other), "file", "id")).count() == 0
    at = 0
    for r in sorted(first.collect(), key=lambda r: (r["id"] is not None, r["id"] or 0, r["hash"])):
        assert r["offset"] == at
        at += r["size"]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    ids = [r["page_id"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    wanted = {(i, "missing" if i % 211 == 7 else "damaged") for i in ids if i % 211 == 7 or i % 97 == 13}
    assert wanted and {(r["page_id"], r["kind"]) for r in queries.op3_merkle_fixity(spark, folder).collect()} == wanted
