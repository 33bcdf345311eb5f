"""Merkle fixity audit of WARC replicas.

Records are hashed, the hashes of the records that begin in one range of offsets
are hashed in their order, and sixteen neighbouring ranges at a time make a node of the
next level, up to one root for each file.  Two replicas are compared from the roots
down: only branches whose hashes differ are followed, to the ranges and then the
records that are damaged, missing or surplus.  A range holds a bounded number of
bytes and a node sixteen children, so no group grows with the size of a file.

Odd input: a null payload is an empty record; rows without a file or offset are no
records and are left out; repeated rows count once; records at one offset are ordered
by hash; other columns are ignored; an empty replica makes all records of the other
missing or surplus, and two empty ones give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators.skew import with_positions
from snaplake.session import materialise

RANGE_BYTES, FANOUT = 65_536, 16
KEYS = ["file", "level", "node"]


def warc_record(url: Column, record_id: Column, payload: Column) -> Column:
    """A response record with its header, as bytes."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(header, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def described(records: DataFrame, record: str = "record") -> DataFrame:
    """``hash`` and ``size`` of every record in the place of its bytes, which need not move any more."""
    own = F.coalesce(F.col(record), F.encode(F.lit(""), "UTF-8"))
    return records.withColumns({"hash": F.sha2(own, 256), "size": F.octet_length(own).cast("long")}).drop(record)


def laid_out(records: DataFrame, file: str, order: str) -> DataFrame:
    """Adds ``offset``, where each of the ``described`` records begins in its file: by ``order``, null first, then by hash.

    Records are written in the order of their contents, not of how they arrive, and a file may hold any number of them.
    """
    return materialise(with_positions(records, [file], [order, "hash"], "offset", amount=F.col("size")))


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, hash) of every record of a replica; ``records`` has file, offset and record bytes, or their hash."""
    known = F.sha2(F.coalesce("record", F.encode(F.lit(""), "UTF-8")), 256) if "record" in records.columns else F.col("hash")
    found = records.where("file IS NOT NULL AND offset IS NOT NULL").select(
        F.col("file").cast("string").alias("file"), F.col("offset").cast("long").alias("offset"), known.alias("hash"),
    )
    return materialise(found.distinct())


def _joined(place: str) -> Column:
    """Hash of the hashes below a node, each with its place, in order."""
    below = F.sort_array(F.collect_list(F.struct(F.col(place).cast("string").alias("at"), F.lpad(place, 20, "0").alias("_o"), "hash")), True)
    ordered = F.array_sort(below, lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).when(a["hash"] < b["hash"], -1).otherwise(1))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["at"], F.lit(":"), x["hash"])), "|"), 256).alias("hash")


def tree(records: DataFrame, levels: int) -> DataFrame:
    """(file, level, node, hash): level 0 has the ranges of offsets, the last level one root for each file."""
    level = records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).groupBy("file", "node").agg(_joined("offset"))
    found = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels + 1):
        level = level.withColumn("up", F.floor(F.col("node") / FANOUT)).groupBy("file", "up").agg(_joined("node")).withColumnRenamed("up", "node")
        found.append(level.withColumn("level", F.lit(k)))
    return materialise(reduce(DataFrame.unionByName, [f.select(*KEYS, "hash") for f in found]))


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ, or that one side lacks."""
    both = left.withColumnRenamed("hash", "ours").join(right.withColumnRenamed("hash", "theirs"), keys, "full")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs")))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, kind) of every record in which the second replica differs: damaged, missing or surplus."""
    a, b = leaves(ours), leaves(theirs)
    last = a.select("offset").unionByName(b.select("offset")).agg(F.max("offset").alias("m")).first()["m"] or 0
    levels, span = 0, last // RANGE_BYTES + 1
    while span > 1:
        levels, span = levels + 1, -(-span // FANOUT)
    one, two = tree(a, levels), tree(b, levels)
    bad = None
    for level in range(levels, -1, -1):
        x, y = (t.where(F.col("level") == level).select("file", "node", "hash") for t in (one, two))
        if bad is not None:
            # Only children of branches that differ are looked at.
            up = bad.select("file", F.col("node").alias("_up"))
            x, y = (t.withColumn("_up", F.floor(F.col("node") / FANOUT)).join(up, ["file", "_up"], "left_semi").drop("_up") for t in (x, y))
        bad = materialise(_differing(x, y, ["file", "node"]).select("file", "node"))
    x, y = (
        t.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(bad, ["file", "node"], "left_semi")
        .groupBy("file", "offset").agg(F.array_join(F.sort_array(F.collect_list("hash")), "|").alias("hash"))
        for t in (a, b)
    )
    kind = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "surplus").otherwise("damaged")
    return _differing(x, y, ["file", "offset"]).select("file", "offset", kind.alias("kind"))
