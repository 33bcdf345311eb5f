"""Version graph: links, ancestry, integrity and registration checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.operators.skew import lookup_join, with_neighbours
from snaplake.session import materialise, materialise_counted, release

MAX_ROUNDS = 40


def version_links(versions: DataFrame, version: str, ts: str, tie: str) -> DataFrame:
    """Previous and next version of each one, in time order."""
    return with_neighbours(versions, [], (ts, tie), F.col(version), "prev_version", "next_version")


def _existing_parents(versions: DataFrame, key: str, parent: str) -> DataFrame:
    """(descendant, ancestor) of every pointer that does not lead to a version that does not exist."""
    edges = versions.filter(F.col(parent).isNotNull()).select(F.col(key).alias("descendant"), F.col(parent).alias("ancestor"))
    return lookup_join(edges, versions.select(F.col(key).alias("ancestor")), ["ancestor"], "left_semi")


def lineage_of(versions: DataFrame, asked: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(asked, id, distance) of every asked version, its ancestors (below zero) and descendants (above).

    ``asked`` has one column with versions.  Only what is asked for is walked:
    round k moves everything found so far by 2**k steps, up and down, along
    pointers of that length.  There are as many pointers as versions in each
    round and no pairs but those of the answer, so a chain of a million versions
    takes 20 rounds and a million rows.
    """
    jump = materialise(_existing_parents(versions, key, parent))
    start = asked.toDF("asked").distinct()
    start = lookup_join(start.withColumn("_id", F.col("asked")), versions.select(F.col(key).alias("_id")), ["_id"], "left_semi")
    found = [start.select("asked", F.col("_id").alias("id"), F.lit(0).cast("bigint").alias("distance"))]
    up = down = materialise(found[0])
    for k in range(MAX_ROUNDS):
        step = F.lit(1 << k).cast("bigint")
        higher, seen_up = materialise_counted(
            up.join(jump, up["id"] == jump["descendant"]).select("asked", F.col("ancestor").alias("id"), (F.col("distance") - step).alias("distance")),
            n=F.count(F.lit(1)), loops=F.count_if(F.col("asked") == F.col("id")),
        )
        lower, seen_down = materialise_counted(
            down.join(jump, down["id"] == jump["ancestor"]).select("asked", F.col("descendant").alias("id"), (F.col("distance") + step).alias("distance")),
            n=F.count(F.lit(1)), loops=F.count_if(F.col("asked") == F.col("id")),
        )
        if seen_up["loops"] or seen_down["loops"]:
            raise ValueError("a version is its own ancestor")
        if not seen_up["n"] and not seen_down["n"]:
            return reduce(DataFrame.unionByName, found)
        found += [higher, lower]
        up, down = up.unionByName(higher), down.unionByName(lower)
        far = jump.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("_next"))
        jump = materialise(lookup_join(jump, far, ["ancestor"], "inner").select("descendant", F.col("_next").alias("ancestor")))
    raise ValueError(f"a chain is longer than 2**{MAX_ROUNDS} versions")


def ancestry(versions: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Every (descendant, ancestor, distance) pair of a parent-pointer graph.

    This is all there is to say about a graph, for graphs that are small or
    shallow: a chain of n versions has n (n - 1) / 2 pairs.  ``lineage_of``
    answers about given versions without them.  Pointers are doubled: after k
    rounds all pairs up to distance 2**k are known.  Each round is written to the
    shared folder, which keeps plans short and survives lost executors.
    """
    # Pairs outgrow the input, so they are spread evenly before the rounds begin.
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jump, found = materialise_counted(
        _existing_parents(versions, key, parent).repartition(parts, "descendant"), jumps=F.count(F.lit(1))
    )
    pairs = jump.withColumn("distance", F.lit(1).cast("bigint"))
    jumps, reach = found["jumps"], 1
    for _ in range(MAX_ROUNDS):
        if not jumps:
            return pairs
        # Pairs up to ``reach`` and pointers of exactly ``reach`` give pairs up to twice that.
        hop = jump.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("_next"))
        longer, found = materialise_counted(
            lookup_join(pairs, hop, ["ancestor"], "inner").select(
                "descendant", F.col("_next").alias("ancestor"), (F.col("distance") + reach).alias("distance")
            ),
            jumps=F.count_if(F.col("distance") == 2 * reach),
            loops=F.count_if(F.col("descendant") == F.col("ancestor")),
        )
        reach *= 2
        if found["loops"]:
            raise ValueError("a version is its own ancestor")
        pairs = pairs.unionByName(longer)
        jump, jumps = longer.filter(F.col("distance") == reach).select("descendant", "ancestor"), found["jumps"]
    raise ValueError(f"a chain is longer than 2**{MAX_ROUNDS} versions")


def intervals(versions: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key, begin, size, depth) of every version: its place in a walk that visits a version before its children, by key.

    ``size`` counts a version and its descendants, so those of v lie from begin to begin + size.
    The walk is a list in which every version is entered and left once; each element knows
    the next one from its first child, next sibling or parent, and pointers are doubled until
    they reach the end, adding up what they pass.  There are two rows per version in each of
    log2 rounds and no pairs, whatever the shape.
    """
    known = versions.select(F.col(key).alias("v")).distinct()
    linked = lookup_join(versions.select(F.col(key).alias("v"), F.col(parent).alias("_p")), known.select(F.col("v").alias("_p"), F.lit(True).alias("_there")), ["_p"])
    nodes = linked.select("v", F.when(F.col("_there"), F.col("_p")).alias("p"))
    # Roots are each other's siblings.
    nodes, seen = materialise_counted(with_neighbours(nodes, ["p"], ("v",), F.col("v"), None, "sibling"), n=F.count(F.lit(1)))
    eldest = nodes.where("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.min("v").alias("child"))
    enter = lookup_join(nodes, eldest, ["v"]).select(
        "v", F.lit(False).alias("left"), F.coalesce("child", "v").alias("to"), F.col("child").isNull().alias("to_left"),
        F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deeper"),
    )
    leave = nodes.select(
        "v", F.lit(True).alias("left"), F.coalesce("sibling", "p").alias("to"), (F.col("sibling").isNull() & F.col("p").isNotNull()).alias("to_left"),
        F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deeper"),
    )
    walk, left = materialise_counted(enter.unionByName(leave), open=F.count("to"))
    for _ in range((2 * seen["n"]).bit_length() + 1):
        if not left["open"]:
            break
        ahead = walk.select(
            F.col("v").alias("to"), F.col("left").alias("to_left"), F.col("to").alias("_to"), F.col("to_left").alias("_to_left"),
            F.col("entered").alias("_entered"), F.col("deeper").alias("_deeper"),
        )
        # What has reached the end looks nothing up: in the join its NULLs, in the end half of all rows, would come to one task.
        moved = walk.where("to IS NOT NULL").join(ahead, ["to", "to_left"], "left").select(
            "v", "left", F.col("_to").alias("to"), F.coalesce("_to_left", F.lit(False)).alias("to_left"),
            (F.col("entered") + F.coalesce("_entered", F.lit(0))).alias("entered"), (F.col("deeper") + F.coalesce("_deeper", F.lit(0))).alias("deeper"),
        ).unionByName(walk.where("to IS NULL"))
        before = walk
        walk, left = materialise_counted(moved, open=F.count("to"))
        release(before)
    if left["open"]:
        raise ValueError("a version is its own ancestor")
    ends = walk.groupBy("v").agg(
        F.max(F.when(~F.col("left"), F.col("entered"))).alias("here"), F.max(F.when(F.col("left"), F.col("entered"))).alias("behind"),
        F.max(F.when(~F.col("left"), F.col("deeper"))).alias("rise"),
    )
    return ends.select(
        F.col("v").alias(key), (F.lit(seen["n"]) - F.col("here")).alias("begin"), (F.col("here") - F.col("behind")).alias("size"), (-F.col("rise")).alias("depth")
    )


def are_ancestors(labels: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """``pairs`` (ancestor, descendant) with ``related``: whether the first is above the second, by ``intervals`` alone."""
    side = lambda name: labels.select(F.col(key).alias(name), F.struct("begin", "size").alias(f"_{name}"))
    both = lookup_join(lookup_join(pairs, side("ancestor"), ["ancestor"]), side("descendant"), ["descendant"])
    above = (F.col("_ancestor.begin") < F.col("_descendant.begin")) & (F.col("_descendant.begin") < F.col("_ancestor.begin") + F.col("_ancestor.size"))
    return both.select(*pairs.columns, F.coalesce(above, F.lit(False)).alias("related"))


def broken_links(versions: DataFrame, key: str, links: dict[str, str]) -> DataFrame:
    """(id, link, target) for each link whose target version does not exist."""
    known = versions.select(F.col(key).alias("target"))
    rows = F.array(*[
        F.struct(F.lit(label).alias("link"), F.col(c).alias("target")) for c, label in links.items()
    ])
    named = versions.select(F.col(key).alias("id"), F.inline(rows)).filter("target IS NOT NULL")
    return lookup_join(named, known, ["target"], "left_anti").select("id", "link", "target")


def broken_children(versions: DataFrame, children: DataFrame) -> DataFrame:
    """(id, child) pairs that the child itself does not confirm as its parent.

    ``versions`` has id and parent, ``children`` has id and child.
    """
    confirmed = versions.select(F.col("id").alias("child"), F.col("parent").alias("_parent"))
    joined = lookup_join(children, confirmed, ["child"], "left")
    return joined.filter(~F.col("_parent").eqNullSafe(F.col("id"))).select("id", "child")


def head_version(versions: DataFrame, version: str, ts: str, tie: str) -> DataFrame:
    return versions.agg(F.max_by(version, F.struct(ts, tie)).alias("head"))


def registration_errors(known: DataFrame, incoming: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Incoming versions that may not be registered, with the reason."""
    present = known.select(key).distinct().withColumn("_known", F.lit(True))
    parents = known.select(F.col(key).alias(parent)).distinct().withColumn("_parent_known", F.lit(True))
    judged = lookup_join(lookup_join(incoming, present, [key]), parents, [parent])
    return judged.withColumn(
        "error",
        F.when(F.col("_known").isNotNull(), "duplicate version")
        .when(F.col(parent).isNotNull() & F.col("_parent_known").isNull(), "unknown parent"),
    ).filter("error IS NOT NULL").select(key, parent, "error")
