"""A Merkle manifest of a dataset with a witness for every row.

Every row is a leaf.  The leaves of a group (a language), in order of their ids, are
appended to a binary tree; the tree roots of all groups, in order, to another one.
In a level every two consecutive nodes become the hash of both, and one that is left
alone at the end becomes the hash of itself.

Trees are built by streaming appends.  Leaves get their places by ranges, and blocks
of ``2 ** LEVELS`` consecutive leaves, aligned with the tree, are appended by separate
tasks.  An appended node starts with a partial witness in the open subtree that
holds it; when the sibling of an open subtree is complete, the witnesses of both grow
by it.  Closing a block leaves its root, and block roots are further appends, to
a tree of their own, tier by tier until one is left.  On the way back down the
witness of a block root is what the witnesses of its leaves end with.  A task holds one block, the
driver only the number of rows of a tier and the last root.

Digests are lowercase hex text wherever they are hashed.  Odd input: a null id comes
before all others and a null group before all groups; rows of equal ids are ordered by
their leaves, and equal rows are leaves like others.  A null value is ``-``.  Further columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import whole_groups, with_package
from snaplake.operators.skew import with_positions
from snaplake.session import materialise, materialise_counted

#: A block has ``2 ** LEVELS`` leaves.
LEVELS = 12
#: On which side of a node its sibling stands.
LEFT, RIGHT, NONE = b"\x00", b"\x01", b"\x02"
WIDTH = 32


def written(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]), 256)


def group_key(column: str) -> Column:
    """A group's value as text that is never null and sorts like the value, null first."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def joined(left: bytes, right: bytes = b"") -> bytes:
    """The digest above one or two."""
    return sha256((left.hex() + right.hex()).encode()).digest()


class Appender:
    """A tree that grows leaf by leaf; ``witnesses`` holds what is known of the way up from each.

    A witness is a list of (side, sibling) from the leaf upwards; where a node was left
    alone the sibling is empty.
    """

    def __init__(self, with_witnesses: bool = True):
        self.open: list[tuple[int, bytes, int]] = []  # (level, digest, first leaf) of complete subtrees, largest first
        self.leaves = 0
        self.witnesses: list[list[tuple[bytes, bytes]]] | None = [] if with_witnesses else None

    def _extend(self, begin: int, end: int, step: tuple[bytes, bytes]) -> None:
        if self.witnesses is not None:
            for w in self.witnesses[begin:end]:
                w.append(step)

    def _join(self, level: int, digest: bytes, begin: int) -> tuple[int, bytes, int]:
        """The open subtree before this one, which is its sibling, and this one become one."""
        _, before, first = self.open.pop()
        self._extend(first, begin, (RIGHT, digest))
        self._extend(begin, self.leaves, (LEFT, before))
        return level + 1, joined(before, digest), first

    def append(self, digest: bytes) -> None:
        node = (0, digest, self.leaves)
        self.leaves += 1
        if self.witnesses is not None:
            self.witnesses.append([])
        while self.open and self.open[-1][0] == node[0]:
            node = self._join(*node)
        self.open.append(node)

    def close(self, levels: int | None = None) -> bytes:
        """Lift what is open to ``levels`` (or until one node is left) and return the root."""
        levels = (self.leaves - 1).bit_length() if levels is None else levels
        level, digest, begin = self.open.pop()
        while level < levels or self.open:
            if self.open and self.open[-1][0] == level:
                level, digest, begin = self._join(level, digest, begin)
            else:
                self._extend(begin, self.leaves, (NONE, b""))
                level, digest = level + 1, joined(digest)
        self.open.append((level, digest, begin))
        return digest


def packed(witness: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(side + sibling for side, sibling in witness)


def unpacked(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(proof):
        side, at = proof[at : at + 1], at + 1
        sibling = b"" if side == NONE else proof[at : at + WIDTH]
        at += len(sibling)
        yield side, sibling


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and the siblings on its way up lead to."""
    for side, sibling in unpacked(proof):
        leaf = joined(sibling, leaf) if side == LEFT else joined(leaf, sibling)
    return leaf


def blocks(rows: pa.Table, levels: int) -> Iterator[tuple[int, int, int | None]]:
    """(begin, end, levels) of each block; a group's only block is as high as it needs to be."""
    groups, numbers = rows.column("grp").to_pylist(), rows.column("block").to_pylist()
    begin = 0
    for end in range(1, len(groups) + 1):
        if end == len(groups) or numbers[end] != numbers[begin] or groups[end] != groups[begin]:
            yield begin, end, levels if numbers[begin] or end - begin == 1 << levels else None
            begin = end


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {1 << levels}L"))


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(grp, place, hash) of the next tier from (grp, place, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["grp", "block"]):
            hashes, out = rows.column("hash").to_pylist(), []
            starts = []
            for begin, end, height in blocks(rows, levels):
                tree = Appender(with_witnesses=False)
                for h in hashes[begin:end]:
                    tree.append(h)
                out.append(tree.close(height))
                starts.append(begin)
            first = rows.select(["grp", "block"]).take(pa.array(starts)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [first.column("grp").combine_chunks(), first.column("block").combine_chunks(), pa.array(out, pa.binary())], ["grp", "place", "hash"]
            )

    dealt = in_blocks(nodes.select("grp", "place", "hash"), levels).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    return with_package(dealt).mapInArrow(run, "grp string, place long, hash binary")


def grown(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` with ``proof``; ``above`` has the ``proof`` of each block root at (grp, place).

    All columns of ``nodes`` and ``above`` are kept.
    """
    ends = above.select(F.col("grp").alias("_grp"), F.col("place").alias("_block"), *[c for c in above.columns if c not in ("grp", "place", "hash")])
    rows = in_blocks(nodes, levels).join(ends, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block"))).drop("_grp", "_block")
    kept = [f for f in rows.schema.fields if f.name not in ("block", "proof")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["grp", "block"]):
            hashes, proofs = rows.column("hash").to_pylist(), []
            ends = rows.column("proof")
            for begin, end, height in blocks(rows, levels):
                tree = Appender()
                for h in hashes[begin:end]:
                    tree.append(h)
                tree.close(height)
                rest = ends[begin].as_py()
                proofs += [packed(w) + rest for w in tree.witnesses]
            yield from rows.select(names).append_column("proof", pa.array(proofs, pa.binary())).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", proof binary"
    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    return with_package(dealt).mapInArrow(run, schema)


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (grp, place, hash) and the block roots above them, up to one for each group."""
    nodes, seen = materialise_counted(nodes, last=F.max("place"))
    tiers = [nodes]
    while (seen["last"] or 0) > 0:
        nodes, seen = materialise_counted(block_roots(nodes, levels), last=F.max("place"))
        tiers.append(nodes)
    return tiers


def witnessed(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """Every leaf with ``subroot`` and ``proof`` (the siblings up to the root of all), and that root.

    ``leaves`` has ``grp`` (text, not null), ``doc_id``, ``hash`` (32 bytes) and any columns that
    are to be kept; ``place`` is added, its place in the group.
    """
    tiers = _tiers(with_positions(leaves, ["grp"], ["doc_id", "hash"], "place"), levels)
    subroots = tiers[-1]
    upper = _tiers(
        with_positions(subroots.select(F.col("grp").alias("own"), "hash"), [], ["own"], "place").withColumn("grp", F.lit("")), levels
    )
    top = upper[-1].select("grp", "place", "hash").first()
    if top is None:
        return leaves.withColumns({"place": F.lit(0).cast("long"), "subroot": F.col("hash"), "proof": F.col("hash")}), None
    above = upper[-1].select("grp", "place", F.lit(b"").alias("proof"))
    for tier in reversed(upper[:-1]):
        above = materialise(grown(tier, above, levels))
    if len(upper) == 1:
        above = upper[0].withColumn("proof", F.lit(b""))
    above = above.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("place"), F.col("hash").alias("subroot"), "proof")
    # A group of one leaf has no tier above it: its leaf is its root.
    for tier in reversed(tiers[1:-1]):
        above = materialise(grown(tier, above, levels).drop("hash"))
    if len(tiers) == 1:
        return tiers[0].join(above.drop("place"), "grp"), bytes(top["hash"]).hex()
    return grown(tiers[0], above, levels), bytes(top["hash"]).hex()


def audited(proofs: DataFrame, root: str | None, leaf: str = "other") -> DataFrame:
    """``proofs`` with ``folded_root``, ``verified`` and ``siblings`` (their hex digests, bottom up).

    What is folded is the digest in column ``leaf``, or ``hash`` where that is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column(leaf).to_pylist(), batch.column("hash").to_pylist(), batch.column("proof").to_pylist())
            roots, siblings = [], []
            for other, original, proof in own:
                roots.append(folded(original if other is None else other, proof).hex())
                siblings.append("".join(s.hex() for _, s in unpacked(proof)))
            table = pa.Table.from_batches([batch]).drop_columns(["proof"])
            yield from table.append_column("folded_root", pa.array(roots, pa.string())).append_column("siblings", pa.array(siblings, pa.string())).to_batches()

    kept = [f for f in proofs.schema.fields if f.name != "proof"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", folded_root string, siblings string"
    found = with_package(proofs).mapInArrow(run, schema)
    return found.withColumn("verified", F.col("folded_root") == F.lit(root))


def leaves_of(docs: DataFrame, group: str, columns: Sequence[str], changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(grp, doc_id, hash, other): a leaf for every row, and what it would be with ``changed`` columns, ``where`` they are."""
    changed = changed or {}
    other = F.when(F.lit(False) if where is None else where, F.unhex(leaf_of([changed.get(c, F.col(c)) for c in columns])))
    return docs.select(
        group_key(group).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_of([F.col(c) for c in columns])).alias("hash"), other.alias("other"),
    )
