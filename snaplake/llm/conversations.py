r"""Cheapest repair of the turn structure of conversations.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: an optional
system turn, then user and assistant in turns.  Rows are kept (0), get the role
``user`` or ``assistant`` (Rerole, 2) or are deleted (3; blank and repeated rows must be), and
empty rows of either role are inserted anywhere (2); a truncated row that is not
deleted costs 1.  Of all cheapest repairs the one whose audit, the initials of its
edits in order, is the least text is taken.

What may follow a row depends on one of four states only.  A conversation is cut into
chunks of ``CHUNK`` rows; each chunk becomes a matrix of costs from state to
state, the matrices of a conversation are folded from its end, and then
every chunk knows what lies behind it.  Inside a chunk the costs to the end give the optimal
arcs.  Nodes are ranked by what audits follow them, the first letter at first, then by
prefixes of 2, 4, 8 ... letters: the rank of a node and the rank of the node its pointer
leads to give the rank for twice the length, and the pointer is doubled.  Ranks choose
among the arcs of a node, and the doubled pointers list the path from the state in which
the chunk begins.  So a conversation of any length is spread over many tasks; only
its digest has to see it in order, row after row, and holds none of it.

Odd input: a null role or text is one space.  Rows are ordered by turn, null first, then
role, then a hash of the text.  A null ``conv_id`` is a conversation.  A role
of another initial, or none, can only be replaced or deleted.  Equal rows after the first are
duplicates.  Further columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from snaplake.llm.common import whole_groups, with_package
from snaplake.llm.manifest import group_key
from snaplake.operators.skew import lookup_join, with_positions
from snaplake.session import materialise

CHUNK = 2048
WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The turn that an inserted or replaced row becomes in each state.
NEEDED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cheapest insertions behind the last row; only START and ASSISTANT are whole.
AT_END = (0, 4, 2, 0)
FAR = 1 << 50
LEGAL = ("su", "ua", "au")
#: What keeping a row of this initial leads to in each state; other initials cannot be kept.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}


def row_arcs(initial: str, doomed: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: (letter, cost, state behind it)."""
    out = []
    for state in range(STATES):
        arcs = [("D", DELETE, state)]
        if not doomed:
            kept = KEPT.get(initial, (None,) * STATES)[state]
            if kept is not None:
                arcs.append(("K", KEEP + TRUNCATED * truncated, kept))
            arcs.append(("R", REROLE + TRUNCATED * truncated, NEEDED[state]))
        out.append(arcs)
    return out


ARCS = {(i, d, t): row_arcs(i, d, t) for i in (*KEPT, "") for d in (False, True) for t in (False, True)}


def arcs_of(initial: str, doomed: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    return ARCS[initial if initial in KEPT else "", doomed, truncated]


def inserted(costs: list[int]) -> list[int]:
    """Costs to the end where rows may be inserted before going on."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


def costs_before(arcs, after: list[int]) -> list[int]:
    """Costs to the end before a row, from those behind it."""
    return inserted([min(cost + after[to] for _, cost, to in arcs[state]) for state in range(STATES)])


def combined(matrix: list[int], after: list[int]) -> list[int]:
    """Costs to the end before a chunk, from its matrix and the costs behind it."""
    return [min(matrix[STATES * s + t] + after[t] for t in range(STATES)) for s in range(STATES)]


class Nodes:
    """Nodes (rows read, state) of several chunks and their optimal arcs, ranked by the audits behind them."""

    def __init__(self):
        #: Per node and letter in alphabetical order the node behind it, or -1.
        self.arcs: list[list[int]] = []
        self.longest = 0

    def add(self, rows: list, after: list[int], last: bool) -> int:
        """The nodes of a chunk; returns the number of its first.  ``rows`` holds the arcs of each row."""
        first, n = len(self.arcs), len(rows)
        costs = [after]
        for arcs in reversed(rows):
            costs.append(costs_before(arcs, costs[-1]))
        costs.reverse()
        if last:
            # Behind the last row rows may be inserted; what is whole ends there.
            costs[n] = list(AT_END)
        for i in range(n + 1):
            for state in range(STATES):
                own, here = [-1] * len(LETTERS), costs[i][state]
                if i < n:
                    for letter, cost, to in rows[i][state]:
                        if cost + costs[i + 1][to] == here:
                            own[LETTERS.index(letter)] = first + STATES * (i + 1) + to
                if (i < n or last) and INSERT + costs[i][NEEDED[state]] == here:
                    own[LETTERS.index("I")] = first + STATES * i + NEEDED[state]
                self.arcs.append(own)
        self.longest = max(self.longest, 3 * (n + 1))
        return first

    def rank(self) -> None:
        """Rank all nodes by prefixes of doubled length, then let the ranks choose each node's arc."""
        arcs = np.array(self.arcs, np.int64).reshape(-1, len(LETTERS))
        ends = (arcs < 0).all(axis=1)
        letter = np.where(ends, 0, 1 + (arcs >= 0).argmax(axis=1))
        here = np.arange(len(arcs))
        pointer = np.where(ends, here, arcs[here, np.maximum(letter - 1, 0)])
        rank, steps = letter.astype(np.int64), 1
        while steps < self.longest:
            _, doubled = np.unique(rank * (len(arcs) + 2) + rank[pointer], return_inverse=True)
            pointer, steps = pointer[pointer], 2 * steps
            if (doubled == rank).all():
                break
            rank = doubled
        # The least (letter, rank behind it) of each node's arcs.
        weight = np.where(arcs >= 0, np.arange(len(LETTERS)) * (len(arcs) + 2) + rank[arcs], np.iinfo(np.int64).max)
        chosen = weight.argmin(axis=1)
        self.ends = ends
        self.letter = chosen
        self.next = np.where(ends, here, arcs[here, chosen])

    def paths(self, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each start the nodes of its least path, their letters, and the node where it ends.

        Doubled pointers give step 2k and 2k + 1 of a path from step k.
        """
        pointers, bits = [self.next], 1
        while 1 << bits <= self.longest:
            pointers.append(pointers[-1][pointers[-1]])
            bits += 1
        # The length of a path: as many steps as leave it before its end, found from the largest down.
        at, length = starts.copy(), np.zeros(len(starts), np.int64)
        for bit in reversed(range(bits)):
            ahead = pointers[bit][at]
            go = ~self.ends[ahead]
            at, length = np.where(go, ahead, at), length + (go << bit)
        length += ~self.ends[starts]  # True where a path has a step at all
        begin = np.r_[0, np.cumsum(length)]
        step = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
        node = np.repeat(starts, length)
        for bit in range(bits):
            node = np.where((step >> bit) & 1, pointers[bit][node], node)
        out = []
        for k in range(len(starts)):
            own = node[begin[k] : begin[k + 1]]
            out.append((own, self.letter[own], int(self.next[own[-1]]) if len(own) else int(starts[k])))
        return out


LETTERS = "DIKR"


# ------------------------------------------------------------------ the rows
def _placed(rows: DataFrame) -> DataFrame:
    """Rows without their texts, in their places, with what is wrong with them."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    slim = rows.select(
        group_key("conv_id").alias("grp"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    placed = materialise(with_positions(slim, ["grp"], ["turn", "role", "a", "b"], "place"))
    same = ["grp", "role", "a", "b"]
    first = placed.where("NOT blank").groupBy(*same).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = lookup_join(placed, first.select(*same, "first"), same, "left", counts=first)
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return materialise(
        marked.withColumn("duplicate", duplicate)
        .withColumn("truncated", F.expr("open AND NOT blank AND NOT duplicate")).drop("open", "first")
        .withColumn("chunk", F.expr(f"place div {CHUNK}L"))
    )


def _dealt(df: DataFrame, *then: str | Column, keys: tuple[str, ...] = ("grp", "chunk")) -> DataFrame:
    return with_package(df).repartition(*keys).sortWithinPartitions(*keys, *then)


def _runs(*keys: list) -> Iterator[tuple[int, int]]:
    """(begin, end) of equal neighbours."""
    begin, n = 0, len(keys[0])
    for end in range(1, n + 1):
        if end == n or any(k[end] != k[begin] for k in keys):
            yield begin, end
            begin = end


def _row_arcs(rows: pa.Table) -> list:
    columns = [rows.column(c).to_pylist() for c in ("role", "blank", "duplicate", "truncated")]
    return [arcs_of(role[:1], blank or duplicate, truncated) for role, blank, duplicate, truncated in zip(*columns)]


def _matrices(placed: DataFrame) -> DataFrame:
    """(grp, chunk, matrix, illegal, first, final): each chunk's costs, illegal neighbours and outer initials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["grp", "chunk"]):
            arcs, grp, chunk = _row_arcs(rows), rows.column("grp").to_pylist(), rows.column("chunk").to_pylist()
            initials = [r[:1] for r in rows.column("role").to_pylist()]
            out = []
            for begin, end in _runs(grp, chunk):
                columns = []
                for to in range(STATES):
                    costs = [FAR] * STATES
                    costs[to] = 0
                    for row in reversed(arcs[begin:end]):
                        costs = costs_before(row, costs)
                    columns.append(costs)
                illegal = sum(initials[i] + initials[i + 1] not in LEGAL for i in range(begin, end - 1))
                out.append((grp[begin], chunk[begin], [columns[t][s] for s in range(STATES) for t in range(STATES)], illegal, initials[begin], initials[end - 1]))
            yield pa.RecordBatch.from_arrays([
                pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()))
            ], ["grp", "chunk", "matrix", "illegal", "first", "final"])

    picked = placed.select("grp", "chunk", "place", "role", "blank", "duplicate", "truncated")
    return _dealt(picked, "place").mapInArrow(run, "grp string, chunk long, matrix array<long>, illegal long, first string, final string")


def _streamed(df: DataFrame, order: list[str | Column], step, schema: str) -> DataFrame:
    """Rows of each conversation in ``order``; ``step(state, row)`` returns the next state and a row, and starts from None."""
    dealt = _dealt(df, *order, keys=("grp",))
    names, typed = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(n).to_pylist() for n in names]):
                row = dict(zip(names, row))
                if row["grp"] != grp:
                    grp, state = row["grp"], None
                state, told = step(state, row)
                out.append(told)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=typed)

    return dealt.mapInArrow(run, schema)


def _behind(matrices: DataFrame) -> DataFrame:
    """(grp, chunk, after, last, cost, illegal): costs behind each chunk; cost and illegal of all stand at chunk 0."""

    def step(state, row):
        after, illegal, first = state or (list(AT_END), 0, None)
        before = combined(row["matrix"], after)
        illegal += row["illegal"] + (first is not None and row["final"] + first not in LEGAL)
        told = {"grp": row["grp"], "chunk": row["chunk"], "after": after, "last": state is None, "cost": before[START], "illegal": illegal}
        return (before, illegal, row["first"]), told

    return _streamed(
        matrices, [F.col("chunk").desc()], step, "grp string, chunk long, after array<long>, last boolean, cost long, illegal long"
    )


def _per_chunk(placed: DataFrame, ends: DataFrame, build, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run ``build`` over runs of whole chunks with the nodes of all of them ranked together."""
    picked = placed.select("grp", "chunk", "place", "role", "blank", "duplicate", "truncated", "turn", "a", "b")
    # One row per chunk meets at most CHUNK rows.
    rows = picked.join(ends.select("grp", "chunk", "after", "last", *extra), ["grp", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["grp", "chunk"]):
            arcs, nodes, spans, firsts = _row_arcs(rows), Nodes(), [], []
            after, last = rows.column("after"), rows.column("last")
            for begin, end in _runs(rows.column("grp").to_pylist(), rows.column("chunk").to_pylist()):
                firsts.append(nodes.add(arcs[begin:end], after[begin].as_py(), last[begin].as_py()))
                spans.append((begin, end))
            nodes.rank()
            yield build(rows, nodes, spans, firsts)

    return _dealt(rows, "place").mapInArrow(run, schema)


def _begins(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """(grp, chunk, begins): the state in which each chunk after the first of a conversation begins."""
    several = ends.where("NOT last").select("grp", "chunk", "after", "last")

    def build(rows, nodes, spans, firsts):
        starts = np.add.outer(np.array(firsts, np.int64), np.arange(STATES)).ravel()
        ends_at = [end for *_, end in nodes.paths(starts)]
        leads = [[(ends_at[STATES * k + s] - firsts[k]) % STATES for s in range(STATES)] for k in range(len(firsts))]
        at = pa.array([begin for begin, _ in spans])
        picked = rows.select(["grp", "chunk"]).take(at).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [picked.column("grp").combine_chunks(), picked.column("chunk").combine_chunks(), pa.array(leads, pa.list_(pa.int64()))], ["grp", "chunk", "leads"]
        )

    leads = _per_chunk(placed, several, build, "grp string, chunk long, leads array<long>")

    def step(state, row):
        state = row["leads"][state or START]
        return state, {"grp": row["grp"], "chunk": row["chunk"] + 1, "begins": state}

    return _streamed(leads, ["chunk"], step, "grp string, chunk long, begins long")


def _edits(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """(grp, place, at, edit, role, own, a, b): every edit in order; ``own`` is the row's role before it."""

    def build(rows, nodes, spans, firsts):
        begins = rows.column("begins")
        starts = np.array([f + begins[b].as_py() for f, (b, _) in zip(firsts, spans)], np.int64)
        grp, origin, place, at, edit, role = [], [], [], [], [], []
        named, own_roles, places = (rows.column(c).to_pylist() for c in ("grp", "role", "place"))
        for first, (begin, end), (path, letters, _) in zip(firsts, spans, nodes.paths(starts)):
            step, row = 0, -1
            for node, letter in zip((path - first).tolist(), letters.tolist()):
                i, state = divmod(node, STATES)
                step = step + 1 if i == row else 0
                row, here = i, LETTERS[letter]
                i += begin
                grp.append(named[begin])
                # An inserted row has nothing of the row it stands before; behind the last row it takes the place after it.
                origin.append(None if here == "I" else i)
                place.append(places[i] if i < end else places[end - 1] + 1)
                at.append(step)
                edit.append(here)
                role.append(own_roles[i] if here in "DK" else ROLES[NEEDED[state]])
        taken = rows.select(["role", "a", "b"]).take(pa.array(origin, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([
            pa.array(grp, pa.string()), pa.array(place, pa.int64()), pa.array(at, pa.int32()), pa.array(edit, pa.string()),
            pa.array(role, pa.string()), *[taken.column(c).combine_chunks() for c in ("role", "a", "b")],
        ], ["grp", "place", "at", "edit", "role", "own", "a", "b"])

    later = _begins(placed, ends)
    known = ends.join(later, ["grp", "chunk"], "left").withColumn("begins", F.coalesce("begins", F.lit(START).cast("long")))
    return _per_chunk(placed, known, build, "grp string, place long, at int, edit string, role string, own string, a long, b long", ("begins",))


# ------------------------------------------------------------------- results
def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of ``conv_id:turn`` deals out: one row in four gets one."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    fault = F.crc32(F.concat_ws(":", *words).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return marked.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and every edit that repairs it.

    The first frame has (grp, gaps, blank, duplicate, truncated, illegal, cost), the second (grp, place, at,
    edit, role, text) in the order of place and at; rows of edit D are not part of the repaired
    conversation and have no text.  ``grp`` is ``manifest.group_key`` of ``conv_id``.
    """
    placed = _placed(rows)
    ends = materialise(_behind(_matrices(placed)))
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    wrong = placed.groupBy("grp").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    wrong = wrong.join(ends.where("chunk = 0").select("grp", "illegal", "cost"), "grp")
    edits = materialise(_edits(placed, ends))
    # Of equal rows only the first is not deleted, so an edit meets one text and a text one edit.
    same = ["grp", "own", "a", "b"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    texts = rows.select(
        group_key("conv_id").alias("grp"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("own"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"),
    ).groupBy(*same).agg(F.first("text").alias("text"))
    out = ["grp", "place", "at", "edit", "role", "text"]
    kept = edits.where("edit IN ('K', 'R')").join(texts, same).select(*out)
    others = edits.where("edit IN ('D', 'I')").withColumn("text", F.when(F.col("edit") == "I", F.lit(""))).select(*out)
    return wrong, kept.unionByName(others)


def digests(edits: DataFrame) -> DataFrame:
    """(grp, audit, repaired_sha256); a conversation passes through one hash in order, nothing of it is held but its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, audit, seen, some = None, [], sha256(), False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"grp": [grp], "audit": ["".join(audit)], "repaired_sha256": [seen.hexdigest()]}, schema=typed)

        for batch in batches:
            done = []
            for own, edit, role, text in zip(*[batch.column(c).to_pylist() for c in ("grp", "edit", "role", "text")]):
                if own != grp:
                    if grp is not None:
                        done.append(told())
                    grp, audit, seen, some = own, [], sha256(), False
                audit.append(edit)
                if edit != "D":
                    seen.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if grp is not None:
            yield told()

    schema = "grp string, audit string, repaired_sha256 string"
    typed = to_arrow_schema(StructType.fromDDL(schema))
    return _dealt(edits, "place", "at", keys=("grp",)).mapInArrow(run, schema)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``conversations``: what is wrong with its ``rows`` and how they are repaired."""
    wrong, edits = repaired(rows)
    every = conversations.select("conv_id").distinct().withColumn("grp", group_key("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = every.join(wrong, "grp", "left").join(digests(edits), "grp", "left")
    return found.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
