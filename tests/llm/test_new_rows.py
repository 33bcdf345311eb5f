"""Conversation repair, line dedup and the dataset manifest against plain versions, and on odd rows."""

import heapq
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplake.llm import conversations, line_dedup, manifest

WHITE = " \t\n\x0b\f\r"


def digest(text):
    return sha256(text.encode()).hexdigest()


# ------------------------------------------------------------ conversations
def repair_by_force(rows):
    """(cost, audit, repaired) of the cheapest, then least edits, by a search over whole audits.

    States are (rows read, output so far as initials class); Dijkstra over (cost, audit) with no dominance but equal states.
    """
    info, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(WHITE)
        blank = not bare
        twice = not blank and (role, text) in seen
        seen.add((role, text))
        info.append((role, text, blank or twice, not blank and not twice and bare[-1] not in ".!?"))
    best, heap = None, [(0, "", 0, "", ())]
    done = defaultdict(set)
    while heap:
        cost, audit, i, out, made = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if audit in done[i, out]:
            continue
        done[i, out].add(audit)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(made))
        if not re.fullmatch("s?(ua)*u?", out):
            continue
        for r in ("user", "assistant"):
            if audit[-2:] != "II":
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + r[0], (*made, f"{r}:")))
        if i < len(rows):
            role, text, doomed, cut = info[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, made))
            if not doomed:
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, out + role[:1] if role else out + "?", (*made, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, out + r[0], (*made, f"{r}:{text}")))
    return best


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["a.", "b", "", " \n", "c!", "d ?", "e\t", "long tail"]
    roles = ["user", "assistant", "system", "tool", "sam", ""]
    return {
        c: [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}.") for k in range(rng.randint(1, longest))]
        for c in range(n)
    }


@pytest.mark.parametrize("chunk", [2048, 2])
def test_repairs_by_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    given = random_conversations(5, 60, 6)
    rows = spark.createDataFrame([(c, k, r, t) for c, own in given.items() for k, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.report(rows, rows).collect()}
    for c, own in given.items():
        cost, audit, repaired = repair_by_force(own)
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, digest(repaired)), (c, own)


def test_one_long_conversation_in_chunks_equals_one_chunk(spark, monkeypatch):
    own = random_conversations(9, 1, 400)[0] * 2
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string")
    whole = conversations.report(rows, rows).collect()
    monkeypatch.setattr(conversations, "CHUNK", 7)
    assert conversations.report(rows, rows).collect() == whole


def test_ranks_order_audits():
    """Ranks of all nodes order the least audits behind them."""
    rng = random.Random(2)
    nodes = conversations.Nodes()
    rows = [conversations.arcs_of(rng.choice("sua?"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(9)]
    nodes.add(rows, list(conversations.AT_END), True)
    nodes.rank()

    def audits(v):
        arcs = [(conversations.LETTERS[k], to) for k, to in enumerate(nodes.arcs[v]) if to >= 0]
        return [letter + rest for letter, to in arcs for rest in audits(to)] if arcs else [""]

    for v, (path, letters, _) in enumerate(nodes.paths(np.arange(len(nodes.arcs)))):
        assert "".join(conversations.LETTERS[k] for k in letters) == min(audits(v))


def test_conversations_with_odd_rows(spark):
    data = [
        (None, None, None, None, 1), (None, 3, "user", "x.", 1), (1, None, "user", "a.", 1), (1, None, "user", "a.", 1), (1, 5, "", "b", 1),
        (2, 2, "assistant", "z" * 300_000 + ".", 1), (3, 1, "user", "q.", 1), (3, 1, "assistant", "q.", 1),
    ]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chunk int")
    got = {r["conv_id"]: r for r in conversations.report(rows, rows).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[None]["blank"] == 1 and got[None]["gaps"] == 0 and got[None]["audit"] == "DKI"
    assert got[1]["duplicate"] == 1 and got[1]["gaps"] == 0 and got[1]["truncated"] == 1
    assert got[2]["audit"] == "IK" and got[2]["cost"] == 2
    assert got[3]["illegal"] == 0 and got[3]["cost"] == 4 and got[3]["audit"] == "IKKI"
    assert conversations.report(rows.limit(0), rows.limit(0)).count() == 0
    none_left = conversations.report(rows, rows.limit(0)).collect()
    assert len(none_left) == 4 and all(r["cost"] == 0 and r["audit"] == "" and r["repaired_sha256"] == digest("") for r in none_left)


def test_damage_follows_the_checksum(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(3)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    want = []
    for r in rows.collect():
        role, text = (" " if v is None else v for v in (r["role"], r["text"]))
        fault = crc32(":".join(" " if v is None else str(v) for v in (r["conv_id"], r["turn"])).encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            want += [(r["conv_id"], r["turn"], "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert sorted(map(tuple, conversations.damaged(rows).collect()), key=repr) == sorted(want, key=repr)


# ------------------------------------------------------------ line dedup
def left_by_force(rows, least, copies):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    document = lambda i, t: (i is not None, i if i is not None else 0, "" if i is not None else t)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(document(i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            k = key(line)
            if len(k) < least or len(holders[k]) < copies or document(i, t) == max(holders[k]):
                stay.append(line)
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def test_lines_by_force(spark):
    rng = random.Random(4)
    pool = ["A line that many texts share", "\ta LINE that many texts share \r", "short", "", "Ünïcode line ÄÖ that is shared", "ünïcode line ÄÖ that is shared", "exactly twenty chars", " nineteen characters"]
    rows = [(rng.choice([None, *range(25)]) if k % 9 == 0 else 100 + k, "\n".join(rng.choice([*pool, f"a line of its own, number {k}"]) for _ in range(rng.randint(0, 7)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "\n".join(["exactly twenty chars"] * 2000)), (503, "\n".join(["exactly twenty chars"] * 2000))]
    rows = [(i, t) for i, t in rows if i is not None]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, gone string")
    for least, copies in ((20, 3), (1, 1), (5, 2)):
        got = line_dedup.without_shared_lines(docs, least, copies)
        assert sorted(map(tuple, got.collect()), key=repr) == left_by_force(rows, least, copies)


def test_lines_without_ids(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(None, line), (None, line), (None, f"{line}\nb"), (7, line)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_dropped"]) for r in line_dedup.without_shared_lines(docs).collect()), key=repr)
    assert got == [(7, 0), (None, 1), (None, 1), (None, 1)]
    assert line_dedup.without_shared_lines(docs.limit(0)).count() == 0


# ------------------------------------------------------------ manifest
def levels_by_force(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def manifest_by_force(rows):
    """{(grp, doc_id, leaf): (subroot, proof, folded root of the other leaf)} and the root; rows hold (grp, doc_id, leaf, other)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    order = sorted(groups)
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = {g: levels_by_force([r[2] for r in groups[g]]) for g in order}
    upper = levels_by_force([trees[g][-1][0] for g in order])
    out = defaultdict(set)
    for number, g in enumerate(order):
        for place, (_, doc_id, leaf, other) in enumerate(groups[g]):
            siblings, now = "", other or leaf
            for levels, at in ((trees[g], place), (upper, number)):
                for level in levels[:-1]:
                    sibling = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings += sibling
                    now = digest(sibling + now if at & 1 else now + sibling)
                    at //= 2
            out[g, doc_id, leaf].add((trees[g][-1][0], siblings, now))
    return out, upper[-1][0]


@pytest.mark.parametrize("levels", [12, 2])
def test_manifest_by_force(spark, levels):
    rng = random.Random(8)
    sizes = {None: 3, "": 1, "de": 17, "en": 64, "é": 33, "zz": 5}
    data = [(None if rng.random() < 0.05 else rng.randrange(40), lang, f"t{k % 30}", k % 4, "e") for lang, n in sizes.items() for k in range(n)]
    data += [(5, "en", "same", 1, "e")] * 4
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string, n_chars long, place string")
    columns = ("doc_id", "lang", "n_chars", "text")
    leaves = manifest.leaves_of(docs, "lang", columns, {"n_chars": F.col("n_chars") + 1}, F.col("doc_id") % 3 == 0)
    proofs, root = manifest.witnessed(leaves, levels)
    got = manifest.audited(proofs, root).collect()
    def leaf(row, more=0):
        doc_id, lang, text, n, _ = row
        values = [None if v is None else str(v) for v in (doc_id, lang, n + more, text)]
        return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))
    force, top = manifest_by_force([
        ("" if r[1] is None else f"={r[1]}", r[0], leaf(r), leaf(r, 1) if r[0] is not None and r[0] % 3 == 0 else None) for r in data
    ])
    assert root == top and len(got) == len(data)
    seen = defaultdict(set)
    for r in got:
        key = (r["grp"], r["doc_id"], bytes(r["hash"]).hex())
        seen[key].add((bytes(r["subroot"]).hex(), r["siblings"], r["folded_root"]))
        assert r["verified"] == (r["other"] is None)
    assert seen == force


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(None, None, None)], "doc_id long, lang string, text string")
    leaves = manifest.leaves_of(docs, "lang", ("doc_id", "lang", "text"))
    (row,) = manifest.audited(*manifest.witnessed(leaves)).collect()
    assert row["verified"] and row["siblings"] == "" and row["folded_root"] == digest("---") == bytes(row["hash"]).hex()
    assert manifest.audited(*manifest.witnessed(leaves.limit(0))).count() == 0


def test_appended_witnesses_grow_into_whole_ones():
    for n in [*range(1, 34), 100]:
        leaves, tree = [sha256(bytes([i])).digest() for i in range(n)], manifest.Appender()
        for i, leaf in enumerate(leaves):
            tree.append(leaf)
            # So far each witness leads to the open subtree that holds its leaf.
            for _, root, first in tree.open:
                assert manifest.folded(leaves[first], manifest.packed(tree.witnesses[first])) == root
        root = tree.close()
        assert root.hex() == levels_by_force([x.hex() for x in leaves])[-1][0]
        assert all(manifest.folded(x, manifest.packed(w)) == root for x, w in zip(leaves, tree.witnesses))
