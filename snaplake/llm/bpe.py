"""Byte-level BPE by dynamic programming over byte prefixes.

For every byte prefix of a piece of text exactly one token can be the last of
its encoding.  The table of these last tokens is filled from left to right: a
token may follow the encoding of a shorter prefix if it and the last token of
that prefix do not merge across their seam.  Reading the table backwards from the
end gives the ids.  A table can go on where it stopped, so bytes can be appended
without starting again, and an edit only redoes the table from the first changed
byte up to where it agrees with the old one again.

Odd input: a null text is an empty one and has no ids.  Other columns of the
input are ignored, repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from snaplake.llm.common import per_batch, texts_of

_NEVER = 1 << 40
#: Entries a task remembers, and the longest stretch of text worth remembering.
REMEMBERED, LONGEST, MOST_SEAMS = 300_000, 48, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base-64 token and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks, and for every longer token the two parts that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.head: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        #: The longest token with these last four bytes; other tokens have three bytes at most.
        self.reach: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) > 3:
                self.reach[token[-4:]] = max(self.reach.get(token[-4:], 0), len(token))
            if len(token) > 1:
                parts = self._parts(token, rank)
                if len(parts) == 2:
                    self.head[rank], self.tail[rank] = ranks[parts[0]], ranks[parts[1]]

    def _parts(self, token: bytes, below: int) -> list[bytes]:
        """What plain merging leaves of ``token`` if only ranks under ``below`` may be used."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best >= below:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two again.

        Undo both tokens step by step, the later merge first, and look at what
        stands at the seam meanwhile.  It would have merged if that merge came
        before those that the neighbours went through; of equal ones the
        leftmost comes first.
        """
        until_left = until_right = _NEVER
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < until_left and across <= until_right:
                return False
            if left > right and left in self.tail or right not in self.head:
                if left not in self.tail:
                    return True
                until_left, left = left, self.tail[left]
            else:
                until_right, right = right, self.head[right]


class Prefixes:
    """The table of last tokens of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, seams: dict[int, bool] | None = None):
        self.vocabulary, self.seams = vocabulary, {} if seams is None else seams
        self.data, self.last = b"", [-1]

    def append(self, more: bytes) -> Prefixes:
        """Go on behind the bytes seen so far."""
        begin, self.data = len(self.data), self.data + more
        self._extend(begin + 1, len(self.data))
        return self

    def _extend(self, first: int, stop: int) -> None:
        """Fill the table for the prefixes that end from ``first`` to ``stop``."""
        data, last, seams = self.data, self.last, self.seams
        get, reach, known, add = self.vocabulary.ranks.get, self.vocabulary.reach.get, seams.get, last.append
        for end in range(first, stop + 1):
            start = end - reach(data[end - 4 : end], 3) if end > 3 else 0
            if start < 0:
                start = 0
            while True:
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    key = last[start] << 20 | token
                    holds = known(key)
                    if holds is None:
                        if len(seams) > MOST_SEAMS:
                            seams.clear()
                        holds = seams[key] = self.vocabulary.seam_holds(last[start], token)
                    if holds:
                        break
                start += 1
            add(token)

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Put ``new`` in place of the bytes from ``start`` to ``end``.

        The table before ``start`` stays.  Behind the edit an entry depends on
        earlier ones no further away than the longest token, so once as many in
        a row agree with the old table, so does the rest.
        """
        old, tail, shift = self.last, self.data[end:], start + len(new) - end
        self.data, self.last = self.data[:start] + new + tail, old[: start + 1]
        agree, enough = 0, max(3, *self.vocabulary.reach.values())
        for at in range(start + 1, len(self.data) + 1):
            self._extend(at, at)
            clear = at > start + len(new)
            agree = agree + 1 if clear and self.last[at] == old[at - shift] else 0
            if agree >= enough:
                self.last += old[at - shift + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return found[::-1]


class Memory(dict):
    """Remembers up to ``REMEMBERED`` short texts; starts anew if most of what comes is not among them."""

    def __init__(self):
        self.refused = 0

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST:
            if len(self) < REMEMBERED:
                self[key] = value
            elif self.refused < 4 * REMEMBERED:
                self.refused += 1
            else:
                self.clear()
                self.refused = 0


class Codec:
    """Encodes and decodes texts with one vocabulary and one splitting pattern.

    Pieces are what the pattern matches.  A stretch between two spaces that
    neither starts nor ends with white space is split alike wherever it stands,
    so such stretches are looked up whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.seams: dict[int, bool] = {}
        self.known, self.pieces = Memory(), Memory()

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, self.seams).append(raw).ids()
        packed = pack(f"<{len(ids)}I", *ids)
        self.pieces.put(piece, packed)
        return packed

    def _encode(self, text: str) -> bytes:
        get = self.pieces.get
        return b"".join([get(piece) or self._piece(piece) for piece in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        first, *rest = text.split(" ")
        if not rest:
            return self._encode(text)
        known = self.known
        out = list(map(known.get, rest))
        if None in out:
            if first[-1:].isspace() or any(not s or s[0].isspace() or s[-1].isspace() for s, i in zip(rest, out) if i is None):
                return self._encode(text)
            for at, ids in enumerate(out):
                if ids is None:
                    stretch = rest[at]
                    out[at] = known.get(stretch)
                    if out[at] is None:
                        out[at] = self._encode(" " + stretch)
                        known.put(stretch, out[at])
        elif first[-1:].isspace():
            return self._encode(text)
        return self._encode(first) + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind packed ids."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``token_ids``: ids of every text, packed as little-endian 32-bit numbers.

    The vocabulary is read once on the driver and broadcast; its size is that of
    the rank file, whatever the number of documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))

    def build():
        codec = Codec(shared.value, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([codec.encode(t) for t in texts_of(batch)], pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], [*keep, "token_ids"])

        return step

    return per_batch(docs.select(*keep, "text"), build, StructType([*docs.select(*keep).schema, StructField("token_ids", BinaryType())]))


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that packed ids stand for; null ids stand for none."""
    shared = tokens.sparkSession.sparkContext.broadcast({r: t for t, r in read_ranks(ranks_path).items()})

    def build():
        look = shared.value.__getitem__

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [b"".join(map(look, memoryview(i or b"").cast("I"))) for i in batch.column("token_ids").to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

        return step

    return per_batch(tokens, build, StructType([*tokens.schema, StructField("decoded", BinaryType())]))


def digests(tokens: DataFrame, *keep: str) -> DataFrame:
    """Number of ids and lower-case hexadecimal digests of the ids and the decoded bytes."""
    return tokens.select(
        *keep, (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
