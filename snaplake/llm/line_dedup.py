r"""Lines that many documents share, dropped from all but one of them.

Texts are cut at ``\n``.  A line's key is the line without white space at its ends
(space, tab, ``\n``, ``\v``, ``\f``, ``\r``) and with A-Z in lower case.  Lines are
exploded to (document, position, 128-bit hash of the key); from then on no text
moves until the documents take up their dropped positions.  A key of at least
``least`` code points that at least ``copies`` documents hold loses all its
lines, repeats included, except in the largest ``doc_id`` that holds it, where
all of them stay.

Rows per key are counted map-side first.  Only keys with enough rows are joined
back, a frequent one spread by that count; the different documents
of those keys are counted exactly.  What a document loses is a list of positions,
never longer than its own text has lines.

Odd input: a null or empty text is one empty line.  Rows of one ``doc_id`` are one
document.  Rows without ``doc_id`` are one document for each different text, smaller
than all others; of these the one with the largest text hash keeps the line.
Repeated rows stay and lose the same lines.  Further columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators.skew import lookup_join
from snaplake.session import materialise

WHITE = " \t\n\x0b\f\r"
KEY = ("a", "b")


def key_of(line: Column) -> Column:
    """The line as it is compared; ``lower`` is the fast way where all characters are ASCII."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, own, lines): every document as its lines; ``own`` tells texts of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), F.split(text, "\n", -1).alias("lines"))


def hashed_lines(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, own, at, a, b): place and key of every line that may be dropped."""
    placed = texts.select("doc_id", "own", F.posexplode("lines").alias("at", "line")).select("doc_id", "own", "at", key_of(F.col("line")).alias("key"))
    return placed.where(F.char_length("key") >= least).select(
        "doc_id", "own", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")
    )


def dropped_lines(texts: DataFrame, least: int, copies: int) -> DataFrame:
    """(doc_id, own, gone): the positions that each document loses, for documents that lose any."""
    keys = list(KEY)
    lines = materialise(hashed_lines(texts, least))
    often = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= copies)
    often = materialise(often)
    held = materialise(
        lookup_join(lines, often.select(*keys), keys, "inner", counts=often)
        .withColumn("document", F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("own")).alias("own")))
    )
    documents = held.select(*keys, "document").distinct()
    shared = documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.max("document").alias("keeps")).where(F.col("documents") >= copies)
    lost = lookup_join(held, shared.select(*keys, "keeps"), keys, "inner", counts=often).where(~F.col("document").eqNullSafe(F.col("keeps")))
    return lost.groupBy("doc_id", "own").agg(F.collect_set("at").alias("gone"))


def without_shared_lines(docs: DataFrame, least: int = 20, copies: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document with what is left of its text."""
    texts = lines_of(docs)
    gone = dropped_lines(texts, least, copies).select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "gone")
    found = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    size = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), size - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return found.select(
        "doc_id", F.array_join(left, "\n").alias("text"), size.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
