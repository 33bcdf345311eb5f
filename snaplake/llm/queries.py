"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm import (
    adaptive_scan, bpe, conversations, cross_entropy, fixity, html_blocks, language, line_dedup, line_quality, manifest, simhash, tiling, toxicity,
)
from snaplake.llm import oracle
from snaplake.llm.common import bucket_of, table

BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What cannot be written in SQL is compared with brute force in the tests.
SQL: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(build):
    BUILDS[build.__name__] = build
    if hasattr(oracle, build.__name__):
        SQL[build.__name__] = getattr(oracle, build.__name__)
    return build


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return bpe.digests(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS), "doc_id")


@query
def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_blocks.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files of 500 records, against a replica in which some records are damaged and some are lost."""
    record = fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    # Pages without an id have a file of their own.
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.floor(F.col("page_id") / 500).cast("string"), F.lit("unnumbered")).alias("file"),
        record.alias("record"),
    )
    spoiled = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.encode(F.lit("\u0001"), "UTF-8"), F.expr("substring(record, length(record) - 3, 4)"))
    ours = fixity.laid_out(fixity.described(pages.withColumn("spoiled", F.sha2(spoiled, 256))), "file", "page_id")
    theirs = ours.where("page_id IS NULL OR page_id % 211 <> 7").withColumn("hash", F.when(F.col("page_id") % 97 == 13, F.col("spoiled")).otherwise(F.col("hash")))
    return fixity.audit(ours, theirs).join(ours.select("file", "offset", "page_id"), ["file", "offset"], "left").select("page_id", "file", "offset", "kind")


@query
def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those of the held-out fold were not learned from."""
    docs = table(spark, sf_dir, "documents")
    found = language.detect(docs, language.fit(docs, held_out=2, folds=4))
    return found.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages")


@query
def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    found = line_quality.score(docs, line_quality.fit(docs, table(spark, sf_dir, "labels"), held_out=1, folds=3))
    return found.select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines",
    )


@query
def op8_toxic_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=2, folds=4))
    return found.select(
        "doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst",
    )


@query
def op9_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more every document is like those labelled good than like the whole corpus."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


@query
def op11_doubled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: what is wrong with it and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with two others or more."""
    left = line_dedup.without_shared_lines(table(spark, sf_dir, "documents"), least=20, copies=3)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its way up to the root, and whether what is there now leads to that root."""
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = manifest.leaves_of(docs, "lang", ("doc_id", "source", "lang", "n_chars", "text"), {"n_chars": more}, tampered)
    proofs, root = manifest.witnessed(leaves)
    found = manifest.audited(proofs, root)
    return found.select(
        "doc_id", F.lower(F.hex("hash")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"),
        F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified",
    )
