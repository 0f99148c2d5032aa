"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import oracle
from postmill.llm.bitplanes import bitplane_clusters
from postmill.llm.bond import hard_negatives
from postmill.llm.bpe import encode_documents
from postmill.llm.common import table
from postmill.llm.html import extract
from postmill.llm.jaccard import similar_components
from postmill.llm.language import fit, identify
from postmill.llm.licenses import scan_licenses
from postmill.llm.neighbours import nearest
from postmill.llm.packing import pack_documents
from postmill.llm.sharding import shard_by_ring
from postmill.llm.suffixes import remove_repeats
from postmill.llm.syncmers import fingerprints
from postmill.llm.warc import archive_and_index

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_warc_index", oracle.WARC_INDEX)
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are a second apart, by page: the table has no times."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31_622_400)))
    return archive_and_index(table(spark, sf_dir, "pages"), captured_at=at).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_closed_syncmers")
def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op3_host_paths")
def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op4_pattern_packing")
def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query("op5_ring_sharding")
def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 under the law of rows: bounded loads without slack."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return shard_by_ring(docs, F.col("doc_id"), 24, tie=F.col("text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_adaptive_jaccard", oracle.JACCARD)
def op6_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup", oracle.SUFFIX_DEDUP)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def held_out():
    """Rows that no model may learn from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


@query("op8_language_centroids")
def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), order=F.col("doc_id"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_cross_polytope")
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op10_bpe_segment_tree")
def op10_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op11_bond_negatives", oracle.bond_negatives())
def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one, so that some neighbours of each anchor are wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op12_diagonal_licenses", oracle.diagonal_licenses())
def op12_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op13_bitplane_clusters", oracle.bitplane_clusters())
def op13_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane_clusters(table(spark, sf_dir, "embeddings"))
