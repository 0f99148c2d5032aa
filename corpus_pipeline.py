"""From raw documents to packed training sequences, in four stages of the ``llm`` operators.

``language``: documents that the language classifier rejects go (no letters, or too far from every centroid).
``near_duplicates``: of each group of similar documents the one with the least id stays.
``repeated_passages``: bytes of passages that also occur in an earlier document are cut out.
``packing``: what is left is tokenized and packed into sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import new_folder, table
from postmill.llm.jaccard import similar_components
from postmill.llm.language import fit, identify
from postmill.llm.packing import pack_documents
from postmill.llm.queries import held_out
from postmill.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# No SQL states nearest centroids, suffix sorting or packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; a missing language becomes the predicted one."""
    model = fit(docs.where(~held_out()), order=F.col("doc_id"))
    known = identify(docs, model).where(~F.col("rejected"))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, once, whole; rows without id are in none and stay."""
    heads = similar_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = W.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    kept = docs.join(heads, "doc_id", "left_semi").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return kept.select(COLUMNS).unionAll(docs.where("doc_id IS NULL").select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; every document stays, be it empty."""
    kept = remove_repeats(docs, as_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("bigint")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
