"""The registered queries and the pipeline on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmill.llm.queries import ORACLE, QUERIES
from postmill.plans import check


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    sf = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, sf).toPandas()
    if name.startswith("op9_"):
        queries = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").count()
        assert len(out) == 5 * queries
        return
    if name.startswith("op11_"):
        assert set(out["anchor_id"] % 50) == {0} and out.groupby(["anchor_id", "positive_id"]).size().max() <= 3
        return
    table, key = {"op1": ("pages", "page_id"), "op3": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    rows = spark.read.parquet(f"{sf}/{table}.parquet").select(key).toPandas()[key]
    got = out[out["piece"] == 0][key] if "piece" in out else out[key]
    assert sorted(got) == sorted(rows)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLE) if not n.startswith(("op6_", "op7_"))])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    verdict = check.compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert verdict.startswith("ok"), verdict


def test_language_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op8_language_centroids"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg(F.when(F.col("lang") == F.col("lang_pred"), 1.0).otherwise(0.0)).alias("a")).first()
    assert held.a > 0.98


def test_pipeline_stages(spark):
    rows = [(i, "the heron and the other of " * 3 + f"word{i} " * 20, "en", "s", 0) for i in range(30)]
    rows += [(100, "12 34", "en", "s", 5), (101, None, None, "s", None), (102, rows[3][1], None, "t", 1), (103, "passage " * 30 + "tail one", "en", "s", 1), (103, "passage " * 30 + "tail one", "en", "s", 1), (None, "no id at all", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), docs.schema)
        assert kept.columns == docs.columns
        counts.append(kept.count())
    ids = {r.doc_id for r in kept.collect()}
    assert 100 not in ids and 101 not in ids and 102 not in ids and None in ids
    assert counts[0] == len(rows) - 2 and counts[1] == counts[0] - 2 and counts[2] == counts[1]
    packed = corpus_pipeline.packing(spark, kept, "").collect()
    assert {r.doc_id for r in packed} == ids


def test_pipeline_on_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema) if stage is not corpus_pipeline.packing else stage(spark, docs, "")
    assert docs.count() == 0
