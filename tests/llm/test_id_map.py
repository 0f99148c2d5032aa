"""The map of ids that keeps texts of op6 from the shuffle."""

from postmill.llm import jaccard


def test_the_map_of_ids_needs_no_python_workers(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 32_768, 32_769, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "t") for i in [*ids, *range(100, 3000)]], "doc bigint, text string")
    found = jaccard.Join(docs.repartition(3), 5, 75).among(spark.createDataFrame([(i,) for i in ids], "node bigint"))
    got = {r.doc for r in found.collect()}
    assert set(ids) <= got and len(got) < len(ids) + 5
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
