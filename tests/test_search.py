"""The stored index: pruned search equals the full computation, through merges, replacements and compaction."""

import math
import random
import re
from collections import Counter

import pytest

from postmill.functions.text import query_words
from postmill.operators import search
from postmill.sources import term_store
from postmill.sources.term_store import compact_index, merge_into_index, open_index


def plain_bm25(posts, query, n):
    """Scores over a dict of key to text."""
    bags = {k: query_words(t or "") for k, t in posts.items()}
    terms = sorted(set(query_words(query)))
    total = sum(map(len, bags.values()))
    hits = []
    for k, words in bags.items():
        if terms and all(t in words for t in terms):
            score = 0.0
            for t in terms:
                df = sum(t in w for w in bags.values())
                tf = words.count(t)
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / (total / len(bags))))
            hits.append((k, round(score, 6)))
    return sorted(hits, key=lambda h: (-h[1], h[0]))[:n]


def frame(spark, posts):
    return spark.createDataFrame(list(posts.items()), "post_id bigint, content string")


def found(spark, path, query, n=10):
    return [(r.post_id, r.score) for r in search.bm25_search(open_index(spark, path), query, n).collect()]


def test_words_and_marks(spark, tmp_path):
    posts = {1: "gpt-5 at the café_bar", 2: "gpt 4", 3: "", 4: None}
    listed = search.build_term_index(frame(spark, posts)).where("post_id = 1").collect()
    assert {(r.term, r.tf, r.doc_len) for r in listed} == {(t, 1, 6) for t in ("gpt", "5", "at", "the", "cafe", "bar")}
    merge_into_index(frame(spark, posts), str(tmp_path))
    assert [k for k, _ in found(spark, str(tmp_path), "GPT-5")] == [1] == [k for k, _ in found(spark, str(tmp_path), "cafe")]
    assert found(spark, str(tmp_path), "nothing") == found(spark, str(tmp_path), " - ") == found(spark, str(tmp_path), "gpt bar 4") == []


def test_no_index_and_empty_batches(spark, tmp_path):
    assert open_index(spark, str(tmp_path / "none")) is None
    merge_into_index(frame(spark, {1: "a"}).limit(0), str(tmp_path))
    assert found(spark, str(tmp_path), "a") == []
    merge_into_index(frame(spark, {1: "a b", 2: None}), str(tmp_path))
    assert found(spark, str(tmp_path), "a") == plain_bm25({1: "a b", 2: None}, "a", 10)


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    return {k: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.choice([3, 8, 40, 200]))) for k in range(900)}


def test_pruned_search_is_exact_and_skips_chunks(spark, tmp_path, many, monkeypatch):
    monkeypatch.setattr(term_store, "CHUNK_POSTS", 16)
    monkeypatch.setattr(search, "FIRST_CHUNKS", 4)
    merge_into_index(frame(spark, many), str(tmp_path))
    index = open_index(spark, str(tmp_path))
    chunks = index.blocks.select("chunk").distinct().count()
    skipped = 0
    for query in ("w0", "w1 w2", "w0 w5 w9", "w30 w3", "w59", "w40 w41 w42"):
        assert found(spark, str(tmp_path), query, 5) == plain_bm25(many, query, 5)
        plan = search.plan_search(index, query, 5)
        if plan is not None and plan.threshold is not None:
            skipped += chunks - len(plan.read_first) - plan.survivors.count()
    assert chunks > 50 and skipped > chunks


def test_search_opens_the_buckets_of_its_terms(spark, tmp_path):
    merge_into_index(frame(spark, {1: "cat sat", 2: "cat cat dog", 3: "dog"}), str(tmp_path))
    hits = search.bm25_search(open_index(spark, str(tmp_path)), "CAT", 5)
    assert [r.post_id for r in hits.collect()] == [2, 1]
    files = re.findall(r"PartitionFilters: \[([^\]]*)", hits._jdf.queryExecution().executedPlan().toString())
    assert any("bucket" in f for f in files)


def test_merges_replace_and_delete(spark, tmp_path, many):
    path = str(tmp_path)
    held = dict(list(many.items())[:300])
    merge_into_index(frame(spark, held), path)
    queries = ("w0 w1", "w7")
    for step in range(2):
        batch = {k: many[(k * 7 + step) % 900] for k in range(step * 40, step * 40 + 60)} | {1000 + step: "w0 w1 w7 fresh"}
        gone = [200 + step, 201 + step, 5000]
        merge_into_index(frame(spark, batch), path, deleted=spark.createDataFrame([(g,) for g in gone], "post_id bigint"))
        held = {k: t for k, t in held.items() if k not in gone} | batch
        for query in queries:
            assert found(spark, path, query) == plain_bm25(held, query, 10)
    index = open_index(spark, path)
    assert index.n_docs == len(held) and index.n_words == sum(len(t.split()) for t in held.values())
    compact_index(spark, path)
    index = open_index(spark, path)
    assert index.segments == [4] and index.replaced is None and index.n_docs == len(held)
    assert all(found(spark, path, query) == plain_bm25(held, query, 10) for query in queries)


def test_merge_that_dies_has_not_happened(spark, tmp_path, many, monkeypatch):
    path = str(tmp_path)
    held = dict(list(many.items())[:50])
    merge_into_index(frame(spark, held), path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(term_store, "_write_live", dies)
        with pytest.raises(RuntimeError):
            merge_into_index(frame(spark, {1: "w0 other", 9000: "w0 w1"}), path)
    assert found(spark, path, "w0 w1") == plain_bm25(held, "w0 w1", 10)
    merge_into_index(frame(spark, {1: "w0 other", 9000: "w0 w1"}), path)
    assert found(spark, path, "w0 w1") == plain_bm25(held | {1: "w0 other", 9000: "w0 w1"}, "w0 w1", 10)


def test_index_moves_posts_not_their_words(spark, tmp_path, monkeypatch):
    # Posts of many words share fewer chunks, and no shuffle of a merge is dealt by term.
    plans = []
    frame = type(spark.range(0))
    with_column = frame.withColumn

    def seen(self, name, column):
        if name == "bucket" and "postings" in self.columns:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return with_column(self, name, column)

    monkeypatch.setattr(frame, "withColumn", seen)
    monkeypatch.setattr(term_store, "CHUNK_WORDS", 50, raising=False)
    posts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(20))) for i in range(40)] + [(40, ""), (41, None)], "post_id bigint, content string")
    term_store.merge_into_index(posts, str(tmp_path / "index"))
    moved = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("term#" in line for line in moved)
    index = term_store.open_index(spark, str(tmp_path / "index"))
    assert (index.n_docs, index.n_words) == (42, 800) and index.blocks.select("chunk").distinct().count() > 5
    want = Counter((f"w{(i * j) % 17}", i) for i in range(40) for j in range(20))
    assert {((r.term, r.post_id), r.tf) for r in search.stored_postings(index).collect()} == set(want.items())
