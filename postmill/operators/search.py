"""Term postings and ranked text search over the stored index."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import query_words, search_words
from postmill.sources.term_store import TermIndex, alive, bucket_of

K1, B = 1.2, 0.75
FIRST_CHUNKS = 16
ROUNDING = 1e-6


def build_term_index(posts: DataFrame, key: str = "post_id", text: str = "content") -> DataFrame:
    """Postings (term, key, doc_len, tf) of the words of every post."""
    words = posts.select(key, search_words(text).alias("words"))
    # An outer explode, as Spark would else cut all texts once more for a filter on empty ones.
    each = words.select(key, F.size("words").alias("doc_len"), F.explode_outer("words").alias("term")).where("term IS NOT NULL")
    return each.groupBy("term", key, "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def stored_postings(index: TermIndex, key: str = "post_id") -> DataFrame:
    """Postings (term, key, doc_len, tf) of the live posts of a stored index."""
    each = index.blocks.select("segment", "term", F.inline("postings"))
    if index.replaced is not None:
        each = alive(each, index.replaced, "id")
    return each.select("term", F.col("id").alias(key), (-F.col("less")).alias("doc_len"), F.col("tf").cast("bigint").alias("tf"))


def _saturated(tf: Column, length: Column, average: float) -> Column:
    """What a term adds to the score of a post, apart from its rarity; grows with ``tf``, falls with ``length``."""
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


@dataclass(frozen=True)
class Search:
    """A search in two steps: chunks read at once, the score that a further chunk must reach, and the chunks that can."""

    index: TermIndex
    key: str
    n: int
    rarity: dict[str, float]
    average: float
    read_first: list[int]
    threshold: float | None
    survivors: DataFrame

    def postings(self) -> DataFrame:
        return read_terms(self.index.blocks, list(self.rarity))

    def _idf(self) -> Column:
        pairs = [F.when(F.col("term") == t, F.lit(v)) for t, v in self.rarity.items()]
        return F.coalesce(*pairs)

    def scored(self, blocks: DataFrame) -> DataFrame:
        """Exact scores of the posts that hold every term, from whole blocks."""
        each = blocks.select("segment", "term", F.inline("postings"))
        if self.index.replaced is not None:
            each = alive(each, self.index.replaced, "id")
        part = self._idf() * _saturated(F.col("tf"), -F.col("less"), self.average)
        found = each.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))
        return found.where(F.col("n_terms") == len(self.rarity)).select(F.col("id").alias(self.key), F.round("score", 6).alias("score"))

    def best(self, hits: DataFrame) -> DataFrame:
        return hits.orderBy(F.desc("score"), F.asc(self.key)).limit(self.n)

    def first_hits(self) -> DataFrame:
        return self.best(self.scored(self.postings().where(F.col("chunk").isin(self.read_first))))

    def hits(self) -> DataFrame:
        rest = self.postings().join(self.survivors.select("chunk"), "chunk", "left_semi")
        return self.best(self.first_hits().unionByName(self.scored(rest)))


def read_terms(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks of the terms; the bucket of a literal folds to a constant, which prunes the folders."""
    buckets = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(t)) for t in terms], F.lit(False))
    return blocks.where(F.col("term").isin(terms)).where(buckets)


def plan_search(index: TermIndex, query: str, n: int = 10, key: str = "post_id") -> Search | None:
    """Judge chunks by the bounds of their blocks, read the most promising, and keep of the others those that can still win.

    Only block heads are read for this, and the postings of ``FIRST_CHUNKS`` chunks. None where no post holds all terms.
    """
    terms = sorted(set(query_words(query)))
    if not terms or not index.n_docs or not index.n_words:
        return None
    heads = read_terms(index.blocks, terms).select("term", "chunk", "n", "max_tf", "min_len")
    frequency = heads.groupBy("term").agg(F.sum("n").alias("n"))
    if index.gone is not None:
        frequency = frequency.unionByName(read_terms(index.gone, terms).select("term", (-F.col("n")).alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in frequency.collect()}  # one row per term of the query
    if any(df.get(t, 0) <= 0 for t in terms):
        return None
    average = index.n_words / index.n_docs
    rarity = {t: math.log(1 + (index.n_docs - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
    plain = Search(index, key, n, rarity, average, [], None, heads.limit(0))
    bound = plain._idf() * _saturated(F.col("max_tf"), F.col("min_len"), average)
    bounds = heads.groupBy("chunk").agg(F.sum(bound).alias("bound"), F.count(F.lit(1)).alias("n_terms")).where(F.col("n_terms") == len(terms))
    first = [r["chunk"] for r in bounds.orderBy(F.desc("bound"), "chunk").limit(FIRST_CHUNKS).collect()]
    tried = Search(index, key, n, rarity, average, first, None, bounds)
    scores = [r["score"] for r in tried.first_hits().collect()]  # n rows
    threshold = min(scores) if len(scores) == n else None
    rest = bounds.where(~F.col("chunk").isin(first))
    if threshold is not None:
        rest = rest.where(F.col("bound") >= threshold - ROUNDING)
    return Search(index, key, n, rarity, average, first, threshold, rest)


def bm25_search(index: TermIndex, query: str, n: int = 10, key: str = "post_id") -> DataFrame:
    """(key, score) of the best posts holding every query term, exactly, from the chunks that can hold one of them."""
    search = plan_search(index, query, n, key)
    if search is None:
        kind = index.posts.schema[key].dataType.simpleString()
        return index.posts.sparkSession.createDataFrame([], f"{key} {kind}, score double")
    return search.hits()


def search_posts(posts: DataFrame, index: TermIndex, query: str, n: int = 10, key: str = "post_id") -> DataFrame:
    """Search hits with post columns and a 150-character preview."""
    hits = bm25_search(index, query, n, key)
    # At most n hits.
    return posts.join(F.broadcast(hits), key).select(
        key, "source", "author", "timestamp", F.substring("content", 1, 150).alias("preview"), "source_url", "score"
    ).orderBy(F.desc("score"), F.asc(key))
