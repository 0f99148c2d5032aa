"""Keywords of articles and the messages and lines that support them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions.text import contains_any, strip
from postmill.operators.ranking import top_per_group
from postmill.session import cut_lineage

GRAM = 4


def top_keywords(
    articles: DataFrame, n: int = 8, text: Column | None = None, key: str = "id",
    pattern: str = rules.KEYWORD_PATTERN, stop: list[str] = rules.KEYWORD_STOP,
) -> DataFrame:
    """(key, rank, keyword, freq): frequent words first, then longer, then earlier ones.

    Texts move to their key once, as their words would weigh more; counts and ranks need no further shuffle.
    """
    source = text if text is not None else F.concat_ws(" ", "headline", "body")
    texts = articles.select(key, source.alias("__text")).repartition(key)
    # Outer, as Spark would else cut every text once more for a filter on empty lists.
    words = texts.select(key, F.posexplode_outer(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).alias("pos", "keyword"))
    words = words.where((F.length("keyword") >= 2) & ~F.lower("keyword").isin(stop))
    counted = words.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first"))
    order = [F.desc("freq"), F.desc(F.length("keyword")), F.asc("first")]
    return top_per_group(counted, [key], order, n, rank="rank").select(key, "rank", "keyword", "freq")


def _first_chars(rows: DataFrame, keys: list[str], order: list[str], max_chars: int) -> DataFrame:
    """Per key the rows whose text begins within its first ``max_chars``, in order.

    A text has a character and a line end, so no more rows than half of the characters can be among them: Spark keeps no
    more of a key in any task before the shuffle, and a key of a third of all messages reaches its task as short lists.
    """
    along = W.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(along)).where(F.col("__rank") <= max_chars // 2 + 2)
    before = F.coalesce(F.sum("n_chars").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One character more tells an exact fit from a truncated text.
    return ranked.withColumn("__before", before).where(F.col("__before") <= max_chars + 1).drop("__before", "__rank")


def keyword_snippets(
    keywords: DataFrame, messages: DataFrame, max_chars: int = 6_000, key: str = "id",
    order: tuple[str, ...] = ("channel", "ordinal"), text: str = "block",
) -> DataFrame:
    """(key, snippets, snippets_len): the messages holding any keyword, joined and truncated.

    Every keyword is looked for by one gram: of the pieces of ``GRAM`` characters of its longest part without blanks
    (the part itself, if shorter) the one in the fewest distinct words, so that common pieces meet no keyword
    that has a rarer one. A word is down to its first ``max_chars`` of messages before it meets its keywords, a keyword
    before it meets its articles: what is later is beyond the limit for every article. Keywords of blanks alone find nothing.
    """
    order = list(order)
    keywords = cut_lineage(keywords.select(key, "keyword"))  # read three times below
    wanted = keywords.select(key, F.lower("keyword").alias("k")).distinct()
    parts = F.filter(F.split("k", r"\s+"), lambda p: p != "")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    terms = wanted.select("k").distinct().select("k", longest.alias("part")).where("part IS NOT NULL")
    body = messages.select(*order, F.col(text).alias("t"))
    # Outer, as Spark would else cut every message once more for a filter on empty lists. Empty pieces are no words.
    words = body.select(
        *order, (F.length("t") + 1).alias("n_chars"), F.explode_outer(F.array_distinct(F.split(F.lower("t"), r"\s+"))).alias("word")
    ).where("word <> ''")
    early = cut_lineage(_first_chars(words, ["word"], order, max_chars))
    vocabulary = early.select("word").distinct()
    grams = vocabulary.select("word", F.explode_outer(F.array_distinct(_pieces("word"))).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # Short parts have no gram of full length: words are joined to them by all pieces of just that length.
    short = terms.where(F.length("part") < GRAM)
    probes = terms.where(F.length("part") >= GRAM).select("k", "part", F.explode_outer(F.array_distinct(_pieces("part"))).alias("gram"))
    probes = probes.join(frequency, "gram").groupBy("k", "part").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count(F.lit(1)).alias("n"))
    # A part with a gram that no word has is in no word.
    probes = probes.where(F.col("n") == F.size(F.array_distinct(_pieces("part")))).select("k", "part", "gram")
    shorter = vocabulary.select("word", F.explode_outer(F.array_distinct(F.flatten(F.array(*[_pieces("word", size) for size in range(1, GRAM)])))).alias("gram"))
    met = grams.join(probes, "gram").unionByName(shorter.join(short.select("k", "part", F.col("part").alias("gram")), "gram"))
    hits = cut_lineage(met.where(F.contains("word", "part")).select("word", "k", (F.col("k") == F.col("part")).alias("single")))
    single, phrases = hits.where("single").drop("single"), hits.where("NOT single").drop("single")
    per_term = early.join(single, "word").select("k", *order, "n_chars").distinct()
    candidates = words.join(phrases, "word").select("k", *order, "n_chars").distinct().join(body, order)
    per_term = per_term.unionByName(candidates.where(F.contains(F.lower("t"), "k")).drop("t"))
    per_term = _first_chars(per_term, ["k"], order, max_chars)
    # Dealt by key alone, they are told apart and ranked where they lie.
    per_key = per_term.join(wanted, "k").select(key, *order, "n_chars").repartition(key).distinct()
    chosen = _first_chars(per_key, [key], order, max_chars).join(body, order)
    joined = chosen.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "t"))), lambda x: x["t"]), "\n").alias("all")
    )
    cut = F.when(
        F.length("all") > max_chars, F.concat(F.substring("all", 1, max_chars), F.lit(rules.TRUNCATION_MARK))
    ).otherwise(F.col("all"))
    found = joined.select(key, cut.alias("snippets"))
    every = keywords.select(key).distinct().join(found, key, "left")
    return every.select(
        key, F.coalesce("snippets", F.lit("")).alias("snippets"), F.length(F.coalesce("snippets", F.lit(""))).alias("snippets_len")
    )


def _pieces(column: str, size: int | None = None) -> Column:
    """All pieces of ``size`` characters of a word."""
    n = GRAM if size is None else size
    starts = F.when(F.length(column) >= n, F.sequence(F.lit(1), F.length(column) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(F.col(column), i, F.lit(n)))


Topics = list[tuple[str, list[str]]]


def _per_topic(value: dict[str, Column]) -> Column:
    """One struct per topic; the topic list is a literal of the plan."""
    return F.array(*[F.struct(F.lit(topic).alias("topic"), v.alias("value")) for topic, v in value.items()])


def topic_match(chunks: DataFrame, topics: Topics, text: str = "summary") -> DataFrame:
    """(chunk_index, topic, score): number of topic keywords in each summary, where any is."""
    low = F.lower(F.col(text))
    scores = {
        topic: reduce(lambda a, b: a + b, [F.contains(low, F.lit(k.lower())).cast("int") for k in words])
        for topic, words in topics
    }
    rows = chunks.select("chunk_index", F.inline(_per_topic(scores)))
    return rows.where("value >= 1").withColumnRenamed("value", "score")


def topic_evidence(chunks: DataFrame, topics: Topics, cap: int = 15, text: str = "summary") -> DataFrame:
    """(topic, rank, evidence): first keyword lines per topic in chunk order, cut at 200 characters."""
    lines = chunks.select("chunk_index", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    clean = strip(F.regexp_replace("line", r"^\s*[*\-]\s*", ""))
    lines = lines.select("chunk_index", "line_no", "line", clean.alias("clean")).where(F.length("clean") > 20)
    low = strip(F.lower("line"))
    hits = {topic: contains_any(low, [k.lower() for k in words]) for topic, words in topics}
    rows = lines.select(
        "chunk_index", "line_no", F.substring("clean", 1, 200).alias("evidence"), F.inline(_per_topic(hits))
    ).where("value")
    picked = top_per_group(rows, ["topic"], [F.asc("chunk_index"), F.asc("line_no")], cap, rank="rank")
    return picked.select("topic", "rank", "chunk_index", "evidence")
