"""API payloads to posts.

Each function takes (payload STRING, fetched_at TIMESTAMP, ...) and parses payloads in bulk
against an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions.text import blank_to_null, col, strip, strip_html
from postmill.functions.times import parse_feed_iso, parse_rfc822
from postmill.operators.filters import relevance_filter

GAP = "\n\n"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def post(
    source: str, source_id: Column, content: Column, timestamp: Column, metadata: list[Column],
    source_url: Column | None = None, author: Column | None = None,
) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"),
        (none if source_url is None else source_url).alias("source_url"), (none if author is None else author).alias("author"),
        content.alias("content"), timestamp.alias("timestamp"), none.alias("parent_id"),
        F.to_json(F.struct(*metadata), {"ignoreNullFields": "false"}).alias("metadata"), F.col("fetched_at"),
    ]


def _items(raw: DataFrame, schema: str, path: str, *keep: str) -> DataFrame:
    parsed = raw.select("fetched_at", *keep, F.from_json("payload", schema).alias("p"))
    return parsed.select("fetched_at", *keep, F.explode(path).alias("i")).select("fetched_at", *keep, "i.*")


def normalize_hackernews(raw: DataFrame) -> DataFrame:
    hit = ("objectID STRING, title STRING, story_text STRING, url STRING, author STRING, created_at_i BIGINT, "
           "points BIGINT, num_comments BIGINT")
    hits = relevance_filter(
        _items(raw, f"hits ARRAY<STRUCT<{hit}>>", "p.hits"), ["title", "story_text"], rules.HACKERNEWS_KEYWORDS
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return hits.select(*post(
        "hackernews", F.col("objectID"), strip(F.concat(text_or_empty("title"), F.lit(GAP), text_or_empty("story_text"))),
        F.timestamp_seconds("created_at_i"),
        [text_or_empty("title").alias("title"), F.col("url").alias("external_url"), zero("points"), zero("num_comments")],
        F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")), F.col("author"),
    ))


def normalize_reddit(raw: DataFrame) -> DataFrame:
    """Payloads carry the community in ``subreddit``."""
    data = ("id STRING, title STRING, selftext STRING, permalink STRING, author STRING, created_utc DOUBLE, score BIGINT, "
            "upvote_ratio DOUBLE, num_comments BIGINT, link_flair_text STRING, url STRING, is_self BOOLEAN")
    rows = _items(raw, f"data STRUCT<children ARRAY<STRUCT<data STRUCT<{data}>>>>", "p.data.children", "subreddit")
    rows = rows.select("fetched_at", "subreddit", "data.*")
    return rows.select(*post(
        "reddit", F.col("id"), strip(F.concat(text_or_empty("title"), F.lit(GAP), text_or_empty("selftext"))),
        F.timestamp_seconds("created_utc"),
        [
            F.col("subreddit"), text_or_empty("title").alias("title"), F.coalesce("score", F.lit(0)).alias("score"),
            F.col("upvote_ratio"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
            F.col("link_flair_text").alias("flair"),
            F.when(~F.coalesce("is_self", F.lit(False)), F.col("url")).alias("external_url"),
        ],
        F.concat(F.lit("https://reddit.com"), text_or_empty("permalink")), F.col("author"),
    ))


RSS = ("channel STRUCT<item ARRAY<STRUCT<title STRING, description STRING, link STRING, guid STRING, pubDate STRING>>>, "
       "item ARRAY<STRUCT<title STRING, description STRING, link STRING, guid STRING, pubDate STRING>>")


def _rss_items(raw: DataFrame, *keep: str) -> DataFrame:
    parsed = raw.select("fetched_at", *keep, F.from_xml("payload", RSS).alias("p"))
    rows = parsed.select("fetched_at", *keep, F.explode(F.coalesce("p.channel.item", "p.item")).alias("i"))
    clean = lambda name: strip(text_or_empty(f"i.{name}")).alias(name)
    return rows.select(
        "fetched_at", *keep, clean("title"), strip_html(clean("description")).alias("description"), clean("link"),
        clean("guid"), F.col("i.pubDate").alias("pubDate"),
    )


def normalize_arxiv(raw: DataFrame) -> DataFrame:
    """Payloads carry the feed category in ``category``."""
    items = _rss_items(raw, "category")
    paper = blank_to_null(F.regexp_extract("link", r"abs/(\S+)$", 1))
    return items.select(*post(
        "arxiv", F.coalesce(paper, F.col("link")), F.concat("title", F.lit(GAP), "description"),
        parse_rfc822("pubDate", "fetched_at"), [F.col("category"), F.col("title")], F.col("link"),
    ))


def normalize_rss(raw: DataFrame, source: str = "lesswrong") -> DataFrame:
    items = _rss_items(raw)
    return items.select(*post(
        source, F.coalesce(blank_to_null(F.col("guid")), F.col("link")), F.concat("title", F.lit(GAP), "description"),
        parse_rfc822("pubDate", "fetched_at"), [F.col("title")], F.col("link"),
    ))


def normalize_hf_models(raw: DataFrame) -> DataFrame:
    model = ("modelId STRING, id STRING, lastModified STRING, pipeline_tag STRING, library_name STRING, "
             "tags ARRAY<STRING>, downloads BIGINT, likes BIGINT")
    rows = _items(raw, f"ARRAY<STRUCT<{model}>>", "p")
    rows = rows.withColumn("mid", F.coalesce(blank_to_null(F.col("modelId")), blank_to_null(F.col("id")))).where("mid IS NOT NULL")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    content = F.concat(
        F.lit("Model: "), F.col("mid"), F.lit("\nPipeline: "), text_or_empty("pipeline_tag"),
        F.lit("\nTags: "), F.array_join(tags, ", "),
    )
    return rows.select(*post(
        "huggingface", F.concat(F.lit("model:"), F.col("mid")), content, parse_feed_iso("lastModified", "fetched_at"),
        [
            F.col("mid").alias("model_id"), F.coalesce("downloads", F.lit(0)).alias("downloads"),
            F.coalesce("likes", F.lit(0)).alias("likes"), F.col("pipeline_tag"), F.col("library_name"), tags.alias("tags"),
        ],
        F.concat(F.lit("https://huggingface.co/"), F.col("mid")),
        F.when(F.contains("mid", F.lit("/")), F.substring_index("mid", "/", 1)),
    ))


def normalize_hf_papers(raw: DataFrame, first: int = 30) -> DataFrame:
    """The first ``first`` papers of every payload."""
    paper = "id STRING, title STRING, summary STRING, upvotes BIGINT, publishedAt STRING"
    schema = f"ARRAY<STRUCT<paper STRUCT<{paper}>, publishedAt STRING, numComments BIGINT>>"
    parsed = raw.select("fetched_at", F.from_json("payload", schema).alias("p"))
    rows = parsed.select("fetched_at", F.explode(F.slice("p", 1, first)).alias("i")).select("fetched_at", "i.*")
    rows = rows.where(text_or_empty("paper.id") != "")
    day = F.to_date("fetched_at").cast("timestamp")
    stamp = F.coalesce(blank_to_null(F.col("publishedAt")), F.col("paper.publishedAt"))
    return rows.select(*post(
        "huggingface", F.concat(F.lit("paper:"), F.col("paper.id")),
        F.concat(text_or_empty("paper.title"), F.lit(GAP), text_or_empty("paper.summary")),
        F.when(stamp.isNull(), day).otherwise(parse_feed_iso(stamp, "fetched_at")),
        [
            F.col("paper.id").alias("paper_id"), F.col("paper.title").alias("title"),
            F.coalesce("paper.upvotes", F.lit(0)).alias("upvotes"), F.coalesce("numComments", F.lit(0)).alias("num_comments"),
        ],
        F.concat(F.lit("https://huggingface.co/papers/"), F.col("paper.id")),
    ))


ATOM = ("entry ARRAY<STRUCT<title STRING, summary STRING, content STRING, link ARRAY<STRUCT<_href STRING>>, id STRING, "
        "updated STRING, published STRING>>")


def normalize_atom(raw: DataFrame, source: str = "geeknews") -> DataFrame:
    parsed = raw.select("fetched_at", F.from_xml("payload", ATOM).alias("p"))
    rows = parsed.select("fetched_at", F.explode("p.entry").alias("i")).select("fetched_at", "i.*")
    text = F.coalesce(blank_to_null(F.col("summary")), F.col("content"), F.lit(""))
    link = F.coalesce(F.get("link", F.lit(0))["_href"], F.lit(""))
    stamp = F.coalesce(blank_to_null(F.col("updated")), F.col("published"))
    read = rows.select(
        "fetched_at", strip(text_or_empty("title")).alias("title"), strip_html(strip(text)).alias("text"), link.alias("url"),
        strip(F.coalesce(blank_to_null(F.col("id")), link)).alias("gid"), stamp.alias("stamp"),
    )
    return relevance_filter(read, ["title", "text"], rules.ATOM_KEYWORDS).select(*post(
        source, F.col("gid"), F.concat("title", F.lit(GAP), "text"), parse_feed_iso("stamp", "fetched_at"),
        [F.col("title")], F.col("url"),
    ))


def normalize_lesswrong(raw: DataFrame, body_chars: int = 5_000) -> DataFrame:
    result = ("_id STRING, title STRING, slug STRING, contents STRUCT<plaintextMainText: STRING>, postedAt STRING, "
              "user STRUCT<displayName: STRING>, baseScore BIGINT, commentCount BIGINT, tags ARRAY<STRUCT<name: STRING>>")
    rows = _items(raw, f"data STRUCT<posts STRUCT<results ARRAY<STRUCT<{result}>>>>", "p.data.posts.results")
    names = F.transform(F.coalesce("tags", F.array().cast("array<struct<name:string>>")), lambda t: t["name"])
    rows = rows.withColumn("names", names).withColumn("topics", F.array_join("names", " "))
    body = F.substring(text_or_empty("contents.plaintextMainText"), 1, body_chars)
    return relevance_filter(rows, ["title", "topics"], rules.LESSWRONG_KEYWORDS).select(*post(
        "lesswrong", F.col("_id"), F.concat(text_or_empty("title"), F.lit(GAP), body), parse_feed_iso("postedAt", "fetched_at"),
        [
            F.col("title"), F.coalesce("baseScore", F.lit(0)).alias("score"),
            F.coalesce("commentCount", F.lit(0)).alias("num_comments"), F.col("names").alias("tags"),
        ],
        F.concat(F.lit("https://www.lesswrong.com/posts/"), F.col("_id"), F.lit("/"), text_or_empty("slug")),
        F.col("user.displayName"),
    ))
