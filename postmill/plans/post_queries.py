"""Queries on the post store."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import scores, times
from postmill.operators import aggregates, filters, merges, ranking, validate
from postmill.plans import bindings as b
from postmill.plans.registry import given, query
from postmill.sources import jsonl, payloads, store

P = given("posts")
PS = given("posts", "scored")


@query("recent_top_by_source", PS + """
    SELECT source, source_id, author, content, "timestamp", metadata, score FROM scored
    WHERE "timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, "timestamp" DESC, source_id) <= 15""")
def recent_top_by_source(spark, sf):
    top = ranking.recent_top_by_source(b.posts(spark, sf), b.AS_OF, 3, 15)
    return top.select("source", "source_id", "author", "content", "timestamp", "metadata", "score")


@query("context_selection", PS + """,
    picked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, "timestamp" DESC, source_id) AS rank
        FROM scored WHERE "timestamp" > TIMESTAMP '2024-01-31' - INTERVAL 3 DAY QUALIFY rank <= 15)
    SELECT source, CAST(rank AS INTEGER) AS rank, score,
           '[' || source || '] (' || CAST(CAST(score AS BIGINT) AS VARCHAR) || ') ' || replace(substr(content, 1, 350), chr(10), ' ') AS entry,
           count(*) OVER (PARTITION BY source) AS n_source
    FROM picked""")
def context_selection(spark, sf):
    return aggregates.context_selection(b.posts(spark, sf), b.AS_OF, 3, 15)


@query("context_counts", P + """
    SELECT source, least(count(*), 15) AS n FROM posts
    WHERE "timestamp" > TIMESTAMP '2024-01-31' - INTERVAL 3 DAY GROUP BY source""")
def context_counts(spark, sf):
    return aggregates.context_counts(aggregates.context_selection(b.posts(spark, sf), b.AS_OF, 3, 15))


@query("recent", P + """
    SELECT source, author, "timestamp", substr(content, 1, 120) AS preview, source_url
    FROM posts ORDER BY "timestamp" DESC, source, source_id LIMIT 20""")
def recent(spark, sf):
    return ranking.recent(b.posts(spark, sf), 20)


@query("top_scored", PS + """,
    newest AS (SELECT * FROM scored WHERE source = 'click' ORDER BY "timestamp" DESC, source_id LIMIT 25)
    SELECT source, source_id, author, "timestamp", substr(content, 1, 150) AS preview, source_url, cli_score AS score
    FROM newest ORDER BY cli_score DESC, "timestamp" DESC, source_id LIMIT 5""")
def top_scored(spark, sf):
    return ranking.top_scored(b.posts(spark, sf), "click", 5)


@query("engagement_scores", PS + """,
    v AS (SELECT post_id, score AS one, cli_score AS one_cli, CAST(CAST(round(value) AS BIGINT) AS DOUBLE) AS n FROM scored JOIN events ON event_id = post_id)
    SELECT post_id, CASE post_id % 3 WHEN 0 THEN 0 WHEN 1 THEN n ELSE one END AS score_sql,
           CASE post_id % 3 WHEN 0 THEN n WHEN 1 THEN CASE WHEN n = 0 THEN 5 ELSE n END ELSE one END AS score_py,
           CASE post_id % 3 WHEN 0 THEN n WHEN 1 THEN n ELSE one_cli END AS score_cli FROM v""")
def engagement_scores(spark, sf):
    """Posts with several keys: points of zero before a score, upvotes beside comments, or one key."""
    n = F.round("value").cast("bigint").cast("string")
    values = b.table(spark, sf, "events").select(F.col("event_id").alias("post_id"), n.alias("n"))
    third = F.col("post_id") % 3
    metadata = F.when(third == 0, F.concat(F.lit('{"points": 0, "score": '), "n", F.lit("}"))).when(
        third == 1, F.concat(F.lit('{"num_comments": 5, "upvotes": '), "n", F.lit("}"))).otherwise(F.col("metadata"))
    p = b.posts(spark, sf).join(values, "post_id").withColumn("metadata", metadata)
    return p.select("post_id", *[scores.engagement_score("metadata", v).alias(f"score_{v}") for v in ("sql", "py", "cli")])


@query("source_stats", P + """
    SELECT source, count(*) AS n, min("timestamp") AS oldest, max("timestamp") AS newest FROM posts GROUP BY source""")
def source_stats(spark, sf):
    return aggregates.source_stats(b.posts(spark, sf))


@query("source_counts_since", P + """
    SELECT source, count(*) AS n FROM posts WHERE "timestamp" > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY source""")
def source_counts_since(spark, sf):
    return aggregates.source_counts_since(b.posts(spark, sf), b.AS_OF, "7d")


@query("count_posts", P + "SELECT count(*) AS n FROM posts")
def count_posts(spark, sf):
    return aggregates.count_posts(b.posts(spark, sf))


@query("source_breakdown", P + "SELECT source, count(*) AS n FROM posts GROUP BY source")
def source_breakdown(spark, sf):
    return aggregates.source_breakdown(b.posts(spark, sf))


@query("since", P + """
    SELECT post_id, source, "timestamp" FROM posts WHERE "timestamp" > TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR""")
def since(spark, sf):
    return filters.since(b.posts(spark, sf), b.AS_OF, "36h").select("post_id", "source", "timestamp")


@query("time_window", P + """
    SELECT post_id, "timestamp" FROM posts
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 13:00:00' - INTERVAL 9 HOUR AND TIMESTAMP '2024-01-12 08:30:00' - INTERVAL 9 HOUR""")
def time_window(spark, sf):
    rows = filters.time_window(b.posts(spark, sf), "2024-01-10T13:00", "2024-01-12T08:30")
    return rows.select("post_id", "timestamp")


@query("incremental_cut", P + """
    SELECT post_id, "timestamp" FROM posts WHERE "timestamp" > (SELECT max(o_orderdate) + INTERVAL 8210 DAY FROM orders WHERE o_orderstatus = 'F')""")
def incremental_cut(spark, sf):
    done = b.runs(spark, sf).where("status = 'success'").agg(F.max("started_at").alias("t"))
    mark = F.col("t") + F.make_dt_interval(F.lit(8210))
    state = done.select(F.lit("last_run_at").alias("key"), mark.cast("string").alias("value"), mark.alias("updated_at"))
    return filters.incremental_cut(b.posts(spark, sf), state, b.AS_OF).select("post_id", "timestamp")


def _batches(spark, sf):
    """Stored orders, and an overlapping batch in which keys repeat."""
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("k"), "o_orderstatus",
    )
    total = F.floor(F.col("l_quantity")).cast("bigint")
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), total.cast("double").alias("q"), "l_partkey", "l_suppkey",
    )
    batch = lines.join(o.select("k", "source", "source_id"), "k")
    batch = batch.select("source", "source_id", F.col("q").alias("value"), "seq", "l_partkey", "l_suppkey")
    return o.where("o_orderstatus <> 'P'").drop("k", "o_orderstatus"), batch


_BATCH = """WITH o AS (SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS source_id, o_totalprice AS value, o_orderkey AS k, o_orderstatus FROM orders),
    existing AS (SELECT source, source_id, value FROM o WHERE o_orderstatus <> 'P'),
    batch AS (SELECT o.source, o.source_id, floor(l_quantity) AS value, l_linenumber AS seq, l_partkey, l_suppkey
              FROM lineitem JOIN o ON l_orderkey = o.k),"""


@query("upsert", _BATCH + """
    latest AS (SELECT source, source_id, value FROM batch
        QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY seq DESC, l_partkey DESC, l_suppkey DESC, value DESC) = 1)
    SELECT * FROM latest UNION ALL SELECT * FROM existing e WHERE NOT EXISTS (
        SELECT 1 FROM latest l WHERE l.source = e.source AND l.source_id = e.source_id)""")
def upsert(spark, sf):
    existing, batch = _batches(spark, sf)
    return merges.upsert(existing, batch, merges.POST_KEYS, ["seq", "l_partkey", "l_suppkey", "value"])


@query("insert_ignore", _BATCH + """
    first AS (SELECT source, source_id, value FROM batch
        QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY seq, l_partkey, l_suppkey, value) = 1)
    SELECT * FROM existing UNION ALL SELECT * FROM first f WHERE NOT EXISTS (
        SELECT 1 FROM existing e WHERE f.source = e.source AND f.source_id = e.source_id)""")
def insert_ignore(spark, sf):
    existing, batch = _batches(spark, sf)
    return merges.insert_ignore(existing, batch, merges.POST_KEYS, ["seq", "l_partkey", "l_suppkey", "value"])


@query("ingest_report", _BATCH + """
    keys AS (SELECT source, source_id FROM existing UNION SELECT source, source_id FROM batch),
    v AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE value < 10) AS bad FROM batch GROUP BY source),
    e AS (SELECT source, count(*) AS n FROM existing GROUP BY source),
    a AS (SELECT source, count(*) AS n FROM (SELECT source, source_id FROM existing UNION SELECT source, source_id FROM batch WHERE value >= 10) GROUP BY source)
    SELECT source, v.n AS rows_read, bad AS rejected, a.n - e.n AS inserted, v.n - bad - (a.n - e.n) AS not_new
    FROM v JOIN e USING (source) JOIN a USING (source)""")
def ingest_report(spark, sf):
    existing, batch = _batches(spark, sf)
    valid, rejected = batch.where("value >= 10"), batch.where("value < 10")
    after = merges.insert_ignore(existing, valid, merges.POST_KEYS, ["seq", "l_partkey", "l_suppkey", "value"])
    return aggregates.ingest_report(valid, rejected, existing, after)


def _dirty_posts(spark, sf):
    """Events with gaps: every seventh without content, every eleventh without a source, metadata missing or a bare number."""
    e = F.col("post_id")
    return b.posts(spark, sf).withColumns({
        "content": F.when(e % 7 == 0, "").otherwise(F.col("content")),
        "source": F.when(e % 11 != 0, F.col("source")),
        "fetched_at": F.when(e % 2 == 0, F.col("fetched_at")),
        "metadata": F.when(e % 3 == 1, F.col("metadata")).when(e % 3 == 2, e.cast("string")),
    })


@query("normalize_posts", P + """
    SELECT source, source_id, fetched_at, CASE post_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN metadata ELSE '{"value":' || post_id || '}' END AS metadata
    FROM posts WHERE post_id % 7 <> 0 AND post_id % 11 <> 0""")
def normalize_posts(spark, sf):
    valid, _ = validate.normalize_posts(_dirty_posts(spark, sf))
    return valid.select("source", "source_id", "fetched_at", "metadata")


@query("rejected_posts", """SELECT CAST(event_id AS VARCHAR) AS source_id,
    CASE WHEN event_id % 77 = 0 THEN 'source, content' WHEN event_id % 11 = 0 THEN 'source' ELSE 'content' END AS reason
    FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0""")
def rejected_posts(spark, sf):
    _, rejected = validate.normalize_posts(_dirty_posts(spark, sf))
    return rejected.select("source_id", "reason")


@query("normalize_metadata", P + """
    SELECT post_id, CASE post_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN metadata WHEN 2 THEN '{"value":' || post_id || '}'
        WHEN 3 THEN '{"value":"n-' || post_id || '"}' ELSE metadata END AS metadata FROM posts""")
def normalize_metadata(spark, sf):
    p = F.col("post_id")
    raw = (
        F.when(p % 5 == 0, F.lit(None).cast("string")).when(p % 5 == 1, F.col("metadata"))
        .when(p % 5 == 2, p.cast("string")).when(p % 5 == 3, F.concat(F.lit("n-"), p.cast("string")))
        .otherwise(F.concat(F.lit('"'), F.replace("metadata", F.lit('"'), F.lit('\\"')), F.lit('"')))
    )
    return b.posts(spark, sf).select("post_id", validate.normalize_metadata(raw).alias("metadata"))


@query("backfill_posts", P + "SELECT source, source_id, metadata, fetched_at FROM posts")
def backfill_posts(spark, sf):
    return store.backfill_posts(b.posts(spark, sf)).select("source", "source_id", "metadata", "fetched_at")


@query("backfill_dry_run", P + "SELECT count(*) AS n FROM posts")
def backfill_dry_run(spark, sf):
    return store.backfill_dry_run(b.posts(spark, sf))


@query("post_lines", P + """
    SELECT source, source_id, content, metadata FROM posts WHERE post_id % 9 <> 0""")
def post_lines(spark, sf):
    """Posts written as JSON lines, every ninth line broken, read back."""
    p = b.posts(spark, sf)
    line = F.to_json(F.struct("source", "source_id", "content", "timestamp", "metadata"))
    lines = p.select(F.when(F.col("post_id") % 9 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    good, _ = jsonl.parse_post_lines(lines)
    return good.select("source", "source_id", "content", "metadata")


@query("bad_post_lines", "SELECT count(*) AS n FROM events WHERE event_id % 9 = 0")
def bad_post_lines(spark, sf):
    p = b.posts(spark, sf)
    line = F.to_json(F.struct("source", "source_id", "content", "timestamp", "metadata"))
    lines = p.select(F.when(F.col("post_id") % 9 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    return jsonl.parse_post_lines(lines)[1].agg(F.count(F.lit(1)).alias("n"))


@query("latest_run_per_source", given("runs") + """
    SELECT source, started_at, status, run_no FROM runs
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_no DESC) = 1""")
def latest_run_per_source(spark, sf):
    return ranking.latest_run_per_source(b.runs(spark, sf), ["run_no"]).select("source", "started_at", "status", "run_no")


@query("run_failures", given("runs") + """
    SELECT source, started_at, run_no FROM runs
    WHERE status = 'error' AND started_at > TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR""")
def run_failures(spark, sf):
    return aggregates.run_failures(b.runs(spark, sf), "1998-06-01", 24).select("source", "started_at", "run_no")


@query("missing_daily_slots", given("runs") + """,
    days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '1998-06-30', INTERVAL 1 DAY) t(d))
    SELECT CAST(day AS VARCHAR) AS day FROM days WHERE CAST(day AS TIMESTAMP) + INTERVAL 8 HOUR <= TIMESTAMP '1998-06-15 07:00:00'
    AND day NOT IN (SELECT CAST(started_at + INTERVAL 9 HOUR AS DATE) FROM runs)""")
def missing_daily_slots(spark, sf):
    slots = aggregates.missing_daily_slots(b.runs(spark, sf), "1995-01-01", "1998-06-30", "1998-06-14 22:00:00")
    return slots.select(F.col("day").cast("string").alias("day"))


@query("time_functions", P + """
    SELECT post_id, strftime("timestamp" + INTERVAL 9 HOUR, '%Y-%m-%d') AS kst_day,
           strftime("timestamp" + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' UTC+9' AS kst_label,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc_label,
           strftime("timestamp" + INTERVAL 9 HOUR, '%Y-%m-%d_%H-%M-%S') || '_KST' AS file_label,
           year("timestamp" + INTERVAL 9 HOUR) || '. ' || month("timestamp" + INTERVAL 9 HOUR) || '. '
             || day("timestamp" + INTERVAL 9 HOUR) || '. '
             || CASE WHEN hour("timestamp" + INTERVAL 9 HOUR) < 12 THEN '오전' ELSE '오후' END || ' '
             || CASE WHEN hour("timestamp" + INTERVAL 9 HOUR) % 12 = 0 THEN 12 ELSE hour("timestamp" + INTERVAL 9 HOUR) % 12 END
             || ':' || lpad(CAST(minute("timestamp" + INTERVAL 9 HOUR) AS VARCHAR), 2, '0') AS header_label,
           strftime("timestamp" + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS header_time
    FROM posts""")
def time_functions(spark, sf):
    header = F.concat(F.lit("["), times.header_label("timestamp"), F.lit("] someone"))
    return b.posts(spark, sf).select(
        "post_id", times.kst_date("timestamp").cast("string").alias("kst_day"), times.kst_label("timestamp").alias("kst_label"),
        times.utc_label("timestamp").alias("utc_label"), times.file_label("timestamp").alias("file_label"),
        times.header_label("timestamp").alias("header_label"),
        F.date_format(times.chat_timestamp(header), "yyyy-MM-dd HH:mm").alias("header_time"),
    )


@query("parse_iso", P + """
    SELECT post_id, CASE post_id % 4 WHEN 0 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S')
        WHEN 1 THEN strftime("timestamp" - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S')
        WHEN 2 THEN strftime("timestamp" + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc FROM posts""")
def parse_iso(spark, sf):
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    p = F.col("post_id")
    raw = (
        F.when(p % 4 == 0, F.concat(text, F.lit("Z"))).when(p % 4 == 1, text)
        .when(p % 4 == 2, F.concat(text, F.lit("-04:00"))).otherwise(F.lit("  "))
    )
    utc = F.date_format(times.parse_iso(raw), "yyyy-MM-dd HH:mm:ss")
    return b.posts(spark, sf).select("post_id", utc.alias("utc"))


def _stamp(c="timestamp"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ts")


def _payload(spark, sf, *cols):
    """Text posts with the columns payloads are made of."""
    p = b.text_posts(spark, sf).withColumn("fetched_at", F.lit("2024-06-01").cast("timestamp"))
    return p.withColumn("epoch", F.unix_timestamp(F.col("timestamp").cast("timestamp")))


TP = given("text_posts")


@query("normalize_hackernews", TP + """
    SELECT CAST(post_id AS VARCHAR) AS source_id, trim(author || chr(10) || chr(10) || content, """ + "' ' || chr(9) || chr(10) || chr(13)" + """) AS content,
           '{"title":"' || author || '","external_url":null,"points":' || post_id % 9 || ',"num_comments":0}' AS metadata,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts
    FROM text_posts WHERE """ + "(" + " OR ".join(
        f"contains(lower(author || ' ' || content), '{k}')" for k in (
            "gpt", "claude", "gemini", "llm", "ai", "openai", "anthropic", "deepmind", "llama", "mistral", "transformer",
            "diffusion", "huggingface", "ollama", "stable diffusion", "sora")) + ")")
def normalize_hackernews(spark, sf):
    hit = F.struct(
        F.col("source_id").alias("objectID"), F.col("author").alias("title"), F.col("content").alias("story_text"),
        F.col("epoch").alias("created_at_i"), (F.col("post_id") % 9).alias("points"),
    )
    raw = _payload(spark, sf).select("fetched_at", F.to_json(F.struct(F.array(hit).alias("hits"))).alias("payload"))
    return payloads.normalize_hackernews(raw).select("source_id", "content", "metadata", _stamp())


@query("normalize_reddit", TP + """
    SELECT CAST(post_id AS VARCHAR) AS source_id, 'https://reddit.com/r/' || source AS source_url,
           CAST(post_id % 13 AS DOUBLE) AS score, CASE WHEN post_id % 2 = 1 THEN 'http://x/' || post_id END AS external_url,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts
    FROM text_posts""")
def normalize_reddit(spark, sf):
    p = F.col("post_id")
    data = F.struct(
        F.col("source_id").alias("id"), F.col("author").alias("title"), F.col("content").alias("selftext"),
        F.concat(F.lit("/r/"), F.col("source")).alias("permalink"), F.col("epoch").alias("created_utc"),
        (p % 13).alias("score"), (p % 2 == 0).alias("is_self"), F.concat(F.lit("http://x/"), p.cast("string")).alias("url"),
    )
    children = F.array(F.struct(data.alias("data")))
    raw = _payload(spark, sf).select(
        "fetched_at", F.col("source").alias("subreddit"), F.to_json(F.struct(F.struct(children.alias("children")).alias("data"))).alias("payload")
    )
    return payloads.normalize_reddit(raw).select(
        "source_id", "source_url", F.get_json_object("metadata", "$.score").cast("double").alias("score"),
        F.get_json_object("metadata", "$.external_url").alias("external_url"), _stamp(),
    )


def _xml(c):
    """Text as XML character data."""
    return F.concat(F.lit("<![CDATA["), F.replace(F.col(c), F.lit("]]>"), F.lit("")), F.lit("]]>"))


@query("normalize_arxiv", TP + """
    SELECT '2401.' || post_id AS source_id, 'https://arxiv.org/abs/2401.' || post_id AS source_url, author AS category_lang,
           CASE WHEN post_id % 3 = 0 THEN '2024-06-01 00:00:00' ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS ts
    FROM text_posts""")
def normalize_arxiv(spark, sf):
    p = _payload(spark, sf)
    pub = F.when(F.col("post_id") % 3 == 0, "soon").otherwise(
        F.concat(F.lit("Mon, "), F.date_format("timestamp", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    )
    item = F.concat(
        F.lit("<rss><channel><item><title>"), F.col("source"), F.lit("</title><description>"), _xml("content"),
        F.lit("</description><link>https://arxiv.org/abs/2401."), F.col("source_id"), F.lit("</link><pubDate>"), pub,
        F.lit("</pubDate></item></channel></rss>"),
    )
    raw = p.select("fetched_at", F.col("author").alias("category"), item.alias("payload"))
    return payloads.normalize_arxiv(raw).select(
        "source_id", "source_url", F.get_json_object("metadata", "$.category").alias("category_lang"), _stamp()
    )


@query("normalize_rss", TP + """
    SELECT CASE WHEN post_id % 2 = 0 THEN 'g' || post_id ELSE 'http://x/' || post_id END AS source_id, 'http://x/' || post_id AS source_url,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts FROM text_posts""")
def normalize_rss(spark, sf):
    guid = F.when(F.col("post_id") % 2 == 0, F.concat(F.lit("<guid>g"), F.col("source_id"), F.lit("</guid>"))).otherwise("")
    item = F.concat(
        F.lit("<rss><channel><item><title>"), F.col("source"), F.lit("</title><description>"), _xml("content"),
        F.lit("</description><link>http://x/"), F.col("source_id"), F.lit("</link>"), guid, F.lit("<pubDate>Tue, "),
        F.date_format("timestamp", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"),
    )
    raw = _payload(spark, sf).select("fetched_at", item.alias("payload"))
    return payloads.normalize_rss(raw).select("source_id", "source_url", _stamp())


@query("normalize_atom", TP + """
    SELECT 'id-' || post_id AS source_id, 'http://x/' || post_id AS source_url, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts
    FROM text_posts WHERE """ + "(" + " OR ".join(
        f"contains(lower(source || ' ' || lang2), '{k}')" for k in ("ai", "llm", "gpt", "claude", "gemini", "ml", "agent")).replace(
            "lang2", "CASE WHEN post_id % 2 = 0 THEN 'An agent' ELSE 'none' END") + ")")
def normalize_atom(spark, sf):
    note = F.when(F.col("post_id") % 2 == 0, "<b>An agent</b>").otherwise("none")
    entry = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.col("source"), F.lit("</title><summary><![CDATA["),
        note, F.lit(']]></summary><link href="http://x/'), F.col("source_id"), F.lit('"/><id>id-'), F.col("source_id"),
        F.lit("</id><updated>"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry></feed>"),
    )
    raw = _payload(spark, sf).select("fetched_at", entry.alias("payload"))
    return payloads.normalize_atom(raw).select("source_id", "source_url", _stamp())


@query("normalize_hf_models", TP + """
    SELECT 'model:' || source || '/' || post_id AS source_id, source AS author,
           'Model: ' || source || '/' || post_id || chr(10) || 'Pipeline: ' || author || chr(10) || 'Tags: a, ' || author AS content,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts FROM text_posts""")
def normalize_hf_models(spark, sf):
    model = F.struct(
        F.concat("source", F.lit("/"), "source_id").alias("modelId"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastModified"),
        F.col("author").alias("pipeline_tag"), F.array(F.lit("a"), F.col("author")).alias("tags"), F.col("post_id").alias("likes"),
    )
    raw = _payload(spark, sf).select("fetched_at", F.to_json(F.array(model)).alias("payload"))
    return payloads.normalize_hf_models(raw).select("source_id", "author", "content", _stamp())


@query("normalize_hf_papers", TP + """
    SELECT 'paper:' || post_id AS source_id, source || chr(10) || chr(10) || content AS content, CAST(post_id % 17 AS DOUBLE) AS score,
           CASE WHEN post_id % 3 = 0 THEN '2024-06-01 00:00:00' ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS ts FROM text_posts""")
def normalize_hf_papers(spark, sf):
    paper = F.struct(
        F.col("source_id").alias("id"), F.col("source").alias("title"), F.col("content").alias("summary"), (F.col("post_id") % 17).alias("upvotes")
    )
    at = F.when(F.col("post_id") % 3 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = _payload(spark, sf).select(
        "fetched_at", F.to_json(F.array(F.struct(paper.alias("paper"), at.alias("publishedAt")))).alias("payload")
    )
    return payloads.normalize_hf_papers(raw).select(
        "source_id", "content", scores.engagement_score("metadata").alias("score"), _stamp()
    )


@query("normalize_lesswrong", TP + """
    SELECT CAST(post_id AS VARCHAR) AS source_id, 'https://www.lesswrong.com/posts/' || post_id || '/s' AS source_url,
           source || chr(10) || chr(10) || substr(content, 1, 5000) AS content, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts
    FROM text_posts WHERE post_id % 3 = 0""")
def normalize_lesswrong(spark, sf):
    tag = F.when(F.col("post_id") % 3 == 0, "RLHF").otherwise("world")
    result = F.struct(
        F.col("source_id").alias("_id"), F.col("source").alias("title"), F.lit("s").alias("slug"),
        F.struct(F.col("content").alias("plaintextMainText")).alias("contents"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("postedAt"), F.array(F.struct(tag.alias("name"))).alias("tags"),
    )
    body = F.struct(F.struct(F.struct(F.array(result).alias("results")).alias("posts")).alias("data"))
    raw = _payload(spark, sf).select("fetched_at", F.to_json(body).alias("payload"))
    return payloads.normalize_lesswrong(raw).select("source_id", "source_url", "content", _stamp())
