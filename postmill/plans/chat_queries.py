"""Queries on chat messages, chunks, evidence and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.functions import times
from postmill.operators import aggregates, chunking, evidence, merges, ranking, replies
from postmill.plans import bindings as b
from postmill.plans.registry import given, query
from postmill.sources import chat_export, timeline

M = given("messages")
TRIM = "' ' || chr(9) || chr(10) || chr(13)"


@query("normalize_chat", M + f"""
    SELECT substr(sha1(strftime(ts_kst, '%Y-%m-%dT%H:%M:%S+09:00') || '|' || author || '|' || substr(trim(content, {TRIM}), 1, 100)), 1, 16) AS source_id,
           author, trim(content, {TRIM}) AS content, strftime(ts_kst - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS utc
    FROM messages WHERE trim(content, {TRIM}) <> ''""")
def normalize_chat(spark, sf):
    """Turns written as exported blocks, read back into posts."""
    m = b.messages(spark, sf)
    header = F.concat(F.lit("["), times.header_label(F.col("ts_kst") - times.hours(9)), F.lit("] "), "author")
    blocks = m.select("channel", "ordinal", header.alias("header"), F.concat(header, F.lit("\n"), "content", F.lit("\n")).alias("block"))
    posts = chat_export.normalize_chat(
        chat_export.message_fields(blocks), {"guild": "g", "channel": "c"}, F.lit("2026-05-01").cast("timestamp")
    )
    return posts.select("source_id", "author", "content", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("utc"))


def _noisy(c):
    """Message text with exporter leftovers."""
    return F.concat(
        F.col(c), F.lit("\n{Attachments}\nhttps://cdn.discordapp.com/attachments/1/"), F.col("ordinal").cast("string"),
        F.lit("/x.png tail {Embed}"), F.when(F.col("ordinal") % 2 == 0, "\nhttps://media.discordapp.net/attachments/9/y").otherwise(""),
    )


_NOISY = """noisy AS (SELECT *, content || chr(10) || '{Attachments}' || chr(10) || 'https://cdn.discordapp.com/attachments/1/' || ordinal
    || '/x.png tail {Embed}' || CASE WHEN ordinal % 2 = 0 THEN chr(10) || 'https://media.discordapp.net/attachments/9/y' ELSE '' END AS raw FROM messages)"""


@query("strip_chat_noise", given("messages", more=_NOISY) + """
    SELECT channel, ordinal, content || chr(10) || chr(10) || ' tail ' || CASE WHEN ordinal % 2 = 0 THEN chr(10) ELSE '' END AS text FROM noisy""")
def strip_chat_noise(spark, sf):
    return b.messages(spark, sf).select("channel", "ordinal", tx.strip_chat_noise(_noisy("content")).alias("text"))


@query("noise_audit", given("messages", more=_NOISY) + """
    SELECT channel, count(*) AS attachments, count(*) AS embed, count(*) AS cdn_attachments,
           count(*) FILTER (WHERE ordinal % 2 = 0) AS media_attachments FROM noisy GROUP BY channel""")
def noise_audit(spark, sf):
    texts = b.messages(spark, sf).withColumn("raw", _noisy("content"))
    return aggregates.noise_audit(texts, "channel", "raw").select("channel", "attachments", "embed", "cdn_attachments", "media_attachments")


@query("clean_message_blocks", M + f"""
    SELECT channel, ordinal, '[' || author || ']' || chr(10) || array_to_string(list_filter(list_transform(
        string_split(content, chr(10)), lambda x: rtrim(x, {TRIM})), lambda x: x <> ''), chr(10)) || chr(10) || '/ tail' AS block
    FROM messages""")
def clean_message_blocks(spark, sf):
    m = b.messages(spark, sf)
    body = F.concat(
        F.lit("\n\n\n["), "author", F.lit("]\n"), "content",
        F.lit("\n{Attachments}\nhttps://cdn.discordapp.com/attachments/1/2\n \n/ tail \n\n\n\n["), "author", F.lit("]\n{Embed}\n\n\n\nno header\ntext"),
    )
    exports = m.select(F.struct("channel", "ordinal").alias("file"), body.alias("body"))
    return chat_export.clean_message_blocks(exports).select("file.channel", "file.ordinal", "block")


def _chunk_sql(weight: str, limit: int, glue: str) -> str:
    """Greedy packing, one message per step."""
    return given("messages", recursive=True, more=f"""m AS MATERIALIZED (SELECT channel, ordinal, block, {weight} AS w,
            row_number() OVER (PARTITION BY channel ORDER BY ordinal) AS i FROM messages),
        walk AS (SELECT channel, i, ordinal, block, w AS total, 0 AS chunk FROM m WHERE i = 1
            UNION ALL SELECT m.channel, m.i, m.ordinal, m.block, CASE WHEN k.total + m.w > {limit} THEN m.w ELSE k.total + m.w END,
                CASE WHEN k.total + m.w > {limit} THEN k.chunk + 1 ELSE k.chunk END
            FROM walk k JOIN m ON m.channel = k.channel AND m.i = k.i + 1)""") + f"""
        SELECT channel, CAST(chunk AS BIGINT) AS chunk_index, string_agg(block, {glue} ORDER BY ordinal) AS text,
               count(*) AS n_messages, min(ordinal) AS first_ordinal FROM walk GROUP BY channel, chunk"""


@query("pack_chunks", _chunk_sql("length(block)", 1500, "''"))
def pack_chunks(spark, sf):
    return chunking.pack_chunks(b.messages(spark, sf), 1500).select("channel", "chunk_index", "text", "n_messages", "first_ordinal")


@query("pack_chunks_tokens", _chunk_sql("CAST(floor(length(block) / 3.5) AS BIGINT)", 400, "chr(10) || chr(10)"))
def pack_chunks_tokens(spark, sf):
    packed = chunking.pack_chunks_tokens(b.messages(spark, sf), 400)
    return packed.select("channel", "chunk_index", "text", "n_messages", "first_ordinal")


@query("pack_one_stream", """WITH RECURSIVE m AS MATERIALIZED (SELECT length(text) AS w, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
    walk AS (SELECT i, w AS total, 0 AS chunk FROM m WHERE i = 1
        UNION ALL SELECT m.i, CASE WHEN k.total + m.w > 40000 THEN m.w ELSE k.total + m.w END, CASE WHEN k.total + m.w > 40000 THEN k.chunk + 1 ELSE k.chunk END
        FROM walk k JOIN m ON m.i = k.i + 1)
    SELECT CAST(chunk AS BIGINT) AS chunk_index, count(*) AS n, max(total) AS size FROM walk GROUP BY chunk""")
def pack_one_stream(spark, sf):
    """All documents as one long channel."""
    d = b.table(spark, sf, "documents").select(F.lit("all").alias("channel"), F.col("doc_id").alias("ordinal"), F.length("text").alias("w"))
    index = chunking.chunk_index(d, F.col("w"), 40_000, block=4_096)
    return d.join(index, ["channel", "ordinal"]).groupBy("chunk_index").agg(F.count(F.lit(1)).alias("n"), F.sum("w").cast("bigint").alias("size"))


def _results(spark, sf):
    """Chunk results: conversations with times; every fifth lacks one."""
    m = b.messages(spark, sf).withColumn("chunk_index", F.col("channel").cast("bigint"))
    bounds = aggregates.time_bounds(m, ["chunk_index"], "ts_kst")
    return bounds.withColumn("first_time", F.when(F.col("chunk_index") % 5 != 0, F.col("earliest")))


_RESULTS = given("messages", more="""results AS (SELECT CAST(channel AS BIGINT) AS chunk_index, min(ts_kst) AS earliest, max(ts_kst) AS latest,
    strftime(min(ts_kst), '%Y-%m-%d %H:%M') || ' ~ ' || strftime(max(ts_kst), '%Y-%m-%d %H:%M') AS label,
    CASE WHEN CAST(channel AS BIGINT) % 5 <> 0 THEN min(ts_kst) END AS first_time FROM messages GROUP BY channel)""")


@query("time_bounds", _RESULTS + "SELECT chunk_index, earliest, latest, label FROM results")
def time_bounds(spark, sf):
    return _results(spark, sf).select("chunk_index", "earliest", "latest", "label")


@query("order_chunk_results", _RESULTS + "SELECT chunk_index, label FROM results")
def order_chunk_results(spark, sf):
    return ranking.order_chunk_results(_results(spark, sf)).select("chunk_index", "label")


@query("period", _RESULTS + """
    SELECT (SELECT trim(string_split(label, '~')[1]) FROM results ORDER BY first_time NULLS LAST, chunk_index LIMIT 1) AS "start",
           (SELECT trim(string_split(label, '~')[2]) FROM results ORDER BY first_time DESC NULLS FIRST, chunk_index DESC LIMIT 1) AS "end" """)
def period(spark, sf):
    return aggregates.period(_results(spark, sf))


@query("pending_chunks", """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS channel, conv_id AS chunk_index FROM conversations
    WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def pending_chunks(spark, sf):
    c = b.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("channel"), F.col("conv_id").alias("chunk_index"), "role")
    return chunking.pending_chunks(c.select("channel", "chunk_index").distinct(), c.where("role = 'system'"))


@query("concat_base_tail", "SELECT conv_id, turn AS ordinal, CAST(turn >= 2 AS INTEGER) AS part FROM conversations")
def concat_base_tail(spark, sf):
    c = b.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"))
    return merges.concat_base_tail(c.where("ordinal < 2"), c.where("ordinal >= 2"))


@query("timeline_order", M + "SELECT channel, ordinal, ts_kst FROM messages")
def timeline_order(spark, sf):
    return ranking.timeline_order(b.messages(spark, sf), "desc", "ts_kst").select("channel", "ordinal", "ts_kst")


@query("collect_unique", """WITH t AS (SELECT page_id // 2 AS id, page_id, CASE WHEN page_id % 10 = 0 THEN NULL ELSE page_id // 2 END AS k FROM pages)
    SELECT min(page_id) AS pos FROM t WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT page_id FROM t WHERE k IS NULL""")
def collect_unique(spark, sf):
    p = b.table(spark, sf, "pages")
    key = F.when(F.col("page_id") % 10 != 0, F.floor(F.col("page_id") / 2).cast("string"))
    rows = p.select(
        F.lit(1).alias("page_no"), F.col("page_id").alias("pos"), key.alias("id"), F.concat(F.lit("http://x/status/"), key).alias("url")
    )
    return merges.collect_unique(rows).select("pos")


@query("extract_timeline_pages", """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS replying_to, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS content,
    doc_id % 1500 AS likes, CASE WHEN doc_id % 1500 >= 1000 THEN 0 ELSE doc_id % 1500 END AS replies,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 500000 * 7 AS INTEGER)), '%Y-%m-%d %H:%M') AS ts, 'c' || doc_id AS next_cursor
    FROM documents WHERE doc_id % 8 <> 0""")
def extract_timeline_pages(spark, sf):
    """Every document as a page with one tweet; every eighth has no date."""
    p = b.text_posts(spark, sf)
    text = F.trim(F.regexp_replace("content", r"(?U)\s+", " "))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    date = F.date_format("timestamp", "MMM d, yyyy · h:mm a 'UTC'")
    number = F.format_number((F.col("post_id") % 1500).cast("double"), 0)
    html = F.concat(
        F.lit('<html><body><div class="timeline"><div class="timeline-item"><a class="tweet-link" href="/u/status/'), F.col("source_id"),
        F.lit('#m"></a><div class="tweet-body"><span class="tweet-date"><a href="/x" title="'), F.when(F.col("post_id") % 8 != 0, date).otherwise(""),
        F.lit('">t</a></span><div class="replying-to">Replying to '), F.col("author"), F.lit('</div><div class="tweet-content media-body">'), text,
        F.lit('</div><div class="tweet-stats"><span class="tweet-stat"><div class="icon-container"><span class="icon-comment"></span> '), number,
        F.lit('</div></span><span class="tweet-stat"><div class="icon-container"><span class="icon-heart"></span> '), number,
        F.lit('</div></span></div></div></div></div><a href="?cursor=c'), F.col("source_id"), F.lit('">more</a></body></html>'),
    )
    pages = p.select(F.col("post_id").cast("int").alias("page_no"), F.lit("u").alias("user"), html.alias("html"))
    return timeline.extract_timeline_pages(pages).select(
        "id", "replying_to", "content", "stats.likes", "stats.replies", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "next_cursor"
    )


# ---- evidence ----

LATIN_TOPICS = [("French", ["avec", "elle"]), ("English", ["whst", "the of"]), ("German", ["ver", "ung"])]


def _summaries(spark, sf):
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("text").alias("summary"))


@query("topic_match", """WITH s AS (SELECT doc_id AS chunk_index, lower(text) AS low FROM documents),
    m AS (SELECT chunk_index, unnest([
        {'topic': 'French', 'score': CAST(contains(low, 'avec') AS INTEGER) + CAST(contains(low, 'elle') AS INTEGER)},
        {'topic': 'English', 'score': CAST(contains(low, 'whst') AS INTEGER) + CAST(contains(low, 'the of') AS INTEGER)},
        {'topic': 'German', 'score': CAST(contains(low, 'ver') AS INTEGER) + CAST(contains(low, 'ung') AS INTEGER)}]) AS t FROM s)
    SELECT chunk_index, t.topic AS topic, t.score AS score FROM m WHERE t.score >= 1""")
def topic_match(spark, sf):
    return evidence.topic_match(_summaries(spark, sf), LATIN_TOPICS)


@query("topic_evidence", f"""WITH l AS (SELECT doc_id AS chunk_index, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    c AS (SELECT *, trim(regexp_replace(line, '^\\s*[*\\-]\\s*', ''), {TRIM}) AS clean FROM l),
    t AS (SELECT 'French' AS topic, * FROM c WHERE contains(lower(line), 'avec') OR contains(lower(line), 'elle')
        UNION ALL SELECT 'English', * FROM c WHERE contains(lower(line), 'whst') OR contains(lower(line), 'the of')
        UNION ALL SELECT 'German', * FROM c WHERE contains(lower(line), 'ver') OR contains(lower(line), 'ung'))
    SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY chunk_index, n) AS INTEGER) AS rank, chunk_index, substr(clean, 1, 200) AS evidence
    FROM t WHERE length(clean) > 20 QUALIFY rank <= 15""")
def topic_evidence(spark, sf):
    return evidence.topic_evidence(_summaries(spark, sf), LATIN_TOPICS)


_KW = """words AS (SELECT id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS keyword FROM (
        SELECT 'art-' || doc_id AS id, regexp_extract_all(string_split(text, chr(10))[1] || ' ' || text, '[A-Za-z가-힣]+(?:[.-]\\d+(?:\\.\\d+)?)?|\\d+\\.\\d+(?:\\.\\d+)?') AS ws FROM documents)),
    counted AS (SELECT id, keyword, count(*) AS freq, min(pos) AS first FROM words
        WHERE length(keyword) >= 2 AND lower(keyword) NOT IN ('the','and','or','a','an','is') GROUP BY id, keyword),
    kw AS (SELECT id, keyword FROM counted QUALIFY row_number() OVER (PARTITION BY id ORDER BY freq DESC, length(keyword) DESC, first) <= 8),"""


@query("keyword_snippets", given("messages", more=_KW + """
    hits AS (SELECT k.id, m.channel, m.ordinal, m.block FROM (SELECT id, list(lower(keyword)) AS ks FROM kw GROUP BY id) k, messages m
        WHERE len(list_filter(ks, lambda x: contains(lower(m.block), x))) > 0),
    joined AS (SELECT id, string_agg(block, chr(10) ORDER BY channel, ordinal) AS t FROM hits GROUP BY id)""") + """
    SELECT a.id, CASE WHEN length(t) > 6000 THEN substr(t, 1, 6000) || chr(10) || '... (truncated)' ELSE coalesce(t, '') END AS snippets,
           length(CASE WHEN length(t) > 6000 THEN substr(t, 1, 6000) || chr(10) || '... (truncated)' ELSE coalesce(t, '') END) AS snippets_len
    FROM (SELECT DISTINCT id FROM kw) a LEFT JOIN joined USING (id)""")
def keyword_snippets(spark, sf):
    keywords = evidence.top_keywords(b.articles(spark, sf), 8)
    return evidence.keyword_snippets(keywords, b.messages(spark, sf), 6_000)


# ---- model replies, written from the documents and read back ----

def _docs(spark, sf):
    return b.articles(spark, sf).select("id", "ord", "headline", "body", "category", "trust", "origin")


def _fence(json):
    """Plain, fenced, bare or broken, by document."""
    o = F.col("ord") % 5
    return (
        F.when(o == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(o == 2, F.concat(F.lit("Sure: "), json, F.lit(" done")))
        .when(o == 4, F.substring(json, 1, 12)).otherwise(json)
    )


@query("parse_article_replies", given("articles") + f"""
    SELECT id AS reply_id, trim(trim(headline, {TRIM}), '"''') AS headline, CASE WHEN ord % 2 = 0 THEN category ELSE 'rumor' END AS category, trust
    FROM articles WHERE ord % 5 <> 4 AND length(trim(trim(headline, {TRIM}), '"''')) > 4 AND length(trim(trim(body, {TRIM}), '"''')) > 40""")
def parse_article_replies(spark, sf):
    d = _docs(spark, sf)
    category = F.when(F.col("ord") % 2 == 0, F.col("category")).otherwise("gossip")
    one = F.struct("headline", "body", category.alias("category"), "trust")
    bare = F.concat(F.lit("["), F.to_json(one), F.lit(",]"))
    whole = F.to_json(F.struct(F.array(one).alias("articles")))
    raw = F.when(F.col("ord") % 5 == 3, bare).otherwise(_fence(whole))
    return replies.parse_article_replies(d.select(F.col("id").alias("reply_id"), raw.alias("raw")))[0].select(
        "reply_id", "headline", "category", "trust"
    )


@query("unparsed_article_replies", "SELECT 'art-' || doc_id AS reply_id FROM documents WHERE doc_id % 5 = 4")
def unparsed_article_replies(spark, sf):
    d = _docs(spark, sf)
    one = F.struct(F.lit("A long headline").alias("headline"), F.lit("x" * 50).alias("body"))
    whole = F.to_json(F.struct(F.when(F.col("ord") % 2 == 0, F.array(one)).otherwise(F.array().cast("array<struct<headline:string,body:string>>")).alias("articles")))
    raw = F.when(F.col("ord") % 5 == 3, F.lit('{"articles": []}')).otherwise(_fence(whole))
    return replies.parse_article_replies(d.select(F.col("id").alias("reply_id"), raw.alias("raw")))[1]


def _groups(spark, sf):
    """A placement reply per source and five documents."""
    d = _docs(spark, sf).withColumn("g", F.floor(F.col("ord") / 5).cast("bigint"))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "id")))), lambda x: x["id"])
    return d.groupBy("g").agg(
        F.max(F.when(F.col("ord") % 5 == 0, F.col("id"))).alias("top"), pick(F.col("ord") % 5 == 1).alias("main"), pick(F.col("ord") % 5 > 1).alias("side"),
    )


@query("parse_placement_replies", """
    SELECT CAST(doc_id // 5 AS VARCHAR) AS reply_id, CASE doc_id % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'main' ELSE 'side' END AS "group",
           CAST(CASE WHEN doc_id % 5 > 1 THEN doc_id % 5 - 2 ELSE 0 END AS INTEGER) AS pos, 'art-' || doc_id AS id
    FROM documents WHERE (doc_id // 5) % 4 <> 3""")
def parse_placement_replies(spark, sf):
    g = _groups(spark, sf)
    whole = F.to_json(F.struct("top", "main", "side"))
    listed = F.to_json(F.struct(F.array("top").alias("top"), "main", "side"))
    raw = F.when(F.col("g") % 4 == 3, F.lit("no idea")).when(F.col("g") % 4 == 2, listed).otherwise(F.concat(F.lit("```\n"), whole, F.lit("\n```")))
    rows, _ = replies.parse_placement_replies(g.select(F.col("g").cast("string").alias("reply_id"), raw.alias("raw")))
    return rows


@query("cluster_verdicts", """SELECT CAST(doc_id // 5 AS VARCHAR) AS reply_id, CAST(doc_id AS VARCHAR) AS ref FROM documents
    WHERE doc_id % 5 > 1 AND (doc_id // 5) % 4 <> 3""")
def cluster_verdicts(spark, sf):
    g = _groups(spark, sf)
    short = F.transform("side", lambda x: F.substring_index(x, "-", -1))
    raw = F.to_json(F.struct(F.array(F.struct(F.col("top").alias("keep"), short.alias("drop"))).alias("clusters")))
    raw = F.when(F.col("g") % 4 == 3, F.substring(raw, 1, 25)).otherwise(raw)
    return replies.parse_verdict_replies(g.select(F.col("g").cast("string").alias("reply_id"), raw.alias("raw")), "clusters")


@query("cross_verdicts", "SELECT CAST(doc_id // 5 AS VARCHAR) AS reply_id, doc_id AS number FROM documents WHERE doc_id % 5 > 1")
def cross_verdicts(spark, sf):
    g = _groups(spark, sf)
    marks = F.transform("side", lambda x: F.concat(F.lit("n00"), F.substring_index(x, "-", -1)))
    raw = F.to_json(F.struct(F.concat(marks, F.array(F.lit("E1"), F.lit("N0"))).alias("drop_new")))
    return replies.parse_verdict_replies(g.select(F.col("g").cast("string").alias("reply_id"), raw.alias("raw")), "cross")


@query("parse_merge_replies", """SELECT CAST(doc_id // 5 AS VARCHAR) AS reply_id, 'art-' || (doc_id // 5 * 5) AS merged,
    text AS body FROM documents WHERE doc_id % 5 = 1""")
def parse_merge_replies(spark, sf):
    rows = _merge_replies(spark, sf)[0]
    return rows.select("reply_id", F.array_join("merged_from", ",").alias("merged"), "body")


@query("merge_discards", "SELECT CAST(doc_id // 5 AS VARCHAR) AS reply_id, 'art-' || doc_id AS ref FROM documents WHERE doc_id % 5 > 1")
def merge_discards(spark, sf):
    return _merge_replies(spark, sf)[1].select("reply_id", "ref")


def _merge_replies(spark, sf):
    """Merge replies; every second one has a broken tail and is salvaged."""
    d = _docs(spark, sf)
    bodies = d.where("ord % 5 = 1").select(F.floor(F.col("ord") / 5).cast("bigint").alias("g"), "headline", "body")
    g = _groups(spark, sf).join(bodies, "g")
    final = F.struct("headline", "body", F.array("top").alias("merged_from"))
    raw = F.to_json(F.struct(F.array(final).alias("final"), F.col("side").alias("discard")))
    raw = F.when(F.col("g") % 2 == 1, F.concat(raw, F.lit(', "note": }'))).otherwise(raw)
    return replies.parse_merge_replies(g.select(F.col("g").cast("string").alias("reply_id"), raw.alias("raw")))


@query("parse_summary_replies", given("articles") + f"""
    SELECT id AS reply_id, CASE WHEN ord % 3 = 2 THEN '' ELSE origin END AS title,
           CASE WHEN ord % 3 = 2 THEN 'plain text' ELSE trim(body, {TRIM}) END AS body,
           CASE WHEN ord % 3 = 2 THEN false ELSE length(trim(body, {TRIM})) >= 40 END AS usable FROM articles""")
def parse_summary_replies(spark, sf):
    d = _docs(spark, sf)
    full = F.to_json(F.struct(F.col("origin").alias("title"), "body"))
    alt = F.to_json(F.struct(F.col("origin").alias("title"), F.col("body").alias("summary")))
    raw = F.when(F.col("ord") % 3 == 0, full).when(F.col("ord") % 3 == 1, alt).otherwise("plain text ")
    return replies.parse_summary_replies(d.select(F.col("id").alias("reply_id"), raw.alias("raw")))


@query("parse_tag_replies", given("articles") + """
    SELECT CAST(ord // 5 AS VARCHAR) AS reply_id, id, category, CASE WHEN ord % 2 = 0 THEN trust ELSE 'low' END AS trust FROM articles""")
def parse_tag_replies(spark, sf):
    d = _docs(spark, sf).withColumn("g", F.floor(F.col("ord") / 5).cast("string"))
    tag = F.struct("id", F.upper("category").alias("category"), F.when(F.col("ord") % 2 == 0, F.col("trust")).otherwise("sure").alias("trust"))
    g = d.groupBy("g").agg(F.to_json(F.struct(F.collect_list(tag).alias("tags"))).alias("raw"))
    return replies.parse_tag_replies(g.select(F.col("g").alias("reply_id"), "raw"))


@query("parse_grounding_replies", given("articles") + """
    SELECT id AS reply_id, CASE WHEN ord % 5 = 4 THEN 'parse_error' ELSE category END AS verdict,
           CASE WHEN ord % 5 = 4 THEN 0.0 ELSE ord % 10 / 10.0 END AS confidence, CASE WHEN ord % 5 = 4 THEN '' ELSE headline END AS evidence_quote
    FROM articles""")
def parse_grounding_replies(spark, sf):
    d = _docs(spark, sf)
    whole = F.to_json(F.struct(
        F.col("category").alias("verdict"), (F.col("ord") % 10 / 10).alias("confidence"), F.col("headline").alias("evidence_quote"), F.lit("r").alias("reason")
    ))
    out = replies.parse_grounding_replies(d.select(F.col("id").alias("reply_id"), _fence(whole).alias("raw")))
    return out.select("reply_id", "verdict", "confidence", "evidence_quote")


@query("parse_titled_sections", given("messages") + f"""
    SELECT channel || '-' || ordinal AS reply_id, author || ' message' AS headline, trim(trim(content, {TRIM}), '"''*') AS body
    FROM messages WHERE length(trim(trim(content, {TRIM}), '"''*')) > 50""")
def parse_titled_sections(spark, sf):
    m = b.messages(spark, sf)
    raw = F.concat(F.lit("제목: *"), "author", F.lit(" message*\n\n본문: "), "content", F.lit("\n제목: kurz\n본문: zu kurz"))
    rows = replies.parse_titled_sections(m.select(F.concat("channel", F.lit("-"), F.col("ordinal").cast("string")).alias("reply_id"), raw.alias("raw")), "oneshot")
    return rows.select("reply_id", "headline", "body")


@query("parse_numbered_titles", given("articles") + """
    SELECT id AS reply_id, CASE WHEN ord % 2 = 0 THEN '초안 제목입니다 하나 둘 ' || ord ELSE '번호 제목입니다 하나 둘 ' || ord END AS title FROM articles""")
def parse_numbered_titles(spark, sf):
    d = _docs(spark, sf)
    number = F.col("ord").cast("string")
    numbered = F.concat(F.lit("1. 번호 제목입니다 하나 둘 "), number, F.lit("\n2) 짧다\n3. English only title here\n1. 번호 제목입니다 하나 둘 "), number)
    draft = F.concat(F.lit("*Draft 1 (a):* \"초안 제목입니다 하나 둘 "), number, F.lit("\" (Reflects the whole topic)\n"))
    raw = F.when(F.col("ord") % 2 == 0, F.concat(draft, numbered)).otherwise(numbered)
    return replies.parse_numbered_titles(d.select(F.col("id").alias("reply_id"), raw.alias("raw"))).select("reply_id", "title")


@query("annotate", "SELECT doc_id, length(text) AS score FROM documents")
def annotate(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    return chunking.annotate(d, lambda batch: batch.assign(score=batch["text"].str.len())[["doc_id", "score"]], "doc_id bigint, score bigint")
