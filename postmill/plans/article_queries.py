"""Queries on articles: cleaning, duplicates, rules, placement and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.functions import times
from postmill.operators import (
    aggregates,
    anchors,
    dedup,
    evidence,
    filters,
    guards,
    lookups,
    merges,
    numbering,
    placement,
    ranking,
    search,
    validate,
)
from postmill.plans import bindings as b
from postmill.plans.registry import given, query, tokens_sql
from postmill.session import shared_folder
from postmill.sources import state
from postmill.sources.term_store import merge_into_index, open_index

A = given("articles")
AS_OF = "TIMESTAMP '2024-02-01 09:00:00'"

# Latin stand-ins for the fixed rules, so that the synthetic texts match them.
LATIN_CLAIMS = guards.ClaimRules(
    name=r"\b(?:Enunge|Thorreou|Reinheon|Elle|Des)\b", verb=r"(?:tion|ment)", source=r"(?:https?://|license)",
    soften_headline=[("tion", "claim")], soften_body=[("mentation", "hint"), ("ment", "claim")],
    headline_marks=["Unconfirmed:", "Rumour:"], headline_prefix="Unconfirmed: ", body_prefix="No official source. ",
)
LATIN_STORIES = guards.StoryRules(
    products={"elle": r"\belle\b", "the-of": r"\bthe of\b"}, verb=r"(?:tion|ment)", followup=r"(?:avec|whst)", prefix="Follow-up: ",
)


def _arts(spark, sf):
    return b.articles(spark, sf)


# ---- text ----

@query("title_tokens", A + f"SELECT id, array_to_string({tokens_sql('headline')}, '|') AS tokens FROM articles")
def title_tokens(spark, sf):
    return _arts(spark, sf).select("id", F.array_join(F.array_sort(tx.title_tokens("headline")), "|").alias("tokens"))


@query("preview_excerpt", A + """,
    e AS (SELECT id, body, string_split(replace(regexp_replace(body, '^\\*+\\s*', ''), '**', ''), chr(10))[1] AS line FROM articles)
    SELECT id, replace(substr(body, 1, 250), chr(10), ' ') AS preview,
           CASE WHEN length(line) > 140 THEN trim(substr(line, 1, 140), ' ' || chr(9) || chr(13)) || '…' ELSE line END AS excerpt,
           array_to_string(list_filter(list_transform(string_split(replace(body, '**', ''), chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(13))), lambda p: p <> ''), '|') AS paragraphs
    FROM e""")
def preview_excerpt(spark, sf):
    return _arts(spark, sf).select(
        "id", tx.preview("body", 250).alias("preview"), tx.excerpt("body").alias("excerpt"),
        F.array_join(tx.paragraphs("body"), "|").alias("paragraphs"),
    )


@query("strip_html", """SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages""")
def strip_html(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.strip_html("html").alias("text"))


@query("keep_script_lines", A + """,
    lines AS (SELECT id, body, list_filter(string_split(body, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(13))) > 15
        AND length(regexp_replace(x, '[^e-t]', '', 'g')) / greatest(length(trim(x, ' ' || chr(9) || chr(13))), 1) > 0.5) AS ls FROM articles),
    cleaned AS (SELECT id, body, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '^\\s*[*\\-]\\s*', ''), ' ' || chr(9) || chr(13))),
        lambda x: NOT contains(lower(x), 'avec') AND NOT starts_with(x, 'Das')) AS ls FROM lines)
    SELECT id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE body END AS text FROM cleaned""")
def keep_script_lines(spark, sf):
    kept = tx.keep_script_lines("body", "e-t", 15, 0.5, drop_phrases=["avec"], drop_prefixes=["Das"])
    return _arts(spark, sf).select("id", kept.alias("text"))


@query("text_functions", A + """
    SELECT id, CAST(floor(length(body) / 3.5) AS BIGINT) AS tokens,
           coalesce(try_cast(CASE WHEN ord % 3 = 0 THEN CAST(ord AS VARCHAR) ELSE 'x' || ord END AS INTEGER), 0) AS safe,
           coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim('★ ' || origin || ': ' || lang), '^[^0-9A-Za-z가-힣]+', ''), '\\s+', '_', 'g'),
               '[\\\\/:*?"<>|]+', '_', 'g'), ''), 'none') AS slug,
           regexp_replace(lower(headline), '[^\\p{L}\\p{N}_]+', '', 'g') AS folded
    FROM articles""")
def text_functions(spark, sf):
    line = F.concat(F.lit("Guild / ★ "), "origin", F.lit(": "), "lang")
    return _arts(spark, sf).select(
        "id", tx.token_estimate("body").alias("tokens"),
        tx.safe_int(F.when(F.col("ord") % 3 == 0, F.col("ord").cast("string")).otherwise(F.concat(F.lit("x"), F.col("ord").cast("string")))).alias("safe"),
        tx.channel_slug(line, "none").alias("slug"), tx.fold_title("headline").alias("folded"),
    )


@query("relevance_filter", A + """SELECT id FROM articles
    WHERE contains(lower(headline || ' ' || origin), 'avec') OR contains(lower(headline || ' ' || origin), 'src7')""")
def relevance_filter(spark, sf):
    return filters.relevance_filter(_arts(spark, sf), ["headline", "origin"], ["AVEC", "src7"]).select("id")


@query("top_keywords", A + """,
    words AS (SELECT id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS keyword FROM (
        SELECT id, regexp_extract_all(headline || ' ' || body, '[A-Za-z가-힣]+(?:[.-]\\d+(?:\\.\\d+)?)?|\\d+\\.\\d+(?:\\.\\d+)?') AS ws FROM articles)),
    counted AS (SELECT id, keyword, count(*) AS freq, min(pos) AS first FROM words
        WHERE length(keyword) >= 2 AND lower(keyword) NOT IN ('the','and','or','a','an','is') GROUP BY id, keyword)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY freq DESC, length(keyword) DESC, first) AS INTEGER) AS rank, keyword, freq
    FROM counted QUALIFY rank <= 8""")
def top_keywords(spark, sf):
    return evidence.top_keywords(_arts(spark, sf), 8)


# ---- duplicates ----

@query("exact_title_dedup", A + """
    SELECT id, ord FROM articles
    QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(headline), '[^\\p{L}\\p{N}_]+', '', 'g') ORDER BY ord) = 1""")
def exact_title_dedup(spark, sf):
    return dedup.exact_title_dedup(_arts(spark, sf)).select("id", "ord")


_SETS = ", tok AS (SELECT *, " + tokens_sql("headline") + """ AS tokens FROM articles),
    sets AS (SELECT tokens, arg_min(id, ord) AS id, count(*) AS copies FROM tok WHERE len(tokens) > 0 GROUP BY tokens),
    pairs AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, len(list_intersect(a.tokens, b.tokens)) AS common,
                     len(a.tokens) + len(b.tokens) AS total, CASE WHEN a.id < b.id THEN a.copies ELSE b.copies END AS n_a,
                     CASE WHEN a.id < b.id THEN b.copies ELSE a.copies END AS n_b
              FROM sets a JOIN sets b ON a.id < b.id)"""


@query("title_similarity_pairs", A + _SETS + """
    SELECT id_a, id_b, common / (total - common) AS similarity, n_a, n_b FROM pairs WHERE common / (total - common) >= 0.4
    UNION ALL SELECT id, id, 1.0, copies, copies FROM sets WHERE copies > 1""")
def title_similarity_pairs(spark, sf):
    return dedup.title_similarity_pairs(_arts(spark, sf), 0.4)


@query("near_dup_dedup", given("articles", recursive=True, more="tok AS (SELECT *, " + tokens_sql("headline") + """ AS tokens FROM articles),
    sets AS (SELECT tokens, arg_min(id, (-length(body), ord)) AS id, min((-length(body), ord)) AS place FROM tok WHERE len(tokens) > 0 GROUP BY tokens),
    n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY place) AS i FROM sets),
    edges AS MATERIALIZED (SELECT b.i, list(a.i) AS earlier FROM n a JOIN n b ON a.i < b.i
        AND len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) >= 0.4 GROUP BY b.i),
    walk(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
        SELECT w.i + 1, CASE WHEN e.earlier IS NOT NULL AND list_has_any(e.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, w.i + 1) END
        FROM walk w LEFT JOIN edges e ON e.i = w.i + 1 WHERE w.i < (SELECT max(i) FROM n))""") + """
    SELECT id, row_number() OVER (ORDER BY length(body) DESC, ord) - 1 AS place FROM tok WHERE len(tokens) = 0
        OR id IN (SELECT id FROM n WHERE i IN (SELECT unnest(kept) FROM walk WHERE i = (SELECT max(i) FROM n)))""")
def near_dup_dedup(spark, sf):
    kept = dedup.near_dup_dedup(_arts(spark, sf), 0.4)
    return dedup.longest_first(kept).select("id", F.col("ord").alias("place"))


# ---- rules ----

_CLAIM = """regexp_matches(headline || chr(10) || body, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:Enunge|Thorreou|Reinheon|Elle|Des)(?:$|[^\\p{L}\\p{N}_])')
    AND regexp_matches(headline || chr(10) || body, '(?i)(?:tion|ment)') AND NOT regexp_matches(headline || chr(10) || body, '(?i)(?:https?://|license)')"""


@query("downgrade_unsourced_claims", given("articles", more="""trimmed AS (SELECT * EXCLUDE (headline, body),
        trim(headline, ' ' || chr(9) || chr(10) || chr(13)) AS headline, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS body, headline AS h0, body AS b0 FROM articles),
    judged AS (SELECT *, """ + _CLAIM + """ AS claim FROM trimmed)""") + """
    SELECT id, CASE WHEN claim THEN 'Unconfirmed: ' || replace(headline, 'tion', 'claim') ELSE h0 END AS headline,
           CASE WHEN claim THEN 'No official source. ' || replace(replace(body, 'mentation', 'hint'), 'ment', 'claim') ELSE b0 END AS body,
           CASE WHEN claim THEN 'rumor' ELSE category END AS category, CASE WHEN claim THEN 'low' ELSE trust END AS trust FROM judged""")
def downgrade_unsourced_claims(spark, sf):
    out = guards.downgrade_unsourced_claims(_arts(spark, sf), LATIN_CLAIMS)
    return out.select("id", "headline", "body", "category", "trust")


_GUARD = given("articles", more="""texts AS (SELECT *, headline || chr(10) || body AS t, category = 'rumor' AND trust = 'low' AS weak FROM articles),
    covered AS (SELECT coalesce(bool_or(regexp_matches(t, '(?i)(?:^|[^\\p{L}\\p{N}_])elle(?:$|[^\\p{L}\\p{N}_])')), false) AS c1, coalesce(bool_or(regexp_matches(t, '(?i)(?:^|[^\\p{L}\\p{N}_])the of(?:$|[^\\p{L}\\p{N}_])')), false) AS c2
        FROM texts WHERE ord % 5 <> 0 AND NOT weak AND regexp_matches(t, '(?i)(?:tion|ment)')),
    judged AS (SELECT *, (c1 AND regexp_matches(t, '(?i)(?:^|[^\\p{L}\\p{N}_])elle(?:$|[^\\p{L}\\p{N}_])')) OR (c2 AND regexp_matches(t, '(?i)(?:^|[^\\p{L}\\p{N}_])the of(?:$|[^\\p{L}\\p{N}_])')) AS known,
        regexp_matches(t, '(?i)(?:tion|ment)') AND NOT regexp_matches(t, '(?i)(?:avec|whst)') AS repeated FROM texts, covered WHERE ord % 5 = 0)""")


@query("product_story_guard", _GUARD + """
    SELECT id, CASE WHEN known THEN 'Follow-up: ' || headline ELSE headline END AS headline FROM judged WHERE NOT (known AND repeated)""")
def product_story_guard(spark, sf):
    a = _arts(spark, sf)
    return guards.product_story_guard(a.where(b.is_new()), a.where(~b.is_new()), LATIN_STORIES)[0].select("id", "headline")


@query("product_story_drops", _GUARD + "SELECT id FROM judged WHERE known AND repeated")
def product_story_drops(spark, sf):
    a = _arts(spark, sf)
    return guards.product_story_guard(a.where(b.is_new()), a.where(~b.is_new()), LATIN_STORIES)[1]


@query("weak_articles", A + "SELECT id FROM articles WHERE category = 'rumor' AND trust = 'low'")
def weak_articles(spark, sf):
    return _arts(spark, sf).where(guards.is_weak()).select("id")


# ---- views and orders ----

@query("archive_view", A + "SELECT id, created_at FROM articles WHERE placement = 'main'")
def archive_view(spark, sf):
    return ranking.archive_view(_arts(spark, sf), "main").select("id", "created_at")


@query("archive_order", A + "SELECT id, row_number() OVER (ORDER BY created_at DESC, ord) AS place FROM articles")
def archive_order(spark, sf):
    return ranking.archive_places(_arts(spark, sf)).select("id", "place")


@query("side_order", A + "SELECT id, created_at FROM articles WHERE placement = 'side'")
def side_order(spark, sf):
    return ranking.side_order(_arts(spark, sf).where("placement = 'side'")).select("id", "created_at")


@query("recent_titles", A + "SELECT id, headline FROM articles ORDER BY created_at DESC, ord LIMIT 20")
def recent_titles(spark, sf):
    return ranking.recent_titles(_arts(spark, sf), 20)


@query("date_dividers", A + """,
    views AS (SELECT 'all' AS view, * FROM articles UNION ALL SELECT placement, * FROM articles WHERE placement IS NOT NULL),
    days AS (SELECT *, strftime(created_at + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM views)
    SELECT view, id, day, coalesce(lag(day) OVER (PARTITION BY view ORDER BY created_at DESC, ord) <> day, true) AS divider FROM days""")
def date_dividers(spark, sf):
    return placement.date_dividers(_arts(spark, sf)).select("view", "id", F.col("day").cast("string").alias("day"), "divider")


@query("select_targets", A + "SELECT id FROM articles WHERE id LIKE '%62' OR id LIKE '%111' OR id = 'art-7'")
def select_targets(spark, sf):
    return filters.select_targets(_arts(spark, sf), ["62", "111", "art-7"]).select("id")


@query("select_by_placement", A + "SELECT id FROM articles WHERE placement = 'side'")
def select_by_placement(spark, sf):
    return filters.select_targets(_arts(spark, sf), placement="side").select("id")


@query("label_counts", A + "SELECT placement AS label, count(*) AS n FROM articles GROUP BY placement")
def label_counts(spark, sf):
    return aggregates.label_counts(_arts(spark, sf), "placement")


@query("label_counts_wide", A + """SELECT count(*) FILTER (WHERE placement = 'top') AS top, count(*) FILTER (WHERE placement = 'main') AS main,
    count(*) FILTER (WHERE placement = 'side') AS side FROM articles""")
def label_counts_wide(spark, sf):
    return aggregates.label_counts_wide(_arts(spark, sf), "placement", ["top", "main", "side"])


# ---- stored rows, logs and state ----

@query("articles_to_rows", A + """
    SELECT id, 'mill' AS source, trim(headline, ' ' || chr(9) || chr(10) || chr(13)) AS title, created_at,
           array_to_string(list_filter([category, trust, placement], lambda x: x IS NOT NULL), '|') AS tags,
           TIMESTAMP '2024-02-01 09:00:00' AS generated_at, TIMESTAMP '2024-02-01 09:30:00' AS updated_at FROM articles WHERE ord % 6 <> 0""")
def articles_to_rows(spark, sf):
    a = _arts(spark, sf).withColumn("id", F.when(F.col("ord") % 6 == 0, " ").otherwise(F.col("id")))
    a = a.withColumn("created_at", F.when(F.col("ord") % 2 == 0, F.col("created_at")))
    rows, _ = validate.articles_to_rows(a, b.ntz(b.NOW), "mill", b.ntz("2024-02-01 09:30:00"))
    return rows.select("id", "source", "title", "created_at", F.array_join("tags", "|").alias("tags"), "generated_at", "updated_at")


@query("articles_without_id", "SELECT doc_id AS ord FROM documents WHERE doc_id % 6 = 0")
def articles_without_id(spark, sf):
    a = _arts(spark, sf).withColumn("id", F.when(F.col("ord") % 6 == 0, " ").otherwise(F.col("id")))
    return validate.articles_to_rows(a, b.ntz(b.NOW), "mill")[1].select("ord")


@query("derive_tags", A + """
    SELECT id, CASE WHEN ord % 4 = 0 THEN origin ELSE array_to_string(list_filter([category, trust, placement], lambda x: x IS NOT NULL), '|') END AS tags FROM articles""")
def derive_tags(spark, sf):
    a = _arts(spark, sf).withColumn("tags", F.when(F.col("ord") % 4 == 0, F.array("origin")))
    return a.select("id", F.array_join(validate.derive_tags(a), "|").alias("tags"))


@query("published", given("publog") + "SELECT article_id FROM publog WHERE platform = 'discord'")
def published(spark, sf):
    return filters.published(b.publish_log(spark, sf), "discord").select("article_id")


@query("is_published", given("articles", "publog") + "SELECT id FROM articles WHERE id IN (SELECT article_id FROM publog WHERE platform = 'github_pages')")
def is_published(spark, sf):
    return filters.is_published(_arts(spark, sf), b.publish_log(spark, sf), "github_pages").select("id")


@query("unpublished", given("articles", "publog") + "SELECT id FROM articles WHERE id NOT IN (SELECT article_id FROM publog WHERE platform = 'github_pages')")
def unpublished(spark, sf):
    return lookups.unpublished(_arts(spark, sf), b.publish_log(spark, sf), "github_pages").select("id")


@query("referential_cleanup", given("articles", "publog") + """
    SELECT article_id, platform FROM publog WHERE article_id IN (SELECT id FROM articles WHERE ord % 3 <> 0)""")
def referential_cleanup(spark, sf):
    return merges.referential_cleanup(b.publish_log(spark, sf), _arts(spark, sf).where("ord % 3 <> 0")).select("article_id", "platform")


@query("decision_log_retention", given("runs") + """
    SELECT run_no, started_at AS run_at FROM runs WHERE started_at > TIMESTAMP '1998-06-01 02:00:00' - INTERVAL 3 HOUR
    UNION ALL SELECT -1, TIMESTAMP '1998-06-01 02:00:00'""")
def decision_log_retention(spark, sf):
    log = b.runs(spark, sf).select("run_no", F.col("started_at").alias("run_at"))
    now = "1998-06-01 02:00:00"
    current = log.agg(F.lit(-1).cast("bigint").alias("run_no"), b.ntz(now).alias("run_at"))
    return filters.decision_log_retention(log, now, current)


@query("decision_placements", given("runs", "articles") + """
    SELECT started_at AS run_at, CAST(run_no AS VARCHAR) AS id, status AS placement FROM runs WHERE started_at > TIMESTAMP '1998-06-01 02:00:00' - INTERVAL 3 HOUR
    UNION ALL SELECT TIMESTAMP '1998-06-01 02:00:00', id, coalesce(placement, 'side') FROM articles""")
def decision_placements(spark, sf):
    """The placements of the log, one row each: those of the kept runs and all of the current one."""
    log = b.runs(spark, sf).select(F.col("started_at").alias("run_at"), F.col("run_no").cast("string").alias("id"), F.col("status").alias("placement"))
    now = "1998-06-01 02:00:00"
    current = placement.placement_log(_arts(spark, sf).withColumn("placement", F.coalesce("placement", F.lit("side"))), b.ntz(now))
    return filters.decision_log_retention(log, now, current)


@query("save_public_state", A + """
    SELECT id, CASE WHEN ord % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM articles WHERE ord % 5 = 0 OR ord % 2 = 0""")
def save_public_state(spark, sf):
    a = _arts(spark, sf)
    row = lambda df, v: df.select("id", F.lit(v).alias("version"), F.lit(v).alias("generated_at"), F.col("ord").alias("raw_json"))
    doc = a.where(b.is_new()).agg(F.lit("public_state").alias("key"), F.count(F.lit(1)).cast("string").alias("value"), F.max("created_at").alias("updated_at"))
    _, stored = merges.save_public_state(doc.limit(0), row(a.where("ord % 2 = 0"), "old"), doc, row(a.where(b.is_new()), "new"))
    return stored.select("id", "version")


@query("pipeline_state", A + "SELECT 'public_state' AS key, CAST(count(*) AS VARCHAR) AS value FROM articles WHERE ord % 5 = 0")
def pipeline_state(spark, sf):
    a = _arts(spark, sf)
    row = lambda df, v: df.select("id", F.lit(v).alias("version"), F.lit(v).alias("generated_at"), F.col("ord").alias("raw_json"))
    doc = a.where(b.is_new()).agg(F.lit("public_state").alias("key"), F.count(F.lit(1)).cast("string").alias("value"), F.max("created_at").alias("updated_at"))
    old = doc.withColumn("value", F.lit("before"))
    kept, _ = merges.save_public_state(old, row(a, "old"), doc, row(a.where(b.is_new()), "new"))
    return kept.select("key", "value")


@query("advance_mark", "SELECT 'last_run_at' AS key, '2024-02-01 09:00:00' AS value UNION ALL SELECT DISTINCT source, source FROM documents")
def advance_mark(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("source").alias("value"), b.ntz(b.NOW).alias("updated_at")).distinct()
    return filters.advance_mark(d, b.NOW).select("key", "value")


@query("migrate_state_v1", A + """
    SELECT CASE WHEN rn % 3 = 0 THEN 'legacy-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(3, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') ELSE id END AS id, headline, lang AS doc
    FROM (SELECT *, row_number() OVER (PARTITION BY ord // 50, lang ORDER BY ord) AS rn FROM articles)""")
def migrate_state_v1(spark, sf):
    a = _arts(spark, sf)
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "headline", "body"))), lambda x: F.struct(x["id"].alias("id"), x["headline"].alias("headline"), x["body"].alias("body")))
    docs = a.groupBy(F.floor(F.col("ord") / 50), "lang").agg(items.alias("raw")).select(
        "lang", F.lit(1).alias("schema_version"), F.lit("2024-01-05T00:00:00Z").alias("generated_at"),
        F.struct(F.lit("2024-01-01").alias("start"), F.lit("2024-01-05T00:00:00Z").alias("end")).alias("period"),
        F.transform("raw", lambda x, i: F.struct(F.when((i + 1) % 3 != 0, x["id"]).alias("id"), x["headline"].alias("headline"), x["body"].alias("body"))).alias("articles"),
    )
    _, rows = state.migrate_state_v1(docs, keep=["lang"])
    return rows.select("id", "headline", F.col("lang").alias("doc"))


# ---- joins ----

@query("restore_missing", A + """
    SELECT id, CASE WHEN ord % 2 = 0 THEN created_at ELSE """ + AS_OF + """ END AS created_at FROM articles
    WHERE headline NOT IN (SELECT headline FROM articles WHERE ord % 5 <> 0)""")
def restore_missing(spark, sf):
    a = _arts(spark, sf)
    cache = a.withColumn("created_at", F.when(F.col("ord") % 2 == 0, F.col("created_at")))
    return lookups.restore_missing(cache, a.where(~b.is_new()), b.ntz(b.NOW)).select("id", "created_at")


@query("apply_drops", A + "SELECT id FROM articles WHERE ord % 4 <> 1")
def apply_drops(spark, sf):
    a = _arts(spark, sf)
    return lookups.apply_drops(a, a.where("ord % 4 = 1").select("id"))[0].select("id")


@query("dropped_ids", A + "SELECT id FROM articles WHERE ord % 4 = 1")
def dropped_ids(spark, sf):
    a = _arts(spark, sf)
    return lookups.apply_drops(a, a.where("ord % 4 = 1").select("id"))[1]


@query("apply_placements", A + """,
    given AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 'main' WHEN ord % 3 = 1 THEN 'top' ELSE 'side' END AS p FROM articles)
    SELECT id, p AS placement, CASE WHEN placement <> p THEN """ + AS_OF + """ ELSE placed_at END AS placed_at FROM given""")
def apply_placements(spark, sf):
    a = _arts(spark, sf)
    given_rows = a.where("ord % 3 < 2").select("id", F.when(F.col("ord") % 3 == 0, "main").otherwise("top").alias("placement"))
    return lookups.apply_placements(a, given_rows, b.ntz(b.NOW)).select("id", "placement", "placed_at")


@query("apply_tags", """SELECT 'art-' || doc_id AS id, CASE WHEN toxic = 0 THEN 'news' ELSE 'rumor' END AS category,
    CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS trust FROM documents LEFT JOIN labels USING (doc_id)""")
def apply_tags(spark, sf):
    tags = b.table(spark, sf, "labels").select(
        F.concat(F.lit("art-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("toxic") == 1, "rumor").otherwise("news").alias("category"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("trust"),
    )
    return lookups.apply_tags(_arts(spark, sf), tags).select("id", "category", "trust")


def _refs(spark, sf):
    """Articles of two runs that share short ids, and refs to them. Numbers have four digits at least; longer ones stay whole."""
    a = _arts(spark, sf)
    o = F.col("ord")
    digits = o.cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    full = a.select("ord", F.concat(F.lit("art-2024-"), number).alias("id"))
    extra = a.where("ord % 10 = 0").select("ord", F.concat(F.lit("art-2023-"), number).alias("id"))
    refs = a.select(
        F.col("origin").alias("reply_id"), o.alias("pos"),
        F.when(o % 4 == 0, F.concat(F.lit(' "'), number, F.lit('" '))).when(o % 4 == 1, o.cast("string"))
        .when(o % 4 == 2, F.concat(F.lit("art-2024-"), number)).otherwise(F.concat(F.lit("x"), number)).alias("ref"),
    )
    return refs, full.unionByName(extra).select("id")


@query("resolve_short_ids", A + """
    SELECT origin AS reply_id, ord AS pos, 'art-2024-' || lpad(CAST(ord AS VARCHAR), 4, '0') AS id
    FROM articles WHERE ord % 4 = 2 OR (ord % 4 < 2 AND ord % 10 <> 0)""")
def resolve_short_ids(spark, sf):
    return lookups.resolve_short_ids(*_refs(spark, sf))[0]


@query("ambiguous_short_ids", A + "SELECT origin AS reply_id, ord AS pos FROM articles WHERE ord % 4 < 2 AND ord % 10 = 0")
def ambiguous_short_ids(spark, sf):
    return lookups.resolve_short_ids(*_refs(spark, sf))[1].select("reply_id", "pos")


def _finals(spark, sf):
    """Every block of eight articles merges into three finals with overlapping sources."""
    a = _arts(spark, sf).withColumn("grp", F.floor(F.col("ord") / 8).cast("bigint"))
    slot = F.array(F.lit(1), F.lit(2), F.lit(3))
    spread = a.withColumn("f", F.explode(slot)).where("(ord % 8) % 4 <> f")
    grouped = spread.groupBy("grp", "f").agg(F.array_sort(F.collect_list("ord")).alias("ords"))
    return grouped.select(
        F.col("grp").alias("run_id"), F.col("f").cast("bigint").alias("final_no"), F.concat(F.lit("h"), F.col("f").cast("string")).alias("headline"),
        F.lit("body").alias("body"), F.transform("ords", lambda o: F.concat(F.lit("art-"), o.cast("string"))).alias("merged_from"),
        F.concat(F.col("grp").cast("string"), F.lit("-"), F.col("f").cast("string")).alias("final_id"),
    ), a


_FINALS = given("articles", more="""spread AS (SELECT ord // 8 AS grp, f, ord, id, created_at FROM articles, (SELECT unnest([1, 2, 3]) AS f) WHERE (ord % 8) % 4 <> f)""")


@query("merge_lineage", _FINALS + """
    SELECT grp || '-' || f AS final_id, max(created_at) FILTER (WHERE ord % 9 <> 0) AS created_at,
           count(*) FILTER (WHERE ord % 9 <> 0) AS n_sources FROM spread GROUP BY grp, f""")
def merge_lineage(spark, sf):
    finals, a = _finals(spark, sf)
    return lookups.merge_lineage(finals, a.where("ord % 9 <> 0")).select("final_id", "created_at", "n_sources")


@query("merge_anchor", given("articles", recursive=True, more="""spread AS (SELECT ord // 8 AS grp, f, ord, id, created_at FROM articles, (SELECT unnest([1, 2, 3]) AS f) WHERE (ord % 8) % 4 <> f),
    step(grp, f, taken, anchor) AS (
        SELECT DISTINCT grp, 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM spread
        UNION ALL
        SELECT s.grp, s.f + 1, CASE WHEN x.o IS NULL THEN s.taken ELSE list_append(s.taken, x.o) END, x.o
        FROM step s, LATERAL (SELECT min(p.ord) AS o FROM spread p WHERE p.grp = s.grp AND p.f = s.f + 1 AND p.ord % 3 = 0 AND NOT list_contains(s.taken, p.ord)) x
        WHERE s.f < 3),
    newest AS (SELECT grp, f, max(created_at) AS created_at FROM spread GROUP BY grp, f)""") + """
    SELECT grp AS run_id, CAST(f AS BIGINT) AS final_no, coalesce('art-' || anchor, 'art-202402010900-m0' || f) AS id,
           CASE WHEN anchor IS NULL THEN n.created_at ELSE TIMESTAMP '2024-01-01' + to_minutes(CAST(anchor % 500000 * 7 AS INTEGER)) END AS created_at
    FROM step JOIN newest n USING (grp, f) WHERE f > 0""")
def merge_anchor(spark, sf):
    finals, a = _finals(spark, sf)
    out = anchors.merge_anchor(finals.drop("final_id"), a, a.where("ord % 3 = 0"), b.ntz(b.NOW))
    return out.select("run_id", "final_no", "id", "created_at")


@query("coverage_gap", A + "SELECT id FROM articles WHERE ord % 3 <> 0 AND ord % 7 <> 0")
def coverage_gap(spark, sf):
    a = _arts(spark, sf)
    return lookups.coverage_gap(a, a.where("ord % 3 = 0"), a.where("ord % 7 = 0")).select("id")


@query("split_existing_new", A + "SELECT id, ord % 5 <> 0 AS existing FROM articles")
def split_existing_new(spark, sf):
    a = _arts(spark, sf)
    old, new = lookups.split_existing_new(a, a.where(~b.is_new()))
    return old.select("id", F.lit(True).alias("existing")).unionByName(new.select("id", F.lit(False).alias("existing")))


@query("union_unique_by_id", A + """
    SELECT id, CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM articles WHERE ord % 2 = 0 OR ord % 3 = 0""")
def union_unique_by_id(spark, sf):
    a = _arts(spark, sf).select("id", "ord")
    left = a.where("ord % 2 = 0").withColumn("side", F.lit("a"))
    right = a.where("ord % 3 = 0").withColumn("side", F.lit("b"))
    return merges.union_unique_by_id(left, right).select("id", "side")


@query("merge_report", _FINALS + """,
    mentions AS (SELECT DISTINCT f AS round, id FROM spread WHERE ord % 5 <> 0 AND ord % 3 = f - 1),
    discards AS (SELECT DISTINCT f AS round, id FROM spread WHERE ord % 5 = 0 AND ord % 2 = 0),
    settled AS (SELECT min(round) AS round, id FROM (SELECT * FROM mentions UNION ALL SELECT * FROM discards) GROUP BY id)
    SELECT r.f AS round, (SELECT count(*) FROM articles) - (SELECT count(*) FROM settled s WHERE s.round < r.f) AS candidate_count,
           count(DISTINCT r.grp) AS new_finals, (SELECT count(*) FROM discards d WHERE d.round = r.f) AS new_discards
    FROM spread r GROUP BY r.f""")
def merge_report(spark, sf):
    return _merge_report(spark, sf)[0]


@query("merge_report_totals", _FINALS + """,
    touched AS (SELECT id FROM spread WHERE ord % 5 <> 0 AND ord % 3 = f - 1 UNION SELECT id FROM spread WHERE ord % 5 = 0 AND ord % 2 = 0)
    SELECT (SELECT count(*) FROM (SELECT DISTINCT grp, f FROM spread)) AS final_count,
           (SELECT count(DISTINCT id) FROM spread WHERE ord % 5 = 0 AND ord % 2 = 0) AS discard_count,
           (SELECT count(*) FROM articles) - (SELECT count(*) FROM touched) AS still_unreferenced_count""")
def merge_report_totals(spark, sf):
    return _merge_report(spark, sf)[1]


def _merge_report(spark, sf):
    finals, a = _finals(spark, sf)
    links = finals.select(F.col("final_no").cast("int").alias("round"), "run_id", F.explode("merged_from").alias("id")).join(a.select("id", "ord"), "id")
    mentions = links.where("ord % 5 <> 0 AND ord % 3 = round - 1").select("round", "id")
    discards = links.where("ord % 5 = 0 AND ord % 2 = 0").select("round", "id")
    return aggregates.merge_report(a, mentions, discards, finals.select(F.col("final_no").cast("int").alias("round"), "final_id"))


@query("cluster_checks", A + """,
    c AS (SELECT ord // 20 AS topic, list(ord) AS ids, coalesce(list(ord) FILTER (WHERE ord % 3 <> 0 OR ord % 7 = 0), []) AS keep,
                 coalesce(list(ord) FILTER (WHERE ord % 3 = 0 AND ord % 11 <> 0), []) AS drop_ FROM articles GROUP BY topic)
    SELECT topic, len(list_distinct(list_concat(keep, drop_))) = len(ids) AS covers, len(list_intersect(keep, drop_)) = 0 AS disjoint, len(ids) >= 2 AS big_enough FROM c""")
def cluster_checks(spark, sf):
    a = _arts(spark, sf)
    keep = F.when((F.col("ord") % 3 != 0) | (F.col("ord") % 7 == 0), F.col("id"))
    drop = F.when((F.col("ord") % 3 == 0) & (F.col("ord") % 11 != 0), F.col("id"))
    clusters = a.groupBy(F.floor(F.col("ord") / 20).alias("topic")).agg(
        F.collect_list("id").alias("ids"), F.collect_list(keep).alias("keep"), F.collect_list(drop).alias("drop")
    )
    return aggregates.cluster_checks(clusters).select("topic", "covers", "disjoint", "big_enough")


# ---- placement and exports ----

def _placed(spark, sf):
    """One placement reply per source, with repeats, overflow, one without any id and, for some, an unknown id."""
    a = _arts(spark, sf)
    o = F.col("ord")
    rows = a.where("ord % 3 <> 0 AND origin <> 'src3'")
    group = F.when(o % 11 < 2, "top").when(o % 11 < 8, "main").otherwise("side")
    one = rows.select(F.col("origin").alias("reply_id"), group.alias("group"), o.alias("pos"), "id")
    again = rows.where("ord % 13 = 1").select(F.col("origin").alias("reply_id"), F.lit("side").alias("group"), o.alias("pos"), "id")
    stray = a.where("ord % 1000 = 7").select(F.col("origin").alias("reply_id"), F.lit("side").alias("group"), o.alias("pos"), F.lit("art-unknown").alias("id"))
    named = one.unionByName(again).unionByName(stray)
    return named, a.select(F.col("origin").alias("reply_id"), "id"), a.select(F.col("origin").alias("reply_id")).distinct()


_PLACED = given("articles", more="""bad AS (SELECT DISTINCT origin FROM articles WHERE ord % 1000 = 7),
    named AS (SELECT origin, id, ord, CASE WHEN ord % 11 < 2 THEN 0 WHEN ord % 11 < 8 THEN 1 ELSE 2 END AS g FROM articles WHERE ord % 3 <> 0 AND origin <> 'src3' AND origin NOT IN (SELECT origin FROM bad)),
    tops AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY ord) AS r FROM named WHERE g = 0),
    mains AS (SELECT origin, id, row_number() OVER (PARTITION BY origin ORDER BY extra, ord) AS r FROM (
        SELECT origin, id, ord, 0 AS extra FROM named WHERE g = 1 UNION ALL SELECT origin, id, ord, 1 FROM tops WHERE r > 1))""")


@query("validate_placements", _PLACED + """
    SELECT a.origin AS reply_id, a.id, CASE WHEN t.id IS NOT NULL THEN 'top' WHEN m.id IS NOT NULL THEN 'main' ELSE 'side' END AS placement
    FROM articles a LEFT JOIN tops t ON a.id = t.id AND t.r = 1 LEFT JOIN mains m ON a.id = m.id AND m.r <= 6
    WHERE a.origin NOT IN (SELECT origin FROM bad)""")
def validate_placements(spark, sf):
    return placement.validate_placements(*_placed(spark, sf))[0].select("reply_id", "id", "placement")


@query("rejected_placements", _PLACED + "SELECT origin AS reply_id FROM bad")
def rejected_placements(spark, sf):
    return placement.validate_placements(*_placed(spark, sf))[1]


@query("front_page", A + """,
    keyed AS (SELECT *, CASE WHEN ord % 5 = 0 AND NOT weak THEN 0 WHEN NOT weak THEN 1 WHEN ord % 5 = 0 THEN 2 ELSE 3 END AS bucket,
        CASE placement WHEN 'top' THEN 0 WHEN 'main' THEN 1 ELSE 2 END AS r FROM (SELECT *, category = 'rumor' AND trust = 'low' AS weak FROM articles)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY bucket, r, ord) AS slot FROM keyed)
    SELECT id, CASE WHEN slot = 1 THEN 'top' WHEN slot <= 7 THEN 'main' ELSE 'side' END AS placement, CASE WHEN slot <= 7 THEN slot END AS slot FROM ranked""")
def front_page(spark, sf):
    a = _arts(spark, sf)
    placed = placement.front_page(a.drop("placement"), a.where(b.is_new()), a.select("id", "placement"))
    return placement.display_order(placed).select("id", "placement", "slot")


@query("assign_ids", A + """
    SELECT ord, 'art-' || strftime(run_at, '%Y%m%d%H%M') || '-' || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq AS id
    FROM (SELECT ord, TIMESTAMP '2024-02-01 09:00:00' + to_days(CAST(ord % 2 AS INTEGER)) AS run_at, row_number() OVER (PARTITION BY ord % 2 ORDER BY ord) AS seq FROM articles)""")
def assign_ids(spark, sf):
    a = _arts(spark, sf).withColumn("chunk_index", F.floor(F.col("ord") / 20)).withColumn("pos", F.col("ord") % 20)
    run_at = b.ntz(b.NOW) + F.make_dt_interval((F.col("ord") % 2).cast("int"))
    return numbering.assign_ids(a, run_at).select("ord", "id")


def _daily(spark, sf):
    """New articles by creation date, and every date of the range as a run."""
    a = _arts(spark, sf).where(b.is_new()).withColumn("run_date", times.kst_date("created_at"))
    days = a.agg(F.sequence(F.min("run_date"), F.date_add(F.max("run_date"), 2)).alias("d")).select(F.explode("d").alias("run_date"))
    return days, a


_DAILY = given("articles", more="""fresh AS (SELECT *, CAST(created_at + INTERVAL 9 HOUR AS DATE) AS day FROM articles WHERE ord % 5 = 0),
    days AS (SELECT CAST(unnest(generate_series(min(day), max(day) + 2, INTERVAL 1 DAY)) AS DATE) AS day FROM fresh),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ord) AS rank, count(*) OVER (PARTITION BY day) AS n FROM fresh),
    texts AS (SELECT *, trim(headline, ' ' || chr(9) || chr(10) || chr(13)) AS h FROM ranked),
    lines AS (SELECT day, max(n) AS n, array_to_string(list(h || '(' || CASE WHEN category = 'rumor' THEN '찌라시' ELSE '뉴스' END || ', '
        || CASE WHEN trust = 'low' THEN '낮은 신뢰' ELSE '확인된 흐름' END || ')' ORDER BY rank) FILTER (WHERE rank <= 10), ', ') AS items,
        max(h) FILTER (WHERE rank = 1) AS first FROM texts GROUP BY day),
    summary AS (SELECT CAST(days.day AS VARCHAR) AS run_date, coalesce(n, 0) AS article_count,
        CASE WHEN n IS NULL THEN '새 업데이트 없이 이어지는 하루' ELSE rtrim(substr(first, 1, 42), ' .,…') || CASE WHEN length(first) > 42 THEN '…' ELSE '' END END AS title,
        CASE WHEN n IS NULL THEN '오늘 새로 확인된 업데이트는 없습니다. 기존 기사와 아카이브는 그대로 유지됩니다.'
             ELSE '오늘 업데이트는 ' || items || CASE WHEN n > 10 THEN ', 그 외 ' || (n - 10) || '건' ELSE '' END || '을 중심으로 정리됩니다.' END AS body
        FROM days LEFT JOIN lines USING (day))""")


@query("summary_fallback", _DAILY + "SELECT run_date, title, body, article_count FROM summary")
def summary_fallback(spark, sf):
    out = aggregates.summary_fallback(*_daily(spark, sf))
    return out.withColumn("run_date", F.col("run_date").cast("string"))


@query("daily_documents", _DAILY + """
    SELECT run_date AS date, 1 AS schema_version, 'Daily Mill' AS journal, article_count AS count, title, body FROM summary""")
def daily_documents(spark, sf):
    days, a = _daily(spark, sf)
    docs = state.daily_documents(days, aggregates.summary_fallback(days, a), b.ntz(b.NOW), "Daily Mill")
    return docs.select(
        F.col("date").cast("string").alias("date"), "schema_version", "journal", "count", "daily_summary.title", "daily_summary.body"
    )


@query("daily_articles", _DAILY + "SELECT CAST(day AS VARCHAR) AS date, rank - 1 AS place, id, headline FROM ranked")
def daily_articles(spark, sf):
    _, a = _daily(spark, sf)
    return state.daily_articles(a.select("run_date", "ord", "id", "headline")).withColumn("date", F.col("date").cast("string"))


# ---- search ----

_TERMS = given("text_posts", more="""ws AS (SELECT post_id, list_filter(string_split(regexp_replace(strip_accents(lower(content)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM text_posts),
    terms AS (SELECT post_id, len(words) AS doc_len, unnest(words) AS term FROM ws),
    idx AS (SELECT term, post_id, doc_len, count(*) AS tf FROM terms GROUP BY ALL)""")


def text_index(spark, sf):
    """The stored index of the text posts; made once a session for the files as they are, then opened."""
    seen = b.table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = seen.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*seen.columns)).alias("h")).first()
    path = f"{shared_folder(spark)}/term-index-{spark.sparkContext.applicationId}-{state['n']}-{(state['h'] or 0) & 0xFFFFFFFFFFFFFFFF:x}"
    if open_index(spark, path) is None:
        merge_into_index(b.text_posts(spark, sf).select("post_id", "content"), path)
    return open_index(spark, path)


@query("build_term_index", _TERMS + "SELECT term, post_id, doc_len, tf FROM idx")
def build_term_index(spark, sf):
    return search.stored_postings(text_index(spark, sf))


@query("bm25_search", _TERMS + """,
    st AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avg_len FROM ws),
    hit AS (SELECT * FROM idx WHERE term IN ('the', 'whst')),
    df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hit GROUP BY term)
    SELECT post_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 6) AS score
    FROM hit JOIN df USING (term), st GROUP BY post_id HAVING count(*) = 2 ORDER BY score DESC, post_id LIMIT 10""")
def bm25_search(spark, sf):
    return search.bm25_search(text_index(spark, sf), "Whst-Thé", 10)


@query("search_posts", _TERMS + """,
    st AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avg_len FROM ws),
    hit AS (SELECT * FROM idx WHERE term IN ('avec', 'elle')),
    df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hit GROUP BY term),
    best AS (SELECT post_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 6) AS score
        FROM hit JOIN df USING (term), st GROUP BY post_id HAVING count(*) = 2 ORDER BY score DESC, post_id LIMIT 5)
    SELECT post_id, source, author, "timestamp", substr(content, 1, 150) AS preview, source_url, score FROM best JOIN text_posts USING (post_id)""")
def search_posts(spark, sf):
    return search.search_posts(b.text_posts(spark, sf), text_index(spark, sf), "avec elle", 5)
