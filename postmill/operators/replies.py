"""Model replies, given as a table (reply_id, raw), to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions import replies as R
from postmill.functions.text import (
    blank_to_null,
    keep_script_lines,
    script_share,
    starts_with_any,
    strip,
)
from postmill.operators.guards import ClaimRules, downgrade_unsourced_claims

CATEGORIES = ["news", "rumor"]
TRUSTS = ["high", "low"]
TRAILING_COMMA = r",\s*([}\]])"


def label_or(value: Column, allowed: list[str], default: str) -> Column:
    clean = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin(allowed), clean).otherwise(F.lit(default))


def unquote(c: Column) -> Column:
    return strip(strip(F.coalesce(c, F.lit(""))), R.QUOTES)


def parse_article_replies(replies: DataFrame, claim_rules: ClaimRules = ClaimRules()) -> tuple[DataFrame, DataFrame]:
    """(articles, unparsed): long enough articles of every readable reply, claims downgraded.

    Readings are tried in order: the bare array, the array closed by hand, the outermost
    object, the ``articles`` array in the text; each also without trailing commas. The
    first reading with a list counts. Replies without any article are unparsed unless
    they say so with an explicit empty list.
    """
    wrap = lambda c: F.concat(F.lit('{"articles":'), c, F.lit("}"))

    def reading(c: Column) -> Column:
        value = F.coalesce(R.strict_json(c), R.strict_json(F.regexp_replace(c, TRAILING_COMMA, "$1")))
        listed = F.try_variant_get(value, "$.articles", "variant")
        return R.let(listed, lambda x: F.when(R.kind(x) == "array", F.try_variant_get(x, "$", "array<variant>")))

    def first_reading(s: Column) -> Column:
        bare = F.startswith(s, F.lit("["))
        closed = F.concat(F.rtrim(s, F.lit(",}] ")), F.lit("]"))
        inner = F.regexp_extract(s, r'(?s)"articles"\s*:\s*(\[.*?\])', 1)
        return F.coalesce(
            F.when(bare, reading(wrap(s))), F.when(bare, reading(wrap(closed))),
            reading(R.braces(s)), R.let(inner, lambda x: F.when(x != "", reading(wrap(x)))),
        )

    read = replies.select("reply_id", "raw", R.let(R.unfence("raw"), first_reading).alias("items"))
    # Outer, as Spark would else read every reply once more for a filter on empty lists.
    rows = read.select("reply_id", F.posexplode_outer("items").alias("pos", "item")).where(R.kind(F.col("item")) == "object")
    fields = rows.select(
        "reply_id", "pos",
        unquote(R.text_at(F.col("item"), "$.headline")).alias("headline"),
        unquote(R.text_at(F.col("item"), "$.body")).alias("body"),
        label_or(R.text_at(F.col("item"), "$.category"), CATEGORIES, "rumor").alias("category"),
        label_or(R.text_at(F.col("item"), "$.trust"), TRUSTS, "low").alias("trust"),
    )
    articles = downgrade_unsourced_claims(fields.where((F.length("headline") > 4) & (F.length("body") > 40)), claim_rules)
    empty = F.col("raw").rlike(r'"articles"\s*:\s*\[\s*\]')
    silent = read.where(~empty).select("reply_id").join(articles.select("reply_id").distinct(), "reply_id", "left_anti")
    return articles, silent


def parse_placement_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (reply_id, group, pos, id), unparsed): ids as text, list or null per group."""
    groups = ["top", "main", "side"]
    value = R.strict_json(R.braces(R.unfence("raw")))
    read = replies.select("reply_id", value.alias("v"))

    def members(group: str) -> Column:
        at = F.try_variant_get("v", f"$.{group}", "variant")
        text = R.text_at(F.col("v"), f"$.{group}")
        return F.when(R.kind(at) == "array", F.transform(R.list_at(F.col("v"), f"$.{group}"), R.as_text)).when(
            R.kind(at) == "string", F.array(text)
        ).otherwise(F.array().cast("array<string>"))

    kinds = [R.kind(F.try_variant_get("v", f"$.{g}", "variant")) for g in groups]
    bad = F.col("v").isNull() | (R.kind(F.col("v")) != "object")
    for k in kinds:
        bad = bad | k.isin("object", "scalar")
    judged = read.withColumn("__bad", bad)
    sides = F.array(*[F.struct(F.lit(g).alias("group"), members(g).alias("ids")) for g in groups])
    long = (
        judged.where("NOT __bad")
        .select("reply_id", F.inline(sides))
        .select("reply_id", "group", F.posexplode_outer("ids").alias("pos", "id"))
        .withColumn("id", strip("id"))
        .where("id <> ''")
    )
    return long, judged.where("__bad").select("reply_id")


def parse_verdict_replies(replies: DataFrame, kind: str) -> DataFrame:
    """Dropped refs of duplicate verdicts; an unreadable reply drops nothing.

    ``clusters`` gives (reply_id, ref) of ``clusters[].drop[]``; ``cross`` gives
    (reply_id, number) of ``drop_new[]`` entries ``N<number>``.
    """
    value = R.strict_json(R.braces(R.unfence("raw")))
    read = replies.select("reply_id", value.alias("v"))
    if kind == "clusters":
        cluster = read.select("reply_id", F.explode(R.list_at(F.col("v"), "$.clusters")).alias("c"))
        refs = cluster.select("reply_id", F.explode(R.list_at(F.col("c"), "$.drop")).alias("d"))
        refs = refs.select("reply_id", R.clean_id(R.as_text(F.col("d"))).alias("ref"))
        return refs.where("ref <> ''").distinct()
    if kind == "cross":
        refs = read.select("reply_id", F.explode(R.list_at(F.col("v"), "$.drop_new")).alias("d"))
        number = F.regexp_extract(F.upper(R.clean_id(R.as_text(F.col("d")))), r"^N0*(\d+)$", 1)
        return refs.select("reply_id", number.try_cast("bigint").alias("number")).where("number > 0").distinct()
    raise ValueError(f"unknown verdict kind: {kind}")


STRING_BODY = r'(?:[^"\\]++|\\.)*+'
OBJECT = r'(?s)\{(?:[^{}"]++|"' + STRING_BODY + r'")*+\}'


def _json_text(c: Column) -> Column:
    """Unescaped JSON string content, or the raw content when it is no valid JSON string."""
    return F.coalesce(R.text_at(R.strict_json(F.concat(F.lit('"'), c, F.lit('"'))), "$"), c)


def _id_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: R.clean_id(x)), lambda x: x != "")


def parse_merge_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finals (reply_id, pos, headline, body, merged_from), discards (reply_id, pos, ref)).

    Replies that are no valid JSON are salvaged object by object.
    """
    value = R.strict_json(R.braces(R.unfence("raw")))
    read = replies.select("reply_id", "raw", value.alias("v"))
    good = read.where(R.kind(F.col("v")) == "object")
    broken = read.where(R.kind(F.col("v")) != "object")

    def texts(items: Column) -> Column:
        return F.filter(F.transform(items, lambda x: R.clean_id(R.as_text(x))), lambda x: x.isNotNull() & (x != ""))

    strict = good.select("reply_id", F.posexplode(R.list_at(F.col("v"), "$.final")).alias("pos", "f")).select(
        "reply_id", "pos", R.text_at(F.col("f"), "$.headline").alias("headline"),
        R.text_at(F.col("f"), "$.body").alias("body"), texts(R.list_at(F.col("f"), "$.merged_from")).alias("merged_from"),
    )
    objects = broken.select("reply_id", F.posexplode(F.regexp_extract_all("raw", F.lit(OBJECT), F.lit(0))).alias("pos", "o"))

    def member(name: str) -> Column:
        return F.regexp_extract("o", rf'(?s)"{name}"\s*:\s*"({STRING_BODY})"', 1)

    has = F.col("o").rlike(r'"headline"\s*:\s*"') & F.col("o").rlike(r'"body"\s*:\s*"')
    salvaged = objects.where(has).select(
        "reply_id", "pos", _json_text(member("headline")).alias("headline"), _json_text(member("body")).alias("body"),
        _id_list(F.regexp_extract("o", r'(?s)"merged_from"\s*:\s*\[([^\]]*)\]', 1)).alias("merged_from"),
    )
    listed = good.select("reply_id", texts(R.list_at(F.col("v"), "$.discard")).alias("ids")).unionByName(
        broken.select("reply_id", _id_list(F.regexp_extract("raw", r'(?s)"discard"\s*:\s*\[([^\]]*)\]', 1)).alias("ids"))
    )
    discards = listed.select("reply_id", F.posexplode("ids").alias("pos", "ref"))
    return strict.unionByName(salvaged), discards


def parse_summary_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, title, body, usable): ``summary`` stands in for body, loose text is a body.

    Bodies under 40 characters and unreadable objects are not usable; the caller takes the fallback.
    """
    s = R.unfence("raw")
    inner = R.braces(s)
    v = R.strict_json(inner)
    loose = inner == ""
    body = F.coalesce(blank_to_null(R.text_at(v, "$.body")), R.text_at(v, "$.summary"), F.lit(""))
    read = replies.select(
        "reply_id",
        F.when(loose, F.lit("")).otherwise(strip(F.coalesce(R.text_at(v, "$.title"), F.lit("")))).alias("title"),
        F.when(loose, s).otherwise(strip(body)).alias("body"),
    )
    return read.withColumn("usable", F.length("body") >= 40)


def parse_tag_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, id, category, trust) with unknown labels coerced; the last tag of an id wins."""
    v = R.strict_json(R.braces(R.unfence("raw")))
    # The first balanced object counts, so text after it is tried again without.
    first = R.strict_json(F.regexp_extract(R.unfence("raw"), r'(?s)\{"tags"\s*:\s*\[.*?\]\s*\}', 0))
    read = replies.select("reply_id", F.coalesce(v, first).alias("v"))
    tags = read.select("reply_id", F.posexplode(R.list_at(F.col("v"), "$.tags")).alias("pos", "t"))
    fields = tags.select(
        "reply_id", "pos", R.clean_id(F.coalesce(R.text_at(F.col("t"), "$.id"), F.lit(""))).alias("id"),
        label_or(R.text_at(F.col("t"), "$.category"), CATEGORIES, "rumor").alias("category"),
        label_or(R.text_at(F.col("t"), "$.trust"), TRUSTS, "low").alias("trust"),
    ).where("id <> ''")
    last = fields.groupBy("reply_id", "id").agg(F.max_by(F.struct("category", "trust"), "pos").alias("t"))
    return last.select("reply_id", "id", "t.category", "t.trust")


def parse_grounding_replies(replies: DataFrame) -> DataFrame:
    """Verdict, confidence, quote and reason; unreadable replies are parse errors with confidence 0."""
    v = R.strict_json(R.braces(R.unfence("raw")))
    read = replies.withColumn("v", v)
    ok = R.kind(F.col("v")) == "object"
    return read.select(
        "reply_id",
        F.when(ok, R.text_at(F.col("v"), "$.verdict")).otherwise("parse_error").alias("verdict"),
        F.when(ok, F.try_variant_get("v", "$.confidence", "double")).otherwise(0.0).alias("confidence"),
        F.when(ok, R.text_at(F.col("v"), "$.evidence_quote")).otherwise("").alias("evidence_quote"),
        F.when(ok, R.text_at(F.col("v"), "$.reason")).otherwise("unreadable reply").alias("reason"),
    )


SECTION = r"(?s)제목\s*[:：]\s*(.+?)\s*\n+\s*본문\s*[:：]\s*(.+?)(?=\n\s*제목\s*[:：]|\z)"


def parse_titled_sections(
    replies: DataFrame, form: str = "full", pattern: str = SECTION, script: str = rules.HANGUL
) -> DataFrame:
    """Title and body pairs of loose text replies.

    ``oneshot`` keeps titles over 5 and bodies over 50 characters. ``full`` wants bodies over 80,
    titles mostly in the script, no placeholder bodies; it cleans body lines and cuts titles at 150.
    """
    titles = F.regexp_extract_all("raw", F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all("raw", F.lit(pattern), F.lit(2))
    pairs = replies.select("reply_id", F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("pos", "p"))
    read = pairs.select(
        "reply_id", "pos",
        strip(strip("p.title"), "\"'*#").alias("headline"), strip(strip("p.body"), "\"'*").alias("body"),
    ).where(F.length("headline") > 5)
    if form == "oneshot":
        return read.where(F.length("body") > 50)
    share = script_share(F.col("headline"), script, F.length("headline"))
    placeholder = starts_with_any(strip("body"), rules.PLACEHOLDER_BODIES)
    kept = read.where((share >= 0.2) & ~placeholder & (F.length("body") > 80))
    clean = keep_script_lines(
        "body", script, min_len=15, bullets=r"\*\-#", drop_phrases=rules.META_PHRASES_SHORT, drop_prefixes=[]
    )
    title = F.substring(strip(F.substring_index("headline", "\n", 1)), 1, 150)
    return kept.select("reply_id", "pos", title.alias("headline"), clean.alias("body"))


DRAFT_TITLE = r"(?d)\*Draft\s*\d+[^:\n]*[:：]\*\s*(.+)"
NUMBERED_TITLE = r"(?dm)^\s*\d+[.)]\s*(.+[가-힣].+)$"


def parse_numbered_titles(
    replies: DataFrame, draft: str = DRAFT_TITLE, numbered: str = NUMBERED_TITLE, script: str = rules.HANGUL
) -> DataFrame:
    """Titles of draft lines, or of numbered lines where no draft title counts; unique by 30 characters."""

    def titles(pattern: str) -> Column:
        found = F.regexp_extract_all("raw", F.lit(pattern), F.lit(1))
        bare = F.transform(found, lambda x: strip(F.regexp_replace(strip(x), r"\s*\([A-Z][^)]{10,}\)\s*\.?\s*$", ""), "\"'*#[]:. "))
        return F.filter(
            bare, lambda x: F.length(x).between(10, 200) & (script_share(x, script, F.length(x)) > 0.2)
        )

    both = replies.select("reply_id", titles(draft).alias("d"), titles(numbered).alias("n"))
    rows = both.select("reply_id", F.posexplode(F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("n"))).alias("pos", "title"))
    first = rows.groupBy("reply_id", F.substring("title", 1, 30).alias("key")).agg(F.min(F.struct("pos", "title")).alias("t"))
    return first.select("reply_id", "t.pos", "t.title")


def reply_body(c: Column | str, script: str = rules.HANGUL) -> Column:
    """Script lines after the body marker, or of the whole reply when there is none."""
    text = F.col(c) if isinstance(c, str) else c
    marked = F.regexp_extract(text, r"(?s)본문\s*[:：]\s*(.+)", 1)
    source = F.coalesce(blank_to_null(marked), text)
    return keep_script_lines(source, script, min_len=10, bullets=r"\*\-#", drop_phrases=[], drop_prefixes=[], fallback=False)
