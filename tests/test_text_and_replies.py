import json
import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.functions import scores, text, times
from postmill.operators import evidence, ranking, replies


def reply(spark, *raws):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "reply_id string, raw string")


BODY = "a body that is longer than forty characters, surely"


def test_article_reply_forms(spark):
    item = {"headline": "Headline", "body": BODY, "category": "NEWS", "trust": "high"}
    raws = [
        json.dumps({"articles": [item]}), "```json\n" + json.dumps({"articles": [item]}) + "\n```", json.dumps([item]),
        "[" + json.dumps(item) + ",]", "[" + json.dumps(item) + ",", "so: " + '"articles": [' + json.dumps(item) + "] end",
        '{"articles": []}', '{"articles":[{"headline":"Hea', json.dumps({"articles": [{"headline": "x", "body": BODY}, 5, item]}),
    ]
    got, silent = replies.parse_article_replies(reply(spark, *raws))
    rows = sorted((r.reply_id, r.headline, r.category, r.trust) for r in got.collect())
    assert rows == [(str(i), "Headline", "news", "high") for i in (0, 1, 2, 3, 5, 8)]
    assert sorted(r.reply_id for r in silent.collect()) == ["4", "7"]


def test_placement_reply_forms(spark):
    raws = ['{"top":"1","main":["2", 3],"side":null}', "```\n{\"top\":null,\"main\":\"4\",\"side\":[\" \"]}\n```", '{"top":5}', "none", '{"top":{"a":1}}']
    rows, bad = replies.parse_placement_replies(reply(spark, *raws))
    assert sorted((r.reply_id, r.group, r.pos, r.id) for r in rows.collect()) == [
        ("0", "main", 0, "2"), ("0", "main", 1, "3"), ("0", "top", 0, "1"), ("1", "main", 0, "4")]
    assert sorted(r.reply_id for r in bad.collect()) == ["2", "3", "4"]


def test_verdicts(spark):
    got = replies.parse_verdict_replies(reply(spark, '{"clusters":[{"keep":"1","drop":["02",3]},{"drop":null}]}', "{bad"), "clusters")
    assert sorted((r.reply_id, r.ref) for r in got.collect()) == [("0", "02"), ("0", "3")]
    got = replies.parse_verdict_replies(reply(spark, '{"drop_new":["n1","N02","E3","N1x"]}'), "cross")
    assert sorted(r.number for r in got.collect()) == [1, 2]


def test_broken_merge_reply_is_salvaged(spark):
    broken = '{"final":[{"headline":"A \\"q\\" {x}","body":"line\\nb","merged_from":["01", \'2\']},{"headline":"B","body":"raw\nbreak \\" x","merged_from":[]}],"discard":["7","8"], oops'
    strict = json.dumps({"final": [{"headline": "C", "body": "d", "merged_from": ["1"]}], "discard": [9]})
    finals, discards = replies.parse_merge_replies(reply(spark, broken, strict))
    rows = sorted((r.reply_id, r.pos, r.headline, r.body, tuple(r.merged_from)) for r in finals.collect())
    assert rows == [("0", 0, 'A "q" {x}', "line\nb", ("01", "2")), ("0", 1, "B", 'raw\nbreak \\" x', ()), ("1", 0, "C", "d", ("1",))]
    assert sorted((r.reply_id, r.ref) for r in discards.collect()) == [("0", "7"), ("0", "8"), ("1", "9")]


def test_summary_tags_and_grounding(spark):
    got = replies.parse_summary_replies(reply(spark, json.dumps({"title": " T ", "summary": BODY}), "just " + BODY, '{"title": 1, "body": "short"}', "{a}")).orderBy("reply_id").collect()
    assert [(r.title, r.usable) for r in got] == [("T", True), ("", True), ("1", False), ("", False)]
    tags = replies.parse_tag_replies(reply(spark, '{"tags":[{"id":"a","category":"News","trust":"?"},{"id":"a","category":"rumor","trust":"high"},{"id":""}]} trailing {'))
    assert [(r.id, r.category, r.trust) for r in tags.collect()] == [("a", "rumor", "high")]
    got = replies.parse_grounding_replies(reply(spark, '{"verdict":"joke","confidence":0.9,"evidence_quote":"q","reason":"r"}', "nope")).orderBy("reply_id").collect()
    assert [(r.verdict, r.confidence) for r in got] == [("joke", 0.9), ("parse_error", 0.0)]


def test_titled_sections(spark):
    line = "이 문장은 한국어로 쓰인 충분히 긴 본문 줄입니다 그리고 계속됩니다"
    raw = (f"제목: **첫 번째 기사 제목**\n본문: {line}\n* {line}\nConstraint check: {line} draft\nEnglish line that is long enough to count\n\n"
           f"제목: Second title in English\n본문: {line}{line}{line}\n제목: 셋째 기사 제목입니다\n본문：(본문) {line}{line}{line}")
    full = replies.parse_titled_sections(reply(spark, raw)).collect()
    assert [(r.headline, r.body) for r in full] == [("첫 번째 기사 제목", f"{line}\n{line}")]
    assert replies.parse_titled_sections(reply(spark, raw), "oneshot").count() == 3


def test_numbered_titles(spark):
    raw = "1. 첫 번째 한국어 제목입니다 (Reflects the topic)\n2) 짧은\n3. 첫 번째 한국어 제목입니다 (Reflects the topic)\n 4. 두 번째 한국어 제목 입니다"
    got = replies.parse_numbered_titles(reply(spark, raw)).orderBy("pos").collect()
    assert [r.title for r in got] == ["첫 번째 한국어 제목입니다", "두 번째 한국어 제목 입니다"]


@pytest.mark.parametrize("meta,sql,py,cli", [
    ('{"points":0,"score":9}', 0, 9, 9), ('{"points":"x","likes":3.5}', 3.5, 3.5, 3.5), ('{"score":2,"points":7}', 7, 7, 2),
    ('{"num_comments":4}', 4, 4, 0), ('{"score":"-7"}', -7, -7, -7), ("{}", 0, 0, 0), (None, 0, 0, 0), ("[1]", 0, 0, 0),
])
def test_scores(spark, meta, sql, py, cli):
    df = spark.createDataFrame([(meta,)], "m string").select(*[scores.engagement_score("m", v) for v in ("sql", "py", "cli")])
    assert tuple(df.first()) == (sql, py, cli)


def test_chat_times(spark):
    heads = ["[2026. 4. 7. 오전 12:05] a", "[2026. 4. 7. 오후 12:05] a", "[2026. 12. 7. 오후 1:05] a", "[2026. 4. 7. 오전 11:59] a", "[2026. 2. 31. 오전 1:00] a"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    got = [r[0] and str(r[0]) for r in df.orderBy("i").select(times.chat_timestamp("h")).collect()]
    assert got == ["2026-04-07 00:05:00", "2026-04-07 12:05:00", "2026-12-07 13:05:00", "2026-04-07 11:59:00", None]


@pytest.mark.parametrize("raw,want", [
    ("2026-04-20T00:00:00Z", "2026-04-20 00:00:00"), ("2026-04-20T09:00:00", "2026-04-20 00:00:00"), ("2026-04-20", "2026-04-19 15:00:00"),
    (" 2026-04-20T00:00:00-04:00 ", "2026-04-20 04:00:00"), ("", None), (None, None),
])
def test_parse_iso(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(times.parse_iso("s")).first()[0]
    assert (got and str(got)) == want


def test_channel_slug(spark):
    rows = [("Channel: Guild / ★ 일반 chat?", "일반_chat_"), ("no-slash", "no-slash"), ("a / ★★", "fb")]
    df = spark.createDataFrame(rows, "s string, want string").select(text.channel_slug("s", "fb").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.parametrize("limit", [40, 300, 100_000])
def test_snippets_equal_plain_scan(spark, limit):
    rng = random.Random(limit)
    vocab = ["GPT-5.5", "gpt", "opus", "Sonnet", "한글단어", "단어", "x9", "averyveryverylongkeyword", "averyveryverylongkeywordtoo"]
    msgs = [("c", i, "[h]\n" + " ".join(rng.choice(vocab + ["-", "pad(gpt)", "ütopus,"]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    words = {f"a{i}": rng.sample(vocab, 2) + ["none"] for i in range(8)}
    kw = spark.createDataFrame([(a, k) for a, ks in words.items() for k in ks], "id string, keyword string")
    got = {r.id: (r.snippets, r.snippets_len) for r in evidence.keyword_snippets(kw, spark.createDataFrame(msgs, "channel string, ordinal bigint, block string"), limit).collect()}
    for a, ks in words.items():
        joined = "\n".join(t for _, _, t in msgs if any(k.lower() in t.lower() for k in ks))
        want = joined[:limit] + "\n... (truncated)" if len(joined) > limit else joined
        assert got[a] == (want, len(want))


def test_keywords_rank(spark):
    df = spark.createDataFrame([("a", "GPT-5.5 the 모델", "모델 gpt gpt ab cd 1.5.2 a")], "id string, headline string, body string")
    got = [r.keyword for r in evidence.top_keywords(df, 5).orderBy("rank").collect()]
    assert got == ["gpt", "모델", "GPT-5.5", "1.5.2", "ab"]


def test_large_k_is_exact(spark):
    rows = [(i % 3, (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = ranking.top_per_group(df, ["g"], [F.desc("v")], 1200)
    want = {(g, v) for g in range(3) for v in sorted((v for h, v in rows if h == g), reverse=True)[:1200]}
    assert {(r.g, r.v) for r in got.collect()} == want
