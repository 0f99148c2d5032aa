import random

import pytest
from pyspark.sql import functions as F

from postmill import rules
from postmill.operators import anchors, guards, lookups, placement
from postmill.plans import daily
from postmill.plans.catalog import QUERIES

ART = "id string, ord bigint, headline string, body string, category string, trust string, created_at timestamp_ntz, placement string, placed_at timestamp_ntz"


def art(spark, rows):
    """Rows (id, ord, category, trust, placement); higher ord is later."""
    full = [(i, o, f"headline {i}", "body", c, t, None, p, None) for i, o, c, t, p in rows]
    stamp = F.lit("2026-04-20").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("ord").cast("int"))
    df = spark.createDataFrame(full, ART.replace("timestamp_ntz", "string"))
    return df.withColumns({"created_at": stamp, "placed_at": stamp})


def story(spark, headline, body, category="news", trust="high", id="x"):
    return spark.createDataFrame([(id, headline, body, category, trust)], "id string, headline string, body string, category string, trust string")


def test_unsourced_launch_claim_is_downgraded(spark):
    df = story(spark, "GPT-6 공식 출시 소식", "GPT-6 모델이 공개됐습니다. OpenAI가 출시했습니다.")
    r = guards.downgrade_unsourced_claims(df).first()
    # The replacements run one after the other, also on each other's output.
    assert r.headline == "미확인: GPT-6 출시 주장 주장"
    assert r.body == rules.UNCONFIRMED_BODY_PREFIX + "GPT-6 모델이 공개됐습니다. OpenAI가 출시했다는 주장이 나왔다는 주장이 나왔습니다."
    assert (r.category, r.trust) == ("rumor", "low")
    again = guards.downgrade_unsourced_claims(guards.downgrade_unsourced_claims(df)).first()
    assert again.headline.startswith("미확인: GPT-6") and again.body.count(rules.UNCONFIRMED_BODY_PREFIX) == 1


@pytest.mark.parametrize("headline,body", [
    ("GPT-6 출시", "openai.com/index 에 따르면 출시했습니다."), ("GPT가 무언가", "공개했다"), ("날씨 소식", "출시했습니다"),
])
def test_sourced_or_unrelated_claims_stay(spark, headline, body):
    r = guards.downgrade_unsourced_claims(story(spark, headline, body)).first()
    assert (r.headline, r.body, r.category) == (headline, body, "news")


def test_product_guard_drops_repeats_and_labels_followups(spark):
    old = story(spark, "ChatGPT Images 2.0 공개", "발표했다")
    new = (
        story(spark, "GPT-Image-2 출시", "이미지 모델이 출시됐다", id="repeat")
        .unionByName(story(spark, "GPT Image 2 리더보드 1위 공개", "점수", id="followup"))
        .unionByName(story(spark, "Opus 출시", "x", id="other"))
    )
    kept, dropped = guards.product_story_guard(new, old)
    assert {(r.id, r.headline) for r in kept.collect()} == {("followup", "후속: GPT Image 2 리더보드 1위 공개"), ("other", "Opus 출시")}
    assert [r.id for r in dropped.collect()] == ["repeat"]
    weak = old.withColumns({"category": F.lit("rumor"), "trust": F.lit("low")})
    assert guards.product_story_guard(new, weak)[1].count() == 0
    untagged = old.withColumns({"category": F.lit(None).cast("string"), "trust": F.lit(None).cast("string")})
    assert guards.product_story_guard(new, untagged)[1].count() == 1


def front(spark, old, new, given):
    o, n = art(spark, old), art(spark, new) if new else None
    n = n if n is not None else o.limit(0)
    placed = placement.front_page(o.unionByName(n).drop("placement"), n, spark.createDataFrame(given, "id string, placement string"))
    return [(r.id, r.placement) for r in placement.display_order(placed).collect()]


def test_new_strong_stories_come_first(spark):
    old = [(f"old-{i}", i, "news", "high", None) for i in range(1, 8)]
    new = [(f"new-{i}", 10 + i, "news", "high", None) for i in range(1, 4)]
    given = [("old-1", "top")] + [(f"old-{i}", "main") for i in range(2, 8)] + [(f"new-{i}", "side") for i in range(1, 4)]
    got = front(spark, old, new, given)
    assert got[:7] == [("new-1", "top"), ("new-2", "main"), ("new-3", "main")] + [(f"old-{i}", "main") for i in range(1, 5)]
    assert [i for i, _ in got[7:]] == ["old-7", "old-6", "old-5"]


def test_weak_new_story_stays_back_and_nothing_new_changes_nothing(spark):
    old = [(f"old-{i}", i, "news", "high", None) for i in range(1, 8)]
    got = front(spark, old, [("weak", 20, "rumor", "low", None)], [("weak", "top")])
    assert got == [("old-1", "top")] + [(f"old-{i}", "main") for i in range(2, 8)] + [("weak", "side")]
    assert front(spark, old[:2], [], [("old-1", "main"), ("old-2", "top")]) == [("old-1", "main"), ("old-2", "top")]


def test_validate_placements_resolves_conflicts(spark):
    rows = [("r", "top", i, x) for i, x in enumerate(["a", "b"])] + [("r", "main", i, f"m{i}") for i in range(7)]
    rows += [("r", "side", 0, "a"), ("r", "side", 1, "s"), ("bad", "top", 0, "zzz")]
    valid = [("r", x) for x in ["a", "b", "s", "t"] + [f"m{i}" for i in range(7)]] + [("bad", "a")]
    got, rejected = placement.validate_placements(
        spark.createDataFrame(rows, "reply_id string, group string, pos int, id string"), spark.createDataFrame(valid, "reply_id string, id string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.placement, set()).add(r.id)
    assert by == {"top": {"a"}, "main": {f"m{i}" for i in range(6)}, "side": {"m6", "b", "s", "t"}}
    assert [r.reply_id for r in rejected.collect()] == ["bad"]


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_equal_sequential_choice(spark, seed):
    rng = random.Random(seed)
    wishes = []
    for run in range(3):
        taken, want = set(), []
        for f in range(12):
            mine = rng.sample(range(10), rng.randint(0, 5))
            wishes += [(run, f, f"a{i}", (i,)) for i in mine]
            free = [i for i in sorted(mine) if i not in taken]
            if free:
                taken.add(free[0])
                want.append((run, f, f"a{free[0]}"))
        wishes_all = want if run == 0 else wishes_all + want
    df = spark.createDataFrame(wishes, "run_id int, final_no int, id string, wish struct<k:int>")
    assert {tuple(r) for r in anchors.assign_anchors(df).collect()} == set(wishes_all)


def test_short_ids_shared_by_many_articles_are_ambiguous(spark):
    ids = spark.createDataFrame([(f"art-{i}-01",) for i in range(50)] + [("art-1-098",)], "id string")
    refs = spark.createDataFrame([("r", 0, "01"), ("r", 1, '"98"'), ("r", 2, "art-3-01"), ("r", 3, "098")], "reply_id string, pos int, ref string")
    got, ambiguous = lookups.resolve_short_ids(refs, ids)
    assert {(r.pos, r.id) for r in got.collect()} == {(1, "art-1-098"), (2, "art-3-01")}
    assert [r.pos for r in ambiguous.collect()] == [0]


def test_daily_run(spark):
    existing = art(spark, [(f"old-{i}", i, "news", "high", "top" if i == 0 else "side") for i in range(3)])
    long = "충분히 긴 본문입니다. " * 5
    raw = lambda *heads: '```json\n{"articles":[' + ",".join(f'{{"headline":"{h}","body":"{long}","category":"news","trust":"high"}}' for h in heads) + "]}\n```"
    scans = spark.createDataFrame([("c0", 0, raw("서버 장애 보고서", "신규 칩 수율 개선")), ("c1", 1, raw("서버 장애 보고서!", "데이터 센터 전력"))],
                                  "reply_id string, chunk_index bigint, raw string")
    now = F.lit("2026-04-24 08:00:00").cast("timestamp_ntz")
    new = daily.without_duplicates(daily.new_candidates(scans, now), existing)
    assert {r.id for r in new.collect()} == {"art-202604240800-01", "art-202604240800-02", "art-202604240800-04"}
    left = daily.drop_by_clusters(new, spark.createDataFrame([("v", '{"clusters":[{"keep":"01","drop":["4"]}]}')], "reply_id string, raw string"))
    left = daily.drop_by_cross_check(left, spark.createDataFrame([("v", '{"drop_new":["N1"]}'), ("w", "garbled")], "reply_id string, raw string"))
    assert [r.id for r in left.collect()] == ["art-202604240800-02"]
    shown = spark.createDataFrame([("p", "1", "old-0"), ("p", "2", "old-1"), ("p", "3", "old-2"), ("p", "4", "art-202604240800-02")], "reply_id string, short string, id string")
    reply = spark.createDataFrame([("p", '{"top":"1","main":["2"],"side":[]}')], "reply_id string, raw string")
    log = spark.createDataFrame([("2026-04-24 06:30:00", 1), ("2026-04-24 03:00:00", 1)], "t string, new_count bigint").select(F.col("t").cast("timestamp_ntz").alias("run_at"), "new_count")
    moved = left.withColumn("ord", F.col("ord") + 100).select(existing.columns)
    out = daily.place(existing, moved, reply, shown, log, "2026-04-24 08:00:00")
    got = {r.id: (r.placement, str(r.placed_at)) for r in out.articles.collect()}
    assert got["art-202604240800-02"][0] == "top" and got["old-0"] == ("main", "2026-04-24 08:00:00")
    assert out.decision_log.count() == 2 and out.rejected.count() == 0
    assert {r.id: r.placement for r in out.log_placements.collect()} == {i: p for i, (p, _) in got.items()}


def test_short_ids_of_five_digits_stay_whole(spark, tmp_path):
    numbers = [1234, 12340, 12341, 12342, 12343, 1235, 12350]
    docs = spark.createDataFrame([(n, "s", "l", "t") for n in numbers], "doc_id bigint, source string, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "0 AS toxic", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.pos, r.id) for r in QUERIES["resolve_short_ids"](spark, str(tmp_path)).collect()}
    # ``ord % 4`` tells the form of the ref, where 3 refers to nothing; tens are in both runs.
    assert got == {(1234, "art-2024-1234"), (12341, "art-2024-12341"), (12342, "art-2024-12342"), (12350, "art-2024-12350")}
    assert [r.pos for r in QUERIES["ambiguous_short_ids"](spark, str(tmp_path)).collect()] == [12340]
