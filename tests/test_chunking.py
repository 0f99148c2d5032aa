import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import chunking

SCHEMA = "channel string, ordinal bigint, block string"


def greedy(weights, limit):
    """Chunk number of every message by the plain loop."""
    out, chunk, total, empty = [], 0, 0, True
    for w in weights:
        if not empty and total + w > limit:
            chunk, total = chunk + 1, 0
        out.append(chunk)
        total, empty = total + w, False
    return out


@pytest.mark.parametrize("seed,block,gap", [(1, 7, 1), (2, 50_000, 1), (3, 5, 3)])
def test_packing_equals_greedy_fold(spark, seed, block, gap):
    rng = random.Random(seed)
    rows, want = [], {}
    for c, n in [("hot", 700), ("cold", 3), ("one", 1)]:
        weights = [rng.choice([0, 0, 3, 9, 40, 130]) for _ in range(n)]
        for i, (w, k) in enumerate(zip(weights, greedy(weights, 100))):
            rows.append((c, i * gap, "x" * w))
            want[(c, i * gap)] = k
    df = spark.createDataFrame(rows, SCHEMA)
    got = chunking.chunk_index(df, F.length("block"), 100, block)
    assert {(r.channel, r.ordinal): r.chunk_index for r in got.collect()} == want


def test_deep_block_merging(spark, monkeypatch):
    monkeypatch.setattr(chunking, "FAN_IN", 2)
    rng = random.Random(5)
    weights = [rng.choice([1, 2, 5, 30]) for _ in range(300)]
    df = spark.createDataFrame([("c", i, "x" * w) for i, w in enumerate(weights)], SCHEMA)
    got = chunking.chunk_index(df, F.length("block"), 20, 16)
    assert [r.chunk_index for r in sorted(got.collect(), key=lambda r: r.ordinal)] == greedy(weights, 20)


def test_chunk_texts_keep_every_message(spark):
    rows = [("c", i, f"[{i}]" + "y" * (i * 7 % 50) + "\n") for i in range(60)] + [("c", -1, "preamble")]
    df = spark.createDataFrame(rows, SCHEMA)
    chunks = sorted(chunking.pack_chunks(df, 100).collect(), key=lambda r: r.chunk_index)
    assert "".join(c.text for c in chunks) == "".join(t for _, i, t in rows if i >= 0)
    assert all(c.n_chars <= 100 or c.n_messages == 1 for c in chunks)
    tokens = sorted(chunking.pack_chunks_tokens(df, 30).collect(), key=lambda r: r.chunk_index)
    assert tokens[0].text.startswith("preamble\n\n[0]") and tokens[0].first_ordinal == -1


def test_pending_and_annotate(spark):
    chunks = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b")], "channel string, chunk_index bigint, text string")
    done = spark.createDataFrame([("c", 0)], "channel string, chunk_index bigint")
    left = chunking.pending_chunks(chunks, done)
    out = chunking.annotate(left, lambda b: b.assign(summary=b["text"].str.upper())[["chunk_index", "summary"]],
                            "chunk_index bigint, summary string")
    assert [tuple(r) for r in out.collect()] == [(1, "B")]


@pytest.mark.parametrize("block", [16, 50])
def test_long_and_short_channels_pack_alike(spark, block):
    rng = random.Random(11)
    rows = [(c, i, f"[{i}]" + "z" * rng.choice([0, 3, 60, 400])) for c, n in [("a", 90), ("b", 17), ("c", 4), ("d", 1)] for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    by_row, chained = (chunking.pack_chunks(df, 200, block=b) for b in (50_000, block))
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, chained.select(by_row.columns).collect()))
    for plan in (by_row, chained):
        assert "InPandas" not in plan._jdf.queryExecution().executedPlan().toString()
    empty = chunking.pack_chunks(df.limit(0), 200)
    assert empty.count() == 0


def test_calls_are_tried_again_stored_and_resumed(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def flaky(row):
        name = row["text"].iat[0]
        seen = len(list(log.glob(f"{name}.*")))
        (log / f"{name}.{seen}").write_text("")
        if name == "bad" and seen < 9 or name == "twice" and seen < 2:
            raise RuntimeError(f"no reply for {name}")
        return row.assign(summary=name.upper(), part=0)[["summary", "part"]].iloc[[0] * (2 if name == "two" else 1)] if name != "none" else row.assign(summary="", part=0)[["summary", "part"]].iloc[:0]

    rows = [(1, "good"), (2, "twice"), (3, "bad"), (4, "two"), (5, "none"), (1, "good")]
    df = spark.createDataFrame(rows, "id int, text string")
    path, form = str(tmp_path / "outcomes"), "summary string, part int"
    results, failed = chunking.annotate_stored(df.where("id < 4"), flaky, form, path)
    assert sorted((r.id, r.summary) for r in results.collect()) == [(1, "GOOD"), (1, "GOOD"), (2, "TWICE")]
    assert [(r.id, r.attempts, r.error) for r in failed.collect()] == [(3, 5, "RuntimeError: no reply for bad")]
    results, failed = chunking.annotate_stored(df, flaky, form, path, waves=2)
    assert sorted((r.id, r.summary) for r in results.collect()) == [(1, "GOOD"), (1, "GOOD"), (2, "TWICE"), (3, "BAD"), (4, "TWO"), (4, "TWO")]
    assert failed.count() == 0
    calls = {n: len(list(log.glob(f"{n}.*"))) for n in ("good", "twice", "bad", "two", "none")}
    assert calls == {"good": 1, "twice": 3, "bad": 10, "two": 1, "none": 1}
