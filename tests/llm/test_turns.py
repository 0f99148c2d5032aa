"""Passages are sought in turns, and a turn's pieces lie on disk only until its spans are known."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from postmill.llm import suffixes

ROOT = Path(__file__).resolve().parents[2]


def test_turns_share_the_pieces():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 2000, dtype=np.uint8)) for _ in range(200)]

    def pieces(*turn):
        rows = [r for f in suffixes.block_pieces(list(range(200)), texts, 25, 50, *turn) for r in zip(f["shard"], f["data"]) if r[0] >= 0]
        assert {shard for shard, _ in rows} == set(range(25))
        out = []
        for _, data in rows:
            doc, place, length, _ = suffixes.opened(data)
            out += zip(doc.tolist(), place.tolist(), length.tolist())
        return out, sum(len(data) for _, data in rows)

    whole, size = pieces()
    turns = [pieces(turn, 2) for turn in range(2)]
    assert sorted(turns[0][0] + turns[1][0]) == sorted(whole)
    assert all(n < 0.6 * size for _, n in turns)


def test_no_pieces_stay_on_disk(tmp_path):
    code = f"""
import random, sys, time
from pathlib import Path
sys.path.insert(0, {str(ROOT)!r})
from postmill.llm import common, suffixes
from postmill.session import build_session
spark = build_session("local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir={str(tmp_path / "tables")!r}, spark__local__dir={str(tmp_path / "local")!r})
rng = random.Random(5)
docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefghij", k=2000))) for i in range(500)], "doc_id bigint, text string").repartition(2)
spark.conf.set(common.RELEASE, "false") if hasattr(common, "RELEASE") else None
kept = suffixes.remove_repeats(docs)
held = lambda: sum(f.stat().st_size for f in Path({str(tmp_path / "local")!r}).rglob("shuffle_*.data"))
for _ in range(40):
    if held():
        time.sleep(0.25)
print("bytes", held(), kept.where("n_removed = 0").count(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false"))
"""
    env = os.environ | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "bytes 0 500 false" in out.stdout, out.stdout + out.stderr[-3000:]
