"""Python stages run on workers that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_queries_run_on_bare_workers(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import corpus_pipeline
from postmill.llm.queries import QUERIES
from postmill.session import build_session
sys.path.remove({str(ROOT)!r})
spark = build_session("local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__checkpoint__dir={str(tmp_path)!r})
for n in ("op4_", "op8_", "op10_", "op11_", "op12_", "op13_"):
    name = next(q for q in QUERIES if q.startswith(n))
    print("rows", name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
print("rows pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.count("rows ") == 7, out.stderr[-3000:]
