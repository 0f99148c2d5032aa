"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postmill.plans.catalog import QUERIES  # noqa: E402
from postmill.session import build_session  # noqa: E402

HEADLINE = [
    "recent_top_by_source", "context_selection", "source_stats", "upsert", "insert_ignore", "normalize_posts",
    "exact_title_dedup", "title_similarity_pairs", "near_dup_dedup", "pack_chunks", "pack_one_stream",
    "top_keywords", "keyword_snippets", "topic_evidence", "build_term_index", "bm25_search",
    "parse_article_replies", "parse_merge_replies", "validate_placements", "front_page", "merge_anchor",
    "downgrade_unsourced_claims", "product_story_guard", "daily_documents", "normalize_hackernews",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "postmill-bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
