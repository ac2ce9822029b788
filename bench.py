"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Each query runs to completion into a sink that keeps nothing. ``queries`` holds warm times
(second run); ``cold`` holds the first run in the same session. Search queries read a store of
passages, vectors and postings, which the first of them writes: that is in its cold time.
"""

import json
import os
import time

from quirework.plans.all_plans import QUERIES
from quirework.session import local_session

HEADLINE = [
    "collapse_whitespace",
    "running_lines",
    "normalize_pages",
    "qa_gate",
    "cells_markdown",
    "table_split",
    "prose_outside_tables",
    "section_asof",
    "prose_chunks",
    "chunk_documents",
    "chunk_dedup",
    "coverage_archived",
    "promote_chunks",
    "edition_overlap",
    "corpus_diff",
    "postings",
    "lexical_cover_topk",
    "dense_topk",
    "hybrid_retrieve",
    "rerank_topk",
    "pii_documents",
    "resolve_attempts",
    "threshold_sweep",
    "quota_batch",
    "ingest_stream",
]


def run(spark, plan, sf_dir: str) -> float:
    started = time.time()
    plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "quirework-bench")
    run(spark, QUERIES["page_counts"], sf_dir)
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = run(spark, QUERIES[name], sf_dir)
        warm[name] = run(spark, QUERIES[name], sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
