"""Headline-query timings.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is forced end to end with a ``noop`` write (nothing is collected
to the driver); ``value`` is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "validate_reason", "triage_breakdown", "category_relevance", "clean_text", "prepare_feed",
    "dedup_text", "stratified_split", "build_cases", "list_page", "volume_by_day", "apply_status",
    "notes_for_case", "tokens", "tfidf", "similar_dense", "similar_lexical", "embed_cases",
    "index_snapshot", "decode_heads", "per_class", "bench_results", "stream_status", "stream_volume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from casework.session import build_session
    from casework.plans import catalogue

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="casework-bench")
    qs = catalogue.queries()
    # warm the JVM (codegen, class loading) outside the timed section
    qs["text_lengths"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times, rows = {}, {}
    for n in names:
        t0 = time.time()
        df = qs[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "n_queries": len(times)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
