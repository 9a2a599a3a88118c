"""Times the headline queries: BENCH_SF_DIR, BENCH_CPUS. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recallgrid.catalog import registered  # noqa: E402
from recallgrid.session import build_session  # noqa: E402
from recallgrid.sources.views import Tables  # noqa: E402

HEADLINE = [
    "J1_lexical_search", "J2_vector_search", "J3_hybrid_search", "J4_lexical_fallback", "J5_rare_term_lane", "C1_postings_join",
    "C2_vector_scan", "C5_contradiction_candidates", "C12_co_occurrence", "C23_version_chain",
    "A16_lexical_index", "D1_stream_health", "D4_hourly_metrics", "D8_stream_summary", "E2_rank_fusion", "E7_prefix_twins",
    "G3_html_report", "G5_redaction_report", "G8_transcript_parts", "H1_query_annotation", "H4_event_dates", "I6_graph_boost", "I7_surprise_importance",
    "K3_edge_upsert", "K7_weak_tie_walk", "K8_stream_kmeans", "LC1_ingest", "LC6_consolidation", "LC10_decay", "LC12_retention_purge",
    "N1_repeated_queries", "N8_combined_advisories", "M1_hourly_metrics_stream", "M5_search_store_gap",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), "16g")
    registered.QUERIES["D24_active_streams"](spark, path).collect()  # start the JVM before the clock
    times, errors = {}, {}
    if not sys.argv[1:]:
        # the stored index is written once and searched by many; it is timed apart
        start = time.perf_counter()
        Tables(spark, path).stored_index
        times["index_write"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        try:
            registered.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)[:200]
        print(f"{name} {times.get(name, 'error')}", file=sys.stderr, flush=True)
    out = {"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(path.rstrip("/")), "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
