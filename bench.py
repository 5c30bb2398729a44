"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores, BENCH_KEYS other keys.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from ledgerloom.plans import registry  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINES = (
    "prepare_batch topk_per_collection hashed_search hashed_embed embed_with pack_chunks chunk_locators heading_paths "
    "by_course week_load_by_course daily_load next_up busiest_days stretches grade_summary grade_distribution gpa "
    "reconcile is_done rebuild_or_upsert store_sync_actions ics_events rrule_expand toc_flatten stream_week_load stream_dedup"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    keys = os.environ.get("BENCH_KEYS", "").split() or HEADLINES
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    # Start the Python workers and the code generator once, outside the clock.
    queries["embed_with"](spark, sf_dir).limit(1).collect()
    queries["by_kind"](spark, sf_dir).collect()
    times = {}
    for key in keys:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    chunks = queries["pack_chunks"](spark, sf_dir).count()
    embedded = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "chunks_packed_per_sec": round(chunks / times["pack_chunks"], 1) if "pack_chunks" in times else None,
                "documents_embedded_per_sec": round(embedded / times["embed_with"], 1) if "embed_with" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
