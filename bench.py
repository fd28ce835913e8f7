"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from nearfield.catalog import QUERIES  # noqa: E402
from nearfield.session import local_session  # noqa: E402

HEADLINE = (
    "knn_flat",
    "knn_flat_l2",
    "knn_bruteforce",
    "knn_exact",
    "knn_ivf_flat",
    "knn_tree_rerank",
    "knn_lsh",
    "rerank_exact",
    "filtered_search",
    "recall_at_p",
    "detail_rows",
    "search_by_text",
    "search_by_caption",
    "search_results",
    "hash_encoder",
    "embed_texts",
    "read_captions_jsonl",
    "dedup_keep_first",
    "relevant_ids_by_query",
    "upsert",
    "mean_pool",
)
RUNS = 4


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE[:2]:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in only or HEADLINE:
        timings = []
        # The first run warms code paths up; every run builds a new DataFrame, since collecting
        # the same one twice would reuse finished shuffle stages.
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timings[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
