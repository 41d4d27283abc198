"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores,
BENCH_RUNS the runs per query (the median counts), BENCH_QUERIES a comma-separated
choice of queries ("all" for every registered one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from factlake.plans.queries import QUERIES
from factlake.session import local_session

HEADLINE = [
    "facts_best",
    "latest_metric",
    "industry_topk",
    "filtered_topk",
    "facts_search",
    "answer_questions",
    "extract_to_facts",
    "flatten_facts",
    "drop_last_page",
    "facts_replace_by_doc",
    "documents_upsert",
    "chat_context",
    "chunk_rows",
    "embed_chunks",
    "knn_cosine",
    "incremental_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    choice = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if choice == "all" else choice.split(",") if choice else HEADLINE
    spark = local_session(cores, app="factlake-bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cores,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
