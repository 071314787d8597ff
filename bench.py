"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from kinmat.registered.queries import QUERIES  # noqa: E402
from kinmat.session import local_session  # noqa: E402

HEADLINE = (
    "pair_truth_random",
    "pair_truth_extreme",
    "full_rows_random",
    "full_rows_all",
    "all_pairs_matrix",
    "neighbours_rows",
    "topk_multi",
    "compare_slice_summary",
    "compare_rows_summary",
    "topk_check_summary",
    "topk_function_summary",
    "diff_runs_mismatches",
    "sketch_vectors",
    "kmer_jaccard_pairs",
    "edge_case_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    # Start the JVM's and the Python workers' own machinery outside the clock.
    spark.range(1000).repartition(int(cores)).mapInArrow(lambda batches: batches, "id long").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
