"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellsift.plans import catalog  # noqa: E402
from cellsift.session import build_session  # noqa: E402

HEADLINES = (
    "d02_cluster_histogram",
    "d08_box_totals",
    "d09_phase_histogram",
    "d11_kernel_density",
    "d05_kl_matrix",
    "c05_nearest_centre",
    "e01_sliding_sequences",
    "e03_strata",
    "j03_maxent_boxes",
    "j04_random_points",
    "j05_maxent_points",
    "j06_phase_space_points",
    "j07_latin_hypercube_points",
    "j08_stratified_points",
    "j11_kmeans_centres",
    "j13_standard_scaling",
    "j16_curation_job",
    "j17_training_packed",
    "a01_raw_grid_scan",
    "d23_node_energy",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load_all()
    spark = build_session(cores, "bench", int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median warm seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "cores": cores,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
