"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioframe.plans import QUERIES  # noqa: E402
from folioframe.session import local_session  # noqa: E402

HEADLINE = [
    "c3_region_merge", "j1_mergeable_pairs", "a1_components", "a3_region_split", "c1_box_extraction", "c2_ocr_order",
    "c4_translate", "c8_page_job", "r13_tile_round_trip", "r21_f18_components", "x21_language_detection",
    "x3_bracket_repair", "c5_text_mask", "c7_panel_layout", "c6_mask_refine",
]
#: No further query starts after this many seconds; the report names those left out.
BUDGET = float(os.environ.get("BENCH_BUDGET", "420"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times, left_out = {}, []
    begin = time.time()
    for name in names:
        start = time.time()
        if start - begin > BUDGET:
            left_out.append(name)
            continue
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cpus, "spark": spark.version, "not_run": left_out}))
    spark.stop()


if __name__ == "__main__":
    main()
