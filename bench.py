"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from transitframe.plans import catalog  # noqa: E402
from transitframe.session import local_session  # noqa: E402

HEADLINES = (
    "N2_comparison_key", "Q5_street_search", "Q6_street_search_at", "Q9_geojson_all", "AG2_distinct_streets", "AG11_service_cube",
    "WN3_repeated_streets", "WN4_neighbourhood_codes", "GE2_path_lengths", "GE3_resample", "GE8_zone_share", "GE9_terminal_or_zone",
    "RC7_neighbourhood_issues", "RC8_equal_itineraries", "JN5_reuse_codes", "SC16_timetable_lines", "SC19_active_lines",
    "ER2_resolve_addresses", "ER7_name_clusters", "ER8_canonical_by_code", "ER9_canonical_by_key", "ER11_merge_pairs", "MG4_synchronise",
    "MG5_apply_itineraries", "MG8_publish_summary", "QR3_general_diagnosis",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), shuffle_partitions=max(8, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    catalog.QUERIES["Q5_street_search"](spark, sf_dir).count()  # warm-up: class loading and file listing
    times: dict[str, float] = {}
    for name in HEADLINES:
        if only and name not in only:
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
