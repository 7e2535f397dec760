"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellframe.session import session  # noqa: E402

HEADLINE = {
    "structure_audit": "F04_F05_structure_audit",
    "cycle_master": "R01_R02_R03_P24_cycle_master",
    "cycle_sheet_labels": "R04_cycle_sheet_labels",
    "quantified_checks": "R09_J10_quantified_checks",
    "step_ends": "W14_J07_good_step_ends_from_step",
    "record_labels": "R07_R08_P30_record_labels",
    "aligned_series": "T01_aligned_series",
    "resampled_grid": "T02_T03_W10_resampled_grid",
    "early_features": "E01_E26_W11_W12_early_features",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cellframe.plans.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, key in HEADLINE.items():
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
