"""Headline timings: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. Every
query is written to a sink that keeps nothing, so whole results are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelworks.plans.queries import registry  # noqa: E402
from panelworks.session import build_session  # noqa: E402

HEADLINE = (
    "panel_label_counts", "pan_16_student_panel", "sta_04_student_status", "cln_10_clean_history", "can_08_history",
    "can_09_archive", "spl_02_embargo_split", "spl_04_rolling_origin", "fea_02_scale", "met_01_to_06_ranking",
    "met_08_class_report", "met_10_top_share", "met_13_calibration_fit", "met_14_bootstrap_auc", "met_15_paired_delta",
    "mod_05_evaluations", "fai_02_subgroups", "drf_05_feature_drift", "drf_08_stored_cycles", "drf_09_segment_psi",
    "cmp_07_comparison", "prf_01_profile", "sen_04_horizons", "sen_05_relabel", "rep_11_overview",
    "rep_17_progress_by_status", "rep_22_feature_stats", "rep_25_dropout_top20", "mod_01_gradient_boosting",
    "mod_04_competition",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    found, times = registry(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    for name in wanted:
        start = time.time()
        found[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
