"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local parallelism. Rows go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "cell_groups", "rule_ledger", "event_profile", "attach_loss", "two_part_summary",
    "lag_sweep", "clean_layer", "value_profile", "pip_join", "bilinear_sample",
    "spaced_sample", "cap_sample", "balance_table", "exact_rank_match", "score_fit",
    "nearest_match", "panel_manifest", "subset_levels", "att_dynamic", "etwfe_event",
    "etwfe_cluster_se", "estimate_kinds", "separation_table", "exclusion_table",
    "event_support", "support_cap",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from panelspark.queries import QUERIES
    from panelspark.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="panelspark-")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["event_profile"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
    out = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t0, 3)
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
