"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.plans import all_entries  # noqa: E402
from tabloom.session import local_session  # noqa: E402

HEADLINE = [
    "oof_encoding_auc_by_fold", "quality_report", "numeric_describe", "most_common_values", "derived_feature_registry",
    "one_column_rule_scores", "route_features", "frequency_and_rarity", "key_set_encoding_oof", "nested_target_encoding",
    "rate_logits_at_many_keys", "stratified_kfold", "rank_transform", "grouped_auc_by_member", "cliffs_delta_interval",
    "spearman_correlations", "bernoulli_draw_ceiling", "nested_stack_scores", "boosted_trees_early_stop", "soft_neighbour_vote",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    entries["split_report"].run(spark, sf_dir).collect()  # warm the JVM
    times = {}
    for name in names:
        started = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
