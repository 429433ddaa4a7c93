"""Time headline queries on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from groupaudit.plans.catalog import QUERIES
from groupaudit.session import local_session

HEADLINE = [
    "a14_roc_auc_pooled",
    "a14_roc_auc_by_group",
    "a16_ece_equal_width",
    "a17_ece_equal_mass",
    "a21_subgroup_auc",
    "a22_confound_profile",
    "b02_cluster_bootstrap_auc",
    "b02_continuous_score",
    "b04_paired_bootstrap_delta",
    "b08_jackknife_auc",
    "d01_index_disjoint",
    "d09_no_lookahead",
    "j01_enrichment_reasons",
    "j07_caliper_matching",
    "j08_duplicate_content",
    "m01_out_of_fold",
    "m06_confound_battery",
    "m08_metadata_baseline",
    "s03_corpus_summary",
    "w01_stratified_group_folds",
    "w02_balanced_group_folds",
    "w07_rank_average",
    "w08_silence_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["a02_census"].fn(spark, sf_dir).toArrow()  # start the session before the clock
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
