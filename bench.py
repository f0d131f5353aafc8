"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.  Every query runs
in full into a sink that discards rows; the first run of a trivial job warms
the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b2_global_index", "b3_season_slice", "b4_exclude_old_cohorts", "b11_forward_fill", "b17_sales_target",
    "c1_item_totals", "c2_item_totals_by_season", "c4_distinct_count", "c5_null_profile", "c7_histogram",
    "c9_one_hot_sum", "c10_concat_text", "cleaned_season_totals",
    "d1_attach_attributes", "d2_attach_category", "d6_pair_sorted", "d10_attach_files", "d12_assign_color_folder",
    "e6_sum_vectors", "e7_activate_gelu", "e8_linear_project", "e9_embed_text",
    "f1_fit_boxcox", "f4_quantiles_of_lines", "f6_unscale", "f8_fit_standard",
    "g2_nearest", "g3_nearest_cosine", "g4_nearest_pruned", "g6_neighbor_residual", "g8_knn_regress", "g9_knn_grid",
    "b3_season_join", "b4_rule_table", "b15_tail", "e9_word_vectors", "h16_scaled_pipeline", "flow_neighbors",
    "h2_fit_linear", "h5_leaderboard", "h7_adjusted_smape", "h11_batched_mean", "h13_metric_by_category",
]


def main() -> None:
    from hemline.plans.all_queries import QUERIES
    from hemline.session import drop_scratch, local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    drop_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
