"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line; the value is their sum."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidepool.queries import QUERIES

HEADLINE = (
    "b15_head", "c1_within", "c2_far", "h1_h5_spectrum", "h15_filtered", "c3_nearest", "c4_synced", "c6_trials", "d1_skip_sums", "d5_z_scores", "d9_median_split", "d12_histogram", "d24_chi_square", "d33_auc",
    "d34_youden", "e1_difference", "e2_smoothed", "e4_autocovariance", "e7_bouts", "e14_leave_one_out", "e18_mid_ranks", "h6_spectrogram", "h9_band_means", "k7_fdr_adjusted", "k8_rank_sum",
    "k1_permutations", "m1_m8_lda", "m12_grid", "j6_j8_states", "s3_top", "s8_pivoted",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e7_bouts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's code and the Python workers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
