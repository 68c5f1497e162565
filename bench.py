"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query is written to Spark's no-op sink once to warm up and then timed once, so every column of every
row is computed and nothing is collected.
"""
import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["class_balance", "signal_twins", "signal_families", "ordered_dedup", "roc_auc_by_flag", "spearman",
            "cluster_bootstrap_auc", "permutation_p_value", "segment_stitch", "gap_segments", "global_median_view",
            "transit_diagnostics", "sibling_removal", "binned_spectrum", "band_statistic", "leave_one_host_out",
            "weighted_quantiles", "shape_features", "planet_probabilities", "rank_distribution", "posterior_summary",
            "evidence_sentences", "work_sessions"]


def full_size():
    """The sizes in use, where the registered queries keep replicates and bins small enough for their SQL twins."""
    from surveyframe.operators import resample, timeseries
    from surveyframe.plans.metrics import scored
    from surveyframe.plans.timeseries import folded

    return {"cluster_bootstrap_2000_replicates": lambda t: resample.auc_interval(scored(t), "star", "y", "s", 2000),
            "global_views_2001_bins": lambda t: timeseries.global_view(folded(t), ["user_id"], 2001)}


def main():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("surveyframe-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from surveyframe.plans.registry import Tables, load_all

    registry = {n: q.run for n, q in load_all().items()}
    registry.update(full_size())
    names = sys.argv[1:] or [*HEADLINE, *full_size()]
    times = {}
    for n in names:
        for _ in range(2):
            t0 = time.perf_counter()
            registry[n](Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
