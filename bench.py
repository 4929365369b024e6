"""Runs headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Range, similarity and evaluation work of the reference first; then the per-key and training-data operators.
HEADLINE = [
    "j2_range_join", "j4_fallback_tolerance", "j24_analog_window", "j20_nearest_spectra", "k2_clean", "k4_entropy_weights", "k5_entropy_similarity", "k9_modified_cosine",
    "k16_votes", "k20_tanimoto_in_window", "k28_peak_explanation", "k34_rules_by_support", "a5_summary", "a8_duplicate_census", "a15_max_then_sum", "n2_capped_sample", "t6_priority_dedup", "r2_rrf", "r10_rerank_in_groups",
    "v1_summary", "v7_bootstrap", "h_pricing_summary", "p5_found", "p5_per_key",
    "p1_found", "p1_splits", "p2_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_mix", "p9_found",
]


def main() -> None:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from peakloom.session import session

    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    entry = importlib.import_module("__spark_entry__")
    known = entry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the first job's start-up isn't a query's
    times = {}
    for name in HEADLINE:
        if name in known:
            began = time.time()
            known[name](spark, SF).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    # peak lists that k5 and k9 compare, each query with every record of its adduct and precursor
    from pyspark.sql import functions as F

    from peakloom.operators.joins import tolerance_join

    t = spark.read.parquet(f"{SF}/train_spectra.parquet").where("adduct is not null and precursor_mz > 0 and size(ms2_mzs) > 0")
    points = t.groupBy("adduct", F.col("precursor_mz").alias("p")).agg(F.count("*").alias("c"))
    pairs = tolerance_join(t.where("rid % 100 = 0").select("adduct", F.col("precursor_mz").alias("q")), points, "q", "p", da=0.01, on=("adduct",)).agg(F.sum("c")).first()[0] or 0
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")), "pairs_of_k5": pairs}))
    spark.stop()


if __name__ == "__main__":
    main()
