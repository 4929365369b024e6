from collections import Counter

from pyspark.sql import functions as F

from peakloom.operators.skew import bucketed_prefix, hot_keys, salted_join, tree_aggregate, tree_heaps
from peakloom.plans.training import large_values, per_key


def test_tree_aggregate_equals_group_by(spark):
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 11}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(40)
    got = {r.k: (r.n, r.s, r.m) for r in tree_aggregate(df, ["k"], {"n": (F.lit(1), "sum"), "s": (F.col("v"), "sum"), "m": (F.col("v"), "max")}, fan_in=3).collect()}
    want = {}
    for k, v in rows:
        n, s, m = want.get(k, (0, 0, -1))
        want[k] = (n + 1, s + v, max(m, v))
    assert got == want


def test_tree_aggregate_of_nothing(spark):
    assert tree_aggregate(spark.createDataFrame([], "k string, v bigint"), ["k"], {"n": (F.lit(1), "sum")}).count() == 0


def test_tree_heaps_equal_sorting(spark):
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 11}", (i * 37) % 101 if i % 5 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint, i bigint").repartition(23)
    got = {}
    for r in tree_heaps(df, ["k"], F.struct(F.col("v").isNull().alias("n"), "v", "i"), 4, fan_in=3).collect():
        got.setdefault(r.k, []).append((r.value.v, r.value.i))
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        want.setdefault(k, []).append((v, i))
    assert got == {k: x[:4] for k, x in want.items()}
    assert tree_heaps(df.limit(0), ["k"], F.col("i"), 4).count() == 0


def test_salted_join_equals_join(spark):
    rows = [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k4", 2), ("k8", 3)], "k string, v int")
    hot = hot_keys(left.where("k is not null").groupBy("k").agg(F.count("*").alias("n")), "k", share=0.1)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("left", "inner"):
        got = salted_join(left, right, "k", hot, "id", how).select("id", "k", "v")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()))


def test_bucketed_prefix_is_a_running_sum(spark):
    rows = [("a" if i % 4 else None, i, i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "p string, id bigint, v bigint")
    got = bucketed_prefix(df, ["p"], ["id"], F.col("v"), "before", buckets=16).collect()
    for p in ("a", None):
        part = sorted((r.before, r.v) for r in got if r.p == p)
        total, spans = sum(v for _, v in part), [(b, b + v) for b, v in part if v]
        assert spans[0][0] == 0 and spans[-1][1] == total and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_per_key_goes_through_the_tree_in_one_scan(spark, data, tmp_path):
    t = spark.read.parquet(f"{data}/train_spectra.parquet")
    t.repartition(9).write.parquet(f"{tmp_path}/t")
    t = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/t")
    for df, limit in ((per_key(t), 4), (large_values(t), 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "__chunk" in plan and plan.count("Exchange hashpartitioning") in (limit - 1, limit)
    rows = spark.createDataFrame([(1, "A", "q", "x", [1.0, None], [1.0, 1.0]), (2, "A", "q", "x", [None, 1.0], [1.0, 1.0])], "rid bigint, inchikey14 string, instrument_type string, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>")
    assert {r.n_spectra for r in per_key(rows).collect()} == {2}


SCHEMA = "rid bigint, inchikey14 string, instrument_type string, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, n bigint, value string, total bigint"


def test_per_key_of_odd_rows(spark):
    rows = [(1, "A", None, "x", [1.0], [1.0], 9, "v", 0), (1, "A", None, "x", [1.0], [1.0], 9, "v", 0), (2, None, "", None, None, None, 9, "v", 0), (3, "A", "t" * 10_000, "y", [], [], 9, "v", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.field, r.value): r for r in per_key(df).collect()}
    a = got["inchikey14", "A"]
    assert (a.n_records, a.n_spectra, a.n_peaks, a.n_adducts) == (3, 2, 2, 2)
    assert got["inchikey14", None].n_spectra == 0 and got["instrument_type", ""].n_records == 1
    assert {tuple(r) for r in large_values(df).collect()} == {("inchikey14", "A"), ("instrument_type", ""), ("instrument_type", "t" * 10_000)}
    assert per_key(df.limit(0)).count() == 0 and large_values(df.limit(0)).count() == 0
