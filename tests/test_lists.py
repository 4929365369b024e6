import pytest
from pyspark.sql import functions as F

from peakloom.operators import evaluation as V
from peakloom.operators import fusion as U
from peakloom.operators import joins as J
from peakloom.operators import ranking as R


def ranked(spark, **lists):
    return spark.createDataFrame([(m, k, i + 1) for m, ks in lists.items() for i, k in enumerate(ks)] or [], "mid string, key string, rank bigint")


def order(df, mid="m"):
    return [r.key for r in df.where(F.col("mid") == mid).orderBy("rank").collect()]


def test_merges(spark):
    base, extra = ranked(spark, m="ABC"), ranked(spark, m="XY")
    assert order(U.slot_insert(base, extra, [2, 4])) == list("AXBYC")
    assert order(U.slot_insert(base, extra, [2, 4], promote=True)) == list("XABYC")
    assert order(U.block_insert(ranked(spark, m="ABCDE"), ranked(spark, m="AXYB"), 3, 5)) == list("ABCXYDE")
    assert order(U.interleave(base, extra, 1)) == list("AXBYC")[:0] + list("ABXCY")
    assert order(U.pattern_merge(base, extra, "EPP")) == list("AXYBC")
    assert order(U.by_position([(base, 2 * F.col("rank")), (ranked(spark, m="BX"), 2 * F.col("rank") + 1)])) == list("ABXC")


def test_rerank_moves_only_within_groups(spark):
    df = spark.createDataFrame([("m", k, i + 1, g, s) for i, (k, g, s) in enumerate([("a", "x", 0.1), ("b", "y", 0.5), ("c", "x", 0.9), ("d", None, 5.0), ("e", "y", 0.5)])], "mid string, key string, rank bigint, g string, s double")
    assert order(U.rerank_in_groups(df, "g", F.col("s"))) == list("cbade")


def test_weight_zero_is_identity(spark):
    df = ranked(spark, m="QWERTY")
    assert order(U.reciprocal_rank_fusion([(df, 1.0), (ranked(spark, m="YTREWQ"), 0.0)])) == list("QWERTY")


def test_reciprocal_ranks(spark):
    lists = ranked(spark, one="T", three="abT", far=[f"k{i}" for i in range(25)] + ["T"], none="abc")
    truth = spark.createDataFrame([(m, "T") for m in ("one", "three", "far", "none", "missing")], "mid string, key string")
    got = {r.mid: r.r for r in V.answer_ranks(lists, truth).collect()}
    assert got == {"one": 1, "three": 3, "far": 26, "none": None, "missing": None}
    s = V.summary(V.answer_ranks(lists, truth)).first()
    assert s.n == 5 and s.mrr == pytest.approx((1 + 1 / 3) / 5, abs=1e-6) and s.recall_25 == pytest.approx(0.4)


def test_list_dedup_and_padding(spark):
    df = ranked(spark, m="ABABC")
    assert order(R.list_dedup(df, ["mid"], "key", "rank")) == list("ABC")
    p = U.pad(R.list_dedup(df, ["mid"], "key", "rank"), spark.createDataFrame([("m",), ("n",)], "mid string"), 4, "-")
    assert order(p) == ["A", "B", "C", "-"] and order(p, "n") == ["-"] * 4
    assert {r.mid: r.problem for r in U.problems(df, spark.createDataFrame([("m",), ("z",)], "mid string")).collect()} == {"m": "repeated entry", "z": "missing"}


def test_isotonic(spark):
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate([5.0, 1.0, 3.0, 2.0])], "mid string, rank int, x double")
    got = [r.fit for r in R.isotonic_decreasing(df, ["mid"], "rank", "x").orderBy("rank").collect()]
    assert got == [5.0, 2.0, 2.0, 2.0]


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "u int, x double")
    r = V.bootstrap(df, "u", "x", 100).first()
    assert r.lo < r.mean < r.hi and r.hi - r.lo < 1


def test_range_join_is_exact(spark):
    w = spark.createDataFrame([(i, i * 0.37, i * 0.37 + (i % 5)) for i in range(60)] + [(100, None, 3.0), (101, float("nan"), 1.0), (102, 5.0, 1.0)], "w int, lo double, hi double")
    p = spark.createDataFrame([(i, i * 0.11) for i in range(200)] + [(999, None), (998, float("nan"))], "p int, v double")
    got = {(r.w, r.p) for r in J.range_join(w, p, "lo", "hi", "v", 1.0).collect()}
    assert got == {(i, k) for i in range(60) for k in range(200) if i * 0.37 <= k * 0.11 <= i * 0.37 + (i % 5)}
    assert {r.p for r in J.range_join(w, p, "lo", "hi", "v", 1.0, how="semi").collect()} == {k for _, k in got}
    assert J.range_join(w.limit(0), p, "lo", "hi", "v", 1.0).count() == 0


def test_not_in_ignores_nulls(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert [r.k for r in J.not_in(a, spark.createDataFrame([("y",), (None,)], "k string"), "k").collect()] == ["x"]


def test_mix_calibration(spark):
    import numpy as np

    from peakloom.operators import evaluation as V

    rng = np.random.default_rng(1)
    for true in ([0.2, 0.5, 0.1], [0.9, 0.4, 0.0]):
        x = rng.random((8, 3))
        w = V.capped_weights(x, x @ true)
        grid = np.array([(a, b, c) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1, 41) for c in np.linspace(0, 1, 41) if a + b + c <= 1 + 1e-9])
        loss = lambda v: ((x @ np.asarray(v).T - (x @ true)[:, None]) ** 2).sum(0)
        assert w.min() >= 0 and w.sum() <= 1 + 1e-9 and loss([w])[0] <= loss(grid).min() + 1e-9
        if sum(true) <= 1:
            assert np.allclose(w, true, atol=1e-4)
    profiles = spark.createDataFrame([(f"s{i}", f"c{j}", float(x[i, j])) for i in range(8) for j in range(3)], "system string, class string, x double")
    seen = spark.createDataFrame([(f"s{i}", float(x[i] @ [0.2, 0.5, 0.1])) for i in range(8)], "system string, y double")
    got = {(r.kind, r.name): r.value for r in V.mix_calibration(profiles, seen).collect()}
    assert [round(got["weight", f"c{j}"], 3) for j in range(3)] == [0.2, 0.5, 0.1] and got["rmse", "all"] < 1e-3
    assert abs(got["left_out", "s3"] - x[3] @ [0.2, 0.5, 0.1]) < 1e-3
    assert V.mix_calibration(profiles.limit(0), seen.limit(0)).count() == 0
