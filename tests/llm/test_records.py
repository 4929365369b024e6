"""Splits, survivors, capping and overlaps."""

import datetime as dt
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, same
from peakloom.functions.peaks import overlap
from peakloom.llm import capping, overlaps, queries, splits, survivors
from peakloom.session import table

K = [c * 14 for c in "ABCDEFGH"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    same(queries.queries()[name](spark, data), connect(data).sql(queries.oracle_sql()[name]))


# ---- splits
STRUCTS = "inchikey14 string, key string, rid bigint, group_key string"
RECORDS = "rid bigint, inchikey14 string, inchikey string, key string, group_key string, n bigint"


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    got = {r.node: r.label for r in splits.components(spark.createDataFrame(edges + [(None, "x"), ("y", "y")], "u string, v string")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root) if any(x in e for e in edges if e[0] != e[1])}


def test_chains_circles_and_odd_keys(spark):
    structs = spark.createDataFrame([(K[0], K[1], 1, "x"), (K[1], K[2], 1, "x"), (K[2], None, 1, "x"), (K[3], K[4], 1, "x"), (K[4], K[3], 1, "x"), (K[5], K[5], 1, "x"), (K[6], K[7], 1, "x"), (None, K[0], 1, "x"), (K[0], K[1], 1, "x")], STRUCTS)
    got = {r.key: r.group_key for r in splits.group_keys(structs).collect()}
    assert got == {K[0]: K[2], K[1]: K[2], K[2]: K[2], K[3]: K[3], K[4]: K[3], K[6]: K[7], K[7]: K[7]}
    records = spark.createDataFrame([(1, K[0], None, "k", "g", 0), (2, f" {K[2].lower()}\n", None, "k", "g", 0), (3, K[2], None, "k", "g", 0), (4, "?", f"InChIKey={K[6]}-ABCDEFGHIJ-N", "k", "g", 0), (5, None, None, "k", "g", 0), (6, "", "x" * 100_000, "k", "g", 0), (1, K[0], None, "k", "g", 0)], RECORDS)
    moved = sorted(map(tuple, splits.moved_records(records, structs).collect()))
    assert moved == [(1, K[2]), (1, K[2]), (2, K[2]), (4, K[7])]
    assert splits.moved_records(records.limit(0), structs).count() == 0 and splits.moved_records(records, structs.limit(0)).count() == 2


def test_closest_subset_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = {int(s): int(n) for s, n in zip(rng.integers(1, 30, 4), rng.integers(1, 4, 4))}
        goal = int(rng.integers(0, 80))
        take = splits.closest_subset(sizes, goal)
        assert all(take[s] <= sizes[s] for s in take)
        best = min(abs(sum(s * k for s, k in zip(sizes, ks)) - goal) for ks in itertools.product(*(range(n + 1) for n in sizes.values())))
        assert abs(sum(s * k for s, k in take.items()) - goal) == best


def test_quotas_cover_all_groups():
    for resolution in (1 << 22, 1000):
        q = splits.split_quotas({1: 40_000, 3: 500, 7_000: 1, 900: 3}, [("a", 0.8), ("b", 0.15), ("c", 0.05)], resolution)
        assert {s: sum(k for _, k in p) for s, p in q.items()} == {1: 40_000, 3: 500, 7_000: 1, 900: 3}
        total = sum(s * k for s, p in q.items() for _, k in p)
        share = {n: sum(s * k for s, p in q.items() for m, k in p if m == n) / total for n in "abc"}
        assert share == pytest.approx({"a": 0.8, "b": 0.15, "c": 0.05}, abs=1e-3)


def test_splits_keep_molecules_together(spark, data):
    t = lambda n: table(spark, data, n)
    rows = splits.assign_splits(t("train_spectra"), t("train_structs"), t("split_targets")).collect()
    assert len(rows) == t("train_spectra").count() == len({r.rid for r in rows})
    by = defaultdict(set)
    for r in rows:
        if r.group_key:
            by[r.group_key].add(r.split_name)
    assert all(len(v) == 1 for v in by.values())
    share = Counter(r.split_name for r in rows)
    assert {k: v / len(rows) for k, v in share.items()} == pytest.approx({"train": 0.8, "valid": 0.12, "holdout": 0.08}, abs=0.02)
    assert splits.assign_splits(t("train_spectra"), t("train_structs"), t("split_targets").limit(0)).count() == 0
    assert splits.assign_splits(t("train_spectra").limit(0), t("train_structs"), t("split_targets")).count() == 0


# ---- survivors
PUB = "ik string, cid bigint, smiles string, mass double, trust int, updated_at timestamp, n bigint, lo bigint, salt int, r_any int"


def test_survivors_of_odd_rows(spark):
    d = lambda y: dt.datetime(y, 1, 1)
    rows = [
        (K[0], 1, None, 10.0, 5, d(2020)), (K[0].lower(), 2, "CC", -1.0, 4, d(2021)), (f"{K[0]} ", 3, "CCC", 30.0, 1, None),
        (K[1], 4, "C", 1.0, None, None), (K[1], 4, "C", 1.0, None, None),
        (K[2], 6, " ", float("nan"), 2, d(2020)), (K[2], 5, "N/A", 6000.0, 2, d(2020)),
        (K[3], 8, "C" * 100_000, 5.0, 3, d(2020)), (K[3], 7, "O", 5.0, 3, d(2022)), (K[3], None, "O", 5.0, 3, d(2023)),
        (None, 9, "C", 1.0, 1, None), ("", 10, "C", 1.0, 1, None), ("?", 11, "C", 1.0, 1, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], PUB)
    got = {r.ik: tuple(r)[1:4] for r in survivors.survivors(df).select("ik", "cid", "smiles_cid", "mass_cid").collect()}
    assert got == {K[0]: (3, 2, 1), K[2]: (5, None, None), K[3]: (None, None, None)}
    assert {r.ik: r.n_rows for r in survivors.survivors(df).collect()} == {K[0]: 3, K[2]: 2, K[3]: 3}
    assert survivors.survivors(df.limit(0)).count() == 0


def test_survivors_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit(K[0]).alias("ik"), F.col("id").alias("cid"), F.when(F.col("id") % 3 == 0, "C").alias("smiles"), F.when(F.col("id") % 5 == 0, 12.0).alias("mass"), (F.col("id") % 4).cast("int").alias("trust"), F.lit(None).cast("timestamp").alias("updated_at"))
    r = survivors.survivors(df).first()
    assert (r.cid, r.smiles_cid, r.mass_cid, r.n_rows) == (15, 3, 15, 20_000)


# ---- capping
CAP = "rid bigint, ingest_lib string, inchikey14 string, inchikey string, quality_score double, lib string, kept boolean, score double, __r int"


def test_capping_of_odd_rows(spark):
    odd = [None, float("nan"), -1.0, 999.0]
    rows = [(i, " Lib" if i % 2 else "LIB\t", K[0] if i % 3 else f"InChIKey={K[0].lower()}", None, odd[i % 4] if i < 8 else 0.5 if i < 12 else 0.9) for i in range(14)]
    rows += [(100, None, K[0], None, 1.0), (101, "lib", "?", None, 1.0), (102, "lib", "?", K[1], 1.0), (103, "x" * 100_000, K[1], None, 0.1)]
    df = spark.createDataFrame([(*r, "l", True, 0.0, 1) for r in rows], CAP)
    assert sorted(r.rid for r in capping.dropped(df).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 11]
    all_rows = capping.cap_records(df)
    assert all_rows.count() == 16 and all_rows.where("kept").count() == 7
    assert capping.dropped(df.limit(0)).count() == 0


# ---- overlaps
SPEC = "rid bigint, precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>, sig string, need int"


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    train, test = [], []
    for i in range(120):
        n = int(rng.integers(1, 25))
        m, a = rng.uniform(50, 300, n), rng.uniform(0.01, 1, n)
        train.append((i, float(300 + (i % 4) * 0.013), m.tolist(), a.tolist()))
        if i % 2 == 0:
            keep = rng.random(n) < 0.93
            jitter = m + rng.normal(0, 0.006, n)
            order = rng.permutation(n)
            test.append((i, float(300 + (i % 4) * 0.013 + rng.normal(0, 0.008)), jitter[order][keep[order]].tolist(), (a * 1000 * rng.uniform(0.5, 1.5, n))[order][keep[order]].tolist()))
    train += [(200, None, [1.0], [1.0]), (201, float("nan"), [1.0], [1.0]), (202, 300.0, None, None), (203, 300.0, [], []), (204, 300.0, [1.0, 2.0], [1.0]), (205, 300.0, [float("nan"), 70.0], [1.0, 0.0]), train[0], (206, *train[0][1:])]
    df = lambda rows: spark.createDataFrame([(*r, "s", 1) for r in rows], SPEC)
    got = Counter((r.rid, r.spectrum_id) for r in overlaps.matches(df(train), df(test).withColumnRenamed("rid", "spectrum_id")).collect())

    def clean(r):
        if r[1] is None or r[1] != r[1] or not r[2] or len(r[2]) != len(r[3]):
            return None
        p = sorted((x, y) for x, y in zip(r[2], r[3]) if x == x and y > 0)
        m, a = np.array([x for x, _ in p]), np.array([y for _, y in p])
        return (m, a / a.sum()) if len(m) else None

    want = Counter()
    for r in train:
        for q in test:
            x, y = clean(r), clean(q)
            if x and y and abs(r[1] - q[1]) <= 0.02 + 1e-9 and overlap(*y, *x, 0.02) >= 0.9 - 1e-9:
                want[r[0], q[0]] += 1
    assert got == want and len(want) > 20
    assert overlaps.matches(df(train).limit(0), df(test).withColumnRenamed("rid", "spectrum_id")).count() == 0
    assert overlaps.matches(df(train), df(test).limit(0).withColumnRenamed("rid", "spectrum_id")).count() == 0


def test_subset_sums_keep_few_sets():
    import tracemalloc

    rng = np.random.default_rng(1)
    sizes = {int(s): int(n) for s, n in zip(rng.choice(np.arange(50, 9000), 2000, False), rng.integers(1, 9, 2000))}
    tracemalloc.start()
    got = splits.closest_subset(sizes, 400_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in got.items()) == 400_000 and all(n <= sizes[s] for s, n in got.items())
    assert most < 40e6


def test_quotas_in_units_miss_less_than_the_smallest_group():
    rng = np.random.default_rng(2)
    histogram = {1: 40, **{int(s): int(n) for s, n in zip(rng.choice(np.arange(2, 900), 60, False), rng.integers(1, 9, 60))}}
    total = sum(s * n for s, n in histogram.items())
    targets = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
    for resolution in (1 << 22, 1000):
        got = splits.split_quotas(histogram, targets, resolution)
        assert {s: sum(n for _, n in parts) for s, parts in got.items()} == histogram
        for name, share in targets:
            assert abs(sum(s * n for s, parts in got.items() for x, n in parts if x == name) - share * total) <= 2


def test_too_many_targets_are_an_error(spark):
    many = spark.range(splits.MOST_SPLITS + 1).selectExpr("cast(id as string) as split_name", "1.0 as target_share")
    with pytest.raises(ValueError):
        splits.assign_splits(spark.createDataFrame([], "rid bigint, inchikey14 string, inchikey string"), spark.createDataFrame([], "inchikey14 string, key string"), many)


def test_heaps_of_a_hot_contributor(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " Lib" if i % 3 else "other", "ABCDEFGHIJKLMN" if i % 2 else f"{'ABCDEFGHIJKLM'}{chr(65 + i % 26)}", None, float(rng.choice([0.1, 0.5, 0.9, 2.0, float("nan")]))) for i in range(2000)]
    rows += [(None, "lib", "ABCDEFGHIJKLMN", None, 1.0), (5000, None, "ABCDEFGHIJKLMN", None, 1.0), (5001, "lib", "?", None, 1.0)]
    df = spark.createDataFrame(rows, "rid bigint, ingest_lib string, inchikey14 string, inchikey string, quality_score double").repartition(13)
    groups = defaultdict(list)
    for rid, lib, key, _, score in rows[:2000]:
        sound = 0 <= score <= 1
        groups[lib.strip().lower(), key].append((not sound, -score if sound else 0.0, rid))
    want = {r for g in groups.values() for _, _, r in sorted(g)[:5]}
    got = {r.rid: r.kept for r in capping.cap_records(df).collect()}
    assert got == {i: i in want for i in range(2000)}
    assert {r.rid for r in capping.dropped(df).collect()} == set(range(2000)) - want


def test_a_hot_cell_of_peaks(spark):
    # half of all training spectra share precursor and their strongest peaks with each other, and with few of the evaluation spectra
    train = [(i, 300.0, [100.0, 150.0, 200.0 + (i % 40)], [5.0, 4.0, 1.0 + i % 3]) if i % 2 else (i, 310.0 + i, [100.0 + i], [1.0]) for i in range(600)]
    test = [("a", 300.0, [100.0, 150.0, 201.0], [5.0, 4.0, 2.0]), ("b", 300.01, [100.01, 150.01, 203.0], [5.0, 4.0, 1.0]), ("c", 300.0, [90.0, 150.0], [9.0, 1.0])]
    cols = "precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>"
    got = {(r.rid, r.spectrum_id) for r in overlaps.matches(spark.createDataFrame(train, f"rid bigint, {cols}"), spark.createDataFrame(test, f"spectrum_id string, {cols}")).collect()}
    share = lambda x: np.array(x) / sum(x)
    want = {(r[0], t[0]) for r in train for t in test if abs(r[1] - t[1]) <= 0.02 + 1e-9 and overlap(np.array(r[2]), share(r[3]), np.array(t[2]), share(t[3]), 0.02) >= 0.9 - 1e-9}
    assert got == want and len(want) > 100


def _shuffled(spark) -> int:
    """Records that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    empty = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_overlaps_shuffle_spectra_and_no_segments(spark):
    # 80 of either side share precursor and m/z of all peaks; each training string has one partner
    rng = np.random.default_rng(11)
    mz = np.sort(rng.uniform(60, 290, 30))
    its = rng.exponential(1.0, (80, 30)) ** 3
    cols = "precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>"
    df = lambda ids, kind: spark.createDataFrame([(x, 300.0, mz.tolist(), a.tolist()) for x, a in zip(ids, its)], f"{kind}, {cols}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    before = _shuffled(spark)
    got = {tuple(r)[:2] for r in overlaps.matches(df(range(80), "rid bigint"), df([f"t{i}" for i in range(80)], "spectrum_id string")).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _shuffled(spark) - before < 1_000
    assert {(i, f"t{i}") for i in range(80)} <= got


def test_a_crowded_cell_is_dealt_over_tasks(spark):
    # precursors on both sides of a cell's end; ids and spectra repeat on both sides
    train = [(i % 50, 299.99 + 0.005 * (i % 7), [100.0, 150.0, 200.0 + i % 5], [5.0, 4.0, 1.0]) for i in range(90)]
    test = [(f"t{i % 4}", 299.98 + 0.01 * (i % 5), [100.0, 150.01, 200.0 + i % 5], [5.0, 4.0, 1.0]) for i in range(12)] * 2
    cols = "precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>"
    a, b = spark.createDataFrame(train, f"rid bigint, {cols}"), spark.createDataFrame(test, f"spectrum_id string, {cols}")
    share = lambda x: np.array(x) / sum(x)
    want = Counter((r[0], t[0]) for r in train for t in test if abs(r[1] - t[1]) <= 0.02 + 1e-9 and overlap(np.array(r[2]), share(r[3]), np.array(t[2]), share(t[3]), 0.02) >= 0.9 - 1e-9)
    for rows in (7, 1 << 16):
        assert Counter((r.rid, r.spectrum_id) for r in overlaps.matches(a, b, rows=rows).collect()) == want


def test_quotas_are_the_nearest_beyond_four_million_records():
    histogram = {1001: 3000, 1501: 1001}
    total = sum(s * n for s, n in histogram.items())
    assert total > 1 << 22
    goal = round(total * 0.1)
    a, b = np.meshgrid(np.arange(3001), np.arange(1002))
    best = int(np.abs(a * 1001 + b * 1501 - goal).min())
    for room in (1 << 30, 1000):
        got = splits.split_quotas(histogram, [("train", 0.9), ("val", 0.1)], room)
        assert {s: sum(n for _, n in parts) for s, parts in got.items()} == histogram
        assert abs(sum(s * n for s, parts in got.items() for x, n in parts if x == "val") - goal) == best


def test_the_room_for_subset_sums_makes_no_difference():
    rng = np.random.default_rng(5)
    for k in (0, 1, 2, 7, 40):
        sizes = {int(s): int(n) for s, n in zip(rng.integers(1, 300, k), rng.integers(1, 40, k))}
        takes = [splits.closest_subset(sizes, 1_700, room) for room in (1 << 30, 20_000, 1)]
        assert takes[0] == takes[1] == takes[2]
