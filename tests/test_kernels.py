import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions import chem as C
from peakloom.functions import fingerprints as P
from peakloom.functions import similarity as M
from peakloom.functions import spectra as S
from peakloom.functions.keys import structure_key
from peakloom.functions.peaks import overlap
from peakloom.operators.blocks import peak_cells


def test_structure_keys(spark):
    k = "ABCDEFGHIJKLMN"
    good = [k, k.lower(), f"  {k}\t", f" {k}​", f"InChIKey={k}", f"inchikey={k}-ABCDEFGHIJ-N", f"{k}-ABCDEFGHIJ", f"{k}\n"]
    bad = [None, "", "?", "N/A", k[:-1], k + "A", k[:-1] + "1", f"{k} {k}", f"{k}-XX"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "i int, x string").select("i", structure_key("x").alias("k"))
    got = {r.i: r.k for r in df.collect()}
    assert [got[i] for i in range(len(good))] == [k] * len(good)
    assert [got[len(good) + i] for i in range(len(bad))] == [None] * len(bad)


def peaks(*lists):
    """Many lists of (m/z, weight) as flat arrays."""
    flat = [np.array([p[k] for l in lists for p in sorted(l)], "f8") for k in (0, 1)]
    return M.Peaks(len(lists), np.repeat(np.arange(len(lists)), [len(l) for l in lists]), *flat)


def walked(a, b, tol, shift=0.0):
    """Pairs of a walk through two lists, step by step."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        d = a[i][0] - (b[j][0] + shift)
        if abs(d) <= tol:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return out


def entropy_of(ws):
    return -sum(w * math.log(w) for w in ws if w > 0)


def slow_entropy(a, b, tol, shift=None):
    pairs = walked(a, b, tol)
    if shift is not None:
        left, right = {i for i, _ in pairs}, {j for _, j in pairs}
        pairs += [(i, j) for i, j in walked(a, b, tol, shift) if i not in left and j not in right]
    met = dict(pairs)
    mixed = [a[i][1] / 2 + (b[met[i]][1] / 2 if i in met else 0) for i in range(len(a))] + [b[j][1] / 2 for j in set(range(len(b))) - set(met.values())]
    return min(1.0, max(0.0, 1 - (2 * entropy_of(mixed) - entropy_of([w for _, w in a]) - entropy_of([w for _, w in b])) / math.log(4)))


def slow_modified(a, b, shift, tol):
    pairs = []
    for way in [0.0] if abs(shift) <= tol else [0.0, shift]:
        pairs += [(a[i][1] * b[j][1], i, j) for i in range(len(a)) for j in range(len(b)) if abs(a[i][0] - (b[j][0] + way)) <= tol]
    left, right, dot = set(), set(), 0.0
    for w, i, j in sorted(pairs, key=lambda p: p[0])[::-1]:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            dot += w
    return dot / math.sqrt(sum(w * w for _, w in a) * sum(w * w for _, w in b)) if a and b else 0.0


def test_modified_cosine_example():
    # the first pair's precursors are far apart, so its peaks meet at their own places only; the second's meet moved as well
    a = peaks([(100.0, 0.7), (150.0, 0.2), (200.0, 0.1)], [(100.0, 50.0), (120.0, 100.0), (150.0, 40.0)], [])
    b = peaks([(100.0, 0.4), (140.0, 0.2), (190.0, 0.1)], [(100.0, 60.0), (130.0, 90.0), (160.0, 30.0)], [(1.0, 1.0)])
    s, n = M.modified(a, b, np.array([100.0, -10.0, 5.0]), 0.1)
    assert n.tolist() == [1, 3, 0] and s[1] == pytest.approx(0.9903, abs=1e-4) and s[2] == 0


#: Places on a grid of 1/64, so that differences are exact.
peak_lists = st.lists(st.tuples(st.integers(3200, 3500).map(lambda x: x / 64), st.floats(0.01, 1)), min_size=0, max_size=9, unique_by=lambda p: p[0]).map(sorted)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(peak_lists, peak_lists, st.sampled_from([-1.0, 0.0, 0.5, 2.0])), min_size=1, max_size=6), st.sampled_from([1 / 64, 0.25, 1.0]))
def test_batches_score_as_single_pairs_do(rows, tol):
    share = lambda l: [(m, w / sum(x for _, x in l)) for m, w in l]
    rows = [(share(a), share(b), s) for a, b, s in rows]
    a, b, shift = peaks(*[r[0] for r in rows]), peaks(*[r[1] for r in rows]), np.array([r[2] for r in rows])
    whole = [bool(x and y) for x, y, _ in rows]
    close = lambda got, want: np.allclose(got, [w if ok else 0.0 for w, ok in zip(want, whole)], atol=1e-9)
    assert close(M.entropy(a, b, tol), [slow_entropy(x, y, tol) for x, y, _ in rows])
    assert close(M.entropy(a, b, tol, shift=shift), [slow_entropy(x, y, tol, s if abs(s) > 1e-4 else None) for x, y, s in rows])
    assert close(M.modified(a, b, shift, tol)[0], [slow_modified(x, y, s, tol) for x, y, s in rows])
    nothing = np.zeros(len(rows))
    assert close(M.score("greedy", a, b, nothing, nothing, tol), [w if (w := slow_modified(x, y, 0.0, tol)) > 1e-6 else 0.0 for x, y, _ in rows])
    dots = [sum(x[i][1] * y[j][1] for i, j in walked(x, y, tol)) / math.sqrt(sum(w * w for _, w in x) * sum(w * w for _, w in y)) if x and y else 0.0 for x, y, _ in rows]
    assert close(M.cosine(a, b, tol), dots)


def test_cleaning_in_batches_equals_cleaning_in_rows(spark, data):
    from peakloom.operators.blocks import clean_lists

    t = spark.read.parquet(f"{data}/train_spectra.parquet").where("precursor_mz > 0 and precursor_mz < 1e9")
    got = {r.id: (r.mz, r.it) for r in clean_lists(t, "rid", "ms2_mzs", "ms2_normalized_intensities", "precursor_mz").collect()}
    want = {r.rid: r.peaks for r in S.clean_peaks(t).where(F.size("peaks") > 0).select("rid", "peaks").collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for k, ps in want.items():
        assert got[k][0] == [p.mz for p in ps] and np.allclose(got[k][1], [p.it for p in ps])
    w = S.entropy_weights(S.clean_peaks(t).where(F.size("peaks") > 0)).select("rid", "weights")
    for r in w.limit(100).collect():
        m, i = got[r.rid]
        assert np.allclose(M.entropy_weights(peaks(list(zip(m, i)))).w, r.weights)


@pytest.mark.parametrize("each", [8192, 2])
@pytest.mark.parametrize("kind", ["entropy", "cosine", "greedy", "modified", "shifted"])
def test_best_by_peaks_equals_all_pairs(spark, kind, each):
    from peakloom.operators.blocks import best_by_peaks

    rng = np.random.default_rng(4)
    # half of all rows share group and precursor
    rows = [(i, "a" if i % 2 else "b", 200.0 if i % 2 else float(rng.choice([150.0, 150.005, 300.0])), sorted(rng.choice(np.arange(50, 60, 0.25), 6, False).tolist()), rng.uniform(0.1, 1, 6).tolist()) for i in range(60)]
    rows += [(100, None, 200.0, [50.0], [1.0]), (101, "a", None, [50.0], [1.0]), (102, "a", 200.0, None, None), (103, "a", 200.0, [], []), (104, "a", float("nan"), [50.0], [1.0])]
    df = spark.createDataFrame(rows, "rid bigint, adduct string, precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>").repartition(5)
    got = {(r.query, r.other): (r.sim, r["rank"]) for r in best_by_peaks(df, F.col("rid") % 4 == 1, kind, 5, 0.01, each=each).collect()}
    want = {}
    for q in rows[:60]:
        if q[0] % 4 != 1:
            continue
        found = []
        for r in rows[:60]:
            if r[0] != q[0] and r[1] == q[1] and abs(r[2] - q[2]) <= 0.01:
                a, b = (M.clean(peaks(list(zip(x[3], x[4]))), np.array([x[2]])) for x in (q, r))
                if kind in ("entropy", "shifted"):
                    a, b = M.entropy_weights(a), M.entropy_weights(b)
                found.append((-round(float(M.score(kind, a, b, np.array([q[2]]), np.array([r[2]]))[0]), 6), r[0]))
        want |= {(q[0], o): (pytest.approx(-s, abs=2e-6), k + 1) for k, (s, o) in enumerate(sorted(found)[:5])}
    assert got == want


def test_nearest_by_cells_equals_all_pairs(spark):
    from peakloom.operators.blocks import nearest_by_cells

    rng = np.random.default_rng(6)
    rows = [(i, sorted(rng.choice(30, 4, False).tolist()), [0.5] * 4, "x" if i % 3 else None, None if i % 5 == 0 else f"k{i % 4}") for i in range(80)]
    rows += [(200, [], [], "x", "z")]
    df = spark.createDataFrame(rows, "id bigint, cells array<bigint>, weights array<double>, grp string, apart string").repartition(4)
    for each in (8192, 7):
        got = {(r.query, r["rank"]): (r.other, r.sim) for r in nearest_by_cells(df, df.where("id % 5 < 2"), 3, each=each).collect()}
        want = {}
        for q in rows[:80]:
            if q[0] % 5 < 2:
                found = sorted((-len(set(q[1]) & set(r[1])) / 4, r[0]) for r in rows if r[0] != q[0] and r[3] == q[3] and r[4] != q[4] and set(q[1]) & set(r[1]))
                want |= {(q[0], k + 1): (o, -s) for k, (s, o) in enumerate(found[:3])}
        assert got == want


def short(l):
    return np.array([m for m, _ in l]), np.array([w for _, w in l])


def best_pairs(ma, a, mb, b, tol):
    """All one-to-one pairs in order, by recursion."""
    if not len(ma) or not len(mb):
        return 0.0
    out = max(best_pairs(ma[1:], a[1:], mb, b, tol), best_pairs(ma, a, mb[1:], b[1:], tol))
    if abs(ma[0] - mb[0]) <= tol + 1e-9:
        out = max(out, math.sqrt(a[0] * b[0]) + best_pairs(ma[1:], a[1:], mb[1:], b[1:], tol))
    return out


@settings(max_examples=80, deadline=None)
@given(peak_lists.map(short), peak_lists.map(short), st.sampled_from([0.1, 1.0, 4.0]))
def test_overlap_is_the_best_banded_pairing(a, b, tol):
    n = 6
    args = (a[0][:n], a[1][:n], b[0][:n], b[1][:n], tol)
    assert overlap(*args) == pytest.approx(best_pairs(*args), abs=1e-9)


def test_merges():
    m, v = S.merge_spectra([([100.0, 200.0], [1.0, 0.5]), ([100.003, 300.0], [2.0, 1.0])])
    assert m.tolist() == [100.003, 200.0, 300.0] and v.tolist() == [1.0, 0.5, 0.5]
    m, _ = S.merge_spectra([([100.0], [1.0]), ([100.003], [1.0])], later_wins=False)
    assert m.tolist() == [100.0]
    assert S.merge_spectra([([], [])])[0].size == 0
    m, _ = S.merge_neighbours([100.0, 100.003, 200.0], [0.2, 0.9, 0.4])
    assert m.tolist() == [100.003, 200.0]
    x, y = S.align_greedy([1.0, 2.0], [0.5, 0.5], [1.01, 3.0], [0.6, 0.4])
    assert sorted(zip(x.tolist(), y.tolist())) == [(0.0, 0.4), (0.5, 0.0), (0.5, 0.6)]


def test_clean_peaks(spark):
    df = spark.createDataFrame([(1, 100.0, [50.0, 99.0, 150.0, 60.0], [0.5, 0.004, 1.0, 0.2]), (2, None, [10.0], [1.0]), (3, 50.0, None, None), (4, float("nan"), [], [])], "rid int, precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>")
    got = {r.rid: r.peaks for r in S.clean_peaks(df).collect()}
    assert [(p.mz, round(p.it, 6)) for p in got[1]] == [(50.0, 1.0), (60.0, 0.4)]
    assert len(got[2]) == 1 and not got[3] and not got[4]


def test_score_pairs(spark):
    df = spark.createDataFrame([(1, [50.0, 60.0], [0.5, 0.5], [50.0, 60.0], [0.5, 0.5]), (2, [50.0], [1.0], [70.0], [1.0])], "i int, ma array<double>, wa array<double>, mb array<double>, wb array<double>")
    for kind in ("entropy", "cosine", "shifted", "modified"):
        got = {r.i: r.score for r in S.score_pairs(df, kind).collect()}
        assert got[1] == pytest.approx(1.0) and got[2] == 0.0


def test_adducts_and_formulas(spark):
    assert C.parse_adduct("[M+H]+")[2] == pytest.approx(1.00727645, abs=1e-6)
    n, z, d, p = C.parse_adduct("[2M+Na]+")
    assert (n, z, p) == (2, 1, 1) and d == pytest.approx(22.98922, abs=1e-4)
    assert C.parse_adduct("[M-2H]2-")[1] == 2 and C.parse_adduct("[M+?]+") is None and C.parse_adduct(None) is None
    assert C.parse_adduct(" [M+HCOO]- ") == pytest.approx((1, 1, 12.0 + C.MASS["H"] + 2 * C.MASS["O"] + C.ELECTRON, -1))
    assert C.parse_adduct("[M+2Na-H]+")[2] == pytest.approx(2 * C.MASS["Na"] - C.MASS["H"] - C.ELECTRON)
    assert C.parse_adduct("[3M+2H]2+")[:2] == (3, 2) and C.parse_adduct("[M]+") == pytest.approx((1, 1, -C.ELECTRON, 1))
    assert not any(map(C.parse_adduct, ("[M+H]", "M+H", "[M+]+", "[M+H]+x", "[+H]+", "", "[M+Xx]+", "[M+H")))
    df = spark.createDataFrame([("C6H12O6",), ("CH3Cl",), ("",), (None,), ("C6X",), ("C6-",)], "f string").select("f", C.formula_mass("f").alias("m"))
    got = {r.f: r.m for r in df.collect()}
    assert got["C6H12O6"] == pytest.approx(180.06339, abs=1e-4) and got["CH3Cl"] == pytest.approx(49.9923, abs=1e-3)
    assert got[""] is None and got[None] is None and got["C6X"] is None


@pytest.mark.parametrize("smiles,formula", [("CCO", {"C": 2, "H": 6, "O": 1}), ("c1ccccc1", {"C": 6, "H": 6}), ("CC(=O)O", {"C": 2, "H": 4, "O": 2}), ("C#N", {"C": 1, "H": 1, "N": 1}), ("C[NH3+]", {"C": 1, "H": 6, "N": 1}), ("c1cc[nH]c1", {"C": 4, "H": 5, "N": 1}), ("C1CCN(CC1)C", {"C": 6, "H": 13, "N": 1})])
def test_structures(smiles, formula):
    g = C.parse_smiles(smiles)
    have = {e: g[0].count(e) for e in set(g[0])}
    have["H"] = sum(g[1])
    assert have == formula


def test_fragments():
    g = C.parse_smiles("CCO")
    w = [C.MASS[e] + h * C.MASS["H"] for e, h in zip(g[0], g[1])]
    assert C.fragment_masses(w, g[2], 1).tolist() == pytest.approx([15.023, 17.003, 29.039, 31.018, 46.042])
    assert C.explained(np.array([31.018]), np.array([32.026, 90.0]), 1.00728, 1).tolist() == [True, False]
    assert {"C": 2, "H": 5} in C.subformulas({"C": 2, "H": 6, "O": 1}, 29.0391, 0.001)
    assert C.parse_smiles("C(") is None and C.parse_smiles("") is None and C.parse_smiles("C1CC") is None
    assert C.degree_signature(C.parse_smiles("CC=O")) == C.degree_signature(C.parse_smiles("CCO"))


def test_fingerprints(spark):
    a, b = bytes([0x80] + [0] * 127), bytes([0xC0] + [0] * 127)
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, bytes(128), bytes(128)), (4, a[:5], b)], "i int, a binary, b binary").select("i", P.words("a").alias("x"), P.words("b").alias("y"))
    got = {r.i: r.t for r in df.select("i", P.tanimoto("x", "y").alias("t")).collect()}
    assert got[1] == 0.5 and got[2] == 1.0 and got[3] == 0.0
    bits = df.where("i = 1").select(P.bits("y").alias("b")).first().b
    assert bits[:3] == [1, 1, 0] and sum(bits) == 2 and len(bits) == 1024


def test_bin_features_have_length_one(spark, data):
    f = peak_cells(spark.read.parquet(f"{data}/train_spectra.parquet"), "rid", "ms2_mzs", "ms2_normalized_intensities", "precursor_mz", 0.5, 150)
    assert f.count() > 50 and f.select(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
