"""Kernels that must do their whole job."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from peakloom.functions import chem as C
from peakloom.plans import censuses, kernels, structures


def parts(weights, bonds, cuts):
    """Masses after every set of cuts, by labels."""
    out = {round(sum(weights), 3)}
    for size in range(1, cuts + 1):
        for gone in combinations(range(len(bonds)), size):
            label = list(range(len(weights)))
            for _ in weights:
                for k, (a, b, _) in enumerate(bonds):
                    if k not in gone:
                        label[a] = label[b] = min(label[a], label[b])
            sums = {}
            for x, w in zip(label, weights):
                sums[x] = sums.get(x, 0.0) + w
            if len(sums) > 1:
                out.update(round(v, 3) for v in sums.values())
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 2])
@pytest.mark.parametrize("smiles", ["C", "CCO", "C1CCCCC1O", "c1ccc2ccccc2c1CC(=O)N", "C1CC2CCC1CC2", "CC(C)(O)CN.OC1CC1", "[Na+].CC", "[Na+].[Cl-]", "C12C3C4C1C5C2C3C45"])
def test_fragments_equal_all_cuts(smiles, cuts):
    g = C.parse_smiles(smiles)
    w = [C.MASS[e] + h * C.MASS["H"] for e, h in zip(g[0], g[1])]
    assert C.fragment_masses(w, g[2], cuts).tolist() == pytest.approx(parts(w, g[2], cuts))


def test_fragments_of_random_graphs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        w = (rng.integers(1, 2**30, n) / 1e5).tolist()
        bonds = [(int(a), int(b), 1) for a, b in rng.integers(0, n, (int(rng.integers(0, 11)), 2)) if a != b]
        assert C.fragment_masses(w, bonds).tolist() == pytest.approx(parts(w, bonds, 2))


def test_large_structures_are_cut_twice():
    # a chain of 70 atoms with a weight each of its own size
    w = [12 + k * k / 7 for k in range(70)]
    want = {round(sum(w[a:b]), 3) for a in range(70) for b in range(a + 1, 71)}
    got = C.fragment_masses(w, [(k, k + 1, 1) for k in range(69)])
    assert len(got) == len(want) and got == pytest.approx(sorted(want))


def test_explanation_opens_rings_and_knows_adducts(spark, tmp_path):
    ring = C.MASS["C"] * 2 + C.MASS["H"] * 4  # two atoms of cyclohexane
    rows = [(1, "C1CCCCC1", "[M+H]+", [ring + 1.00728], [1.0]), (2, "C1CCCCC1", "[M+Na]+", [ring + 22.98922], [1.0]), (3, "C1CCCCC1", "[M+H]+", [ring + 22.98922, 500.0], [1.0, 1.0]), (4, "C1CCCCC1", "[M-H]-", [ring - 3 * 1.00783 + 0.00055], [1.0])]
    spark.createDataFrame(rows, "rid bigint, normalized_smiles string, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>").write.parquet(f"{tmp_path}/train_spectra.parquet")
    spark.createDataFrame([(7, "C1CCCCC1")], "sid bigint, smiles string").write.parquet(f"{tmp_path}/train_structs.parquet")
    got = {r.rid: r.count_share for r in structures.queries()["k28_peak_explanation"](spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0}
    assert structures.queries()["k27_structure_facts"](spark, str(tmp_path)).first().n_fragments == 6


@pytest.mark.parametrize("formula", ["C6H12O6", "C5H9NO2S", "C10H15N2O6PCl2", "H4Si", "C3"])
@pytest.mark.parametrize("block", [2_000_000, 40])
def test_subformula_search_equals_enumeration(formula, block):
    counts = C.parse_formula(formula)
    rng = np.random.default_rng(1)
    masses = np.concatenate([rng.uniform(0.5, 200, 60), [12.0, 15.0235, 18.0106, 30.0106, 2.0157, 0.0, 0.001]])
    want = [m > 0.005 and bool(C.subformulas(counts, float(m), 0.005)) for m in masses]
    assert C.subformula_search(counts, block)(masses, 0.005).tolist() == want and any(want)


def test_shares_of_all_peaks_and_large_formulas(spark, tmp_path):
    large = "C60H100N20O40P9S9Cl9Br9"  # more than two million combinations
    water, proton = 2 * C.MASS["H"] + C.MASS["O"], C.MASS["H"] - C.ELECTRON
    six = [20.1 + k / 7 for k in range(6)]  # stronger than the one that counts
    rows = [(1, "CH4O", "[M+H]+", [*six, water + proton], [9.0] * 6 + [1.0]), (100, large, "[M+H]+", [water + proton, 19.5], [1.0, 1.0]), (101, "CH4O", "[M-H]-", [water - proton, water + proton + 0.5], [1.0, 1.0])]
    spark.createDataFrame(rows, "rid bigint, molecular_formula string, adduct string, ms2_mzs array<double>, ms2_normalized_intensities array<double>").withColumn("precursor_mz", F.lit(900.0)).write.parquet(f"{tmp_path}/train_spectra.parquet")
    got = {r.rid: r.share for r in censuses.queries()["k30_subformula_shares"](spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(1 / 7, abs=1e-5), 100: 0.5, 101: 0.5}


def test_nearest_profile_knows_all_labels(spark, tmp_path):
    n = 1100
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "label": pa.array(range(n), pa.int32()), "embedding": pa.array([[float(k), 1.0] for k in range(n)], pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    df = censuses.queries()["j25_nearest_profile"](spark, str(tmp_path))
    same(df, connect(str(tmp_path)).sql(censuses.oracle_sql()["j25_nearest_profile"]))


def test_peaks_beyond_the_sixty_strongest_count(spark, tmp_path):
    common = [100.0 + 3 * k for k in range(60)]
    own = lambda d: [400.0 + d + 3 * k for k in range(40)]
    rows = [(100, "A", 900.0, common + own(0.0)), (101, "B", 900.0, common + own(1.0)), (102, "A", 900.0 - 15.99491, common + own(0.0)), (103, "C", 900.0 - 15.99491, common + own(1.0)), (104, "A", 900.0, common + own(1.0))]
    it = [1.0] * 60 + [0.5] * 40
    spark.createDataFrame([(*r, it, "[M+H]+", "positive", 300 - r[0]) for r in rows], "rid bigint, inchikey14 string, precursor_mz double, ms2_mzs array<double>, ms2_normalized_intensities array<double>, adduct string, ionization_mode string, num_peaks int").write.parquet(f"{tmp_path}/train_spectra.parquet")
    spark.createDataFrame([("A", bytearray([255] + [0] * 127)), ("B", bytearray([128] + [0] * 127)), ("C", bytearray([128] + [0] * 127))], "inchikey14 string, fp binary").write.parquet(f"{tmp_path}/train_structs.parquet")
    run = lambda name, mod=kernels: mod.queries()[name](spark, str(tmp_path)).collect()
    for name in ("k5_entropy_similarity", "k6_cosine", "k9_modified_cosine"):
        assert {r.rid: r.score < 0.99 for r in run(name) if r.qid == 100 and r.rid in (101, 104)} == {101: True, 104: True}, name
    assert {r.rid: r.score < 0.99 for r in run("k7_shifted_similarity")} == {102: False, 103: True}
    assert {r.rid: r.score < 0.99 for r in run("j14_with_representative", censuses)} == {102: False, 104: True}
    # the record with other weak peaks has less of a vote
    votes = {r.qid: r.expected_bits for r in run("k16_votes")}
    assert votes[100] > 5.5


def test_no_pair_is_better_than_its_bound():
    # pairs that aren't compared: their bound must hold whatever the shift, and be 0 where no peak can meet
    from peakloom.functions import similarity
    from peakloom.operators.blocks import Bounds

    rng = np.random.default_rng(4)
    n = 60
    prec = rng.choice([300.0, 300.00005, 314.0157, 330.01, 420.5], n)
    size = rng.integers(1, 30, n)
    grid = np.round(rng.uniform(50, 280, 40), 2)
    rows = np.repeat(np.arange(n), size)
    mz = rng.choice(grid, len(rows)) + np.where(rng.random(len(rows)) < 0.5, prec[rows] - 300, 0) + rng.choice([-0.01, 0.0, 0.01], len(rows))
    order = np.lexsort((mz, rows))
    p = similarity.entropy_weights(similarity.Peaks(n, rows, mz[order], rng.exponential(1.0, len(rows))))
    most = Bounds(p, prec, 0.02).of(p, prec).reshape(n, n)
    r, q = (x.ravel() for x in np.indices((n, n)))
    sims = similarity.score("shifted", p.take(q), p.take(r), prec[q], prec[r], 0.02)
    assert (most[r, q] >= sims - 1e-9).all() and (sims > 0.3).sum() > n and (most[r, q] < 0.3).sum() > n
    far = similarity.Peaks(1, np.zeros(2, "i8"), np.array([10.0, 20.0]), np.array([0.5, 0.5]))
    assert (Bounds(p, prec, 0.02).of(far, np.array([5000.0])) == 0).all()
