"""Structure keys, fragments and replacement rules."""

import itertools

import numpy as np
import pytest

from peakloom.functions import chem as C
from peakloom.operators import rules as R

SMILES = ["CC(=O)Oc1ccccc1C(=O)O", "CN1CCC(CC1)c1ccc(cc1)C(N)=O", "OC1CC2CCC1CC2", "CCO.[Na+]", "c1ccc2ccccc2c1", "CC(C)(C)CC(F)(F)F", "[Na+].[Cl-]"]


def shuffled(g, rng):
    order = rng.permutation(len(g[0]))
    place = np.argsort(order)
    bonds = [(int(place[a]), int(place[b]), o) if rng.random() < 0.5 else (int(place[b]), int(place[a]), o) for a, b, o in g[2]]
    return [g[0][k] for k in order], [g[1][k] for k in order], [bonds[k] for k in rng.permutation(len(bonds))]


def test_keys_do_not_depend_on_numbering():
    rng = np.random.default_rng(1)
    keys = set()
    for s in SMILES:
        g = C.parse_smiles(s)
        own = {C.structure_keys(shuffled(g, rng)) for _ in range(8)} | {C.structure_keys(g)}
        assert len(own) == 1
        keys |= own
        cuts = {tuple(sorted((a, b, e, round(m, 5)) for a, b, e, m in C.single_cuts(shuffled(g, rng)))) for _ in range(5)}
        assert len(cuts) == 1
    assert len(keys) == len(SMILES)
    key = lambda s: C.structure_keys(C.parse_smiles(s))[0]
    assert key("C1=CC=CC=C1O") == key("Oc1ccccc1") and key("OCC") == key("C(O)C")
    # isomers, rings of other sizes, other hydrogens
    assert len({key(s) for s in ("CCCO", "CC(O)C", "COCC", "CCC=O")}) == 4
    assert key("C1CCCCC1C1CCCCC1") != key("C1CCCC1C1CCCCCC1") and key("C1CC1C1CC1") != key("C1CCCCC1")


def test_parents_are_the_largest_parts():
    parent = lambda s: C.structure_keys(C.parse_smiles(s))[1:]
    assert parent("CCO.[Na+]") == (parent("CCO")[0], 2) and parent("[Cl-].CCO.O") == (parent("OCC")[0], 3)


def test_cuts_of_ethanol():
    found = C.single_cuts(C.parse_smiles("CCO"))
    assert sorted((e, round(m, 3)) for _, _, e, m in found) == [("C2", 15.023), ("C2", 17.003)]
    assert not C.single_cuts(C.parse_smiles("C1CCCCC1")) and not C.single_cuts(C.parse_smiles("C=C"))
    # the same parts on another place of the constant part are another constant part
    a, b = ({c[:2] for c in C.single_cuts(C.parse_smiles(s), 2)} for s in ("CCc1ccccc1O", "CCc1cccc(O)c1"))
    assert {v for _, v in a} == {v for _, v in b} and not a & b


def test_rules_equal_counting_pairs(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(i), f"c{rng.integers(0, 4)}", f"v{rng.integers(0, 5)}", f"e{rng.integers(0, 2)}") for i in range(80) for _ in range(2)})
    rows = [(*r, 10.0 + int(r[2][1:])) for r in rows]
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[1] == b[1] and a[3] == b[3] and a[2] < b[2]:
            want.setdefault((a[2], b[2], a[3]), []).append((a[0], b[0]))
    df = spark.createDataFrame(rows, "id bigint, const string, var string, env string, mass double")
    got = {(r.v1, r.v2, r.env): (r.pairs, r.delta) for r in R.mine_rules(df, 3).collect()}
    assert got == {k: (len(v), float(int(k[1][1:]) - int(k[0][1:]))) for k, v in want.items() if len(v) >= 3}
    assert R.mine_rules(df.limit(0)).count() == 0


def test_expansion_in_two_steps(spark):
    products = spark.createDataFrame([(1, "c", "x", "e", 14.0, 0.6), (1, "c", "y", "e", 16.0, 0.4)], "id bigint, const string, new string, env string, delta double, prior double")
    masses = spark.createDataFrame([(1, 100.0)], "id bigint, mass double")
    targets = spark.createDataFrame([(2, 114.001), (3, 130.0), (4, 131.0), (5, 132.0), (1, 100.0)], "target bigint, mass double")
    got = {r.target: (r.steps, round(r.prior, 6), r["rank"]) for r in R.expand(products, masses, targets).collect()}
    assert got == {2: (1, 0.6, 1), 3: (2, 0.24, 2), 5: (2, 0.16, 3)}


def test_known_products(spark, tmp_path):
    from peakloom.plans import structures

    # chlorine for fluorine on four rings; one structure lacks its partner
    rows = [(10 * i + j, s.replace("X", x), 200.0 + 10 * i + (0 if x == "F" else 15.97)) for i, s in enumerate(("Xc1ccccc1", "Xc1ccccc1C#N", "Xc1ccc(C)cc1", "Xc1ccncc1")) for j, x in enumerate(("F", "Cl"))]
    rows += [(40, "Fc1cccnc1CO", 300.0), (41, None, 1.0), (42, "C(", 1.0)]
    spark.createDataFrame(rows, "sid bigint, smiles string, mass double").write.parquet(f"{tmp_path}/train_structs.parquet")
    rules = structures.queries()["k34_rules_by_support"](spark, str(tmp_path)).collect()
    assert any(abs(abs(r.delta) - 15.97045) < 1e-3 and r.pairs == 4 for r in rules)
    got = {r.sid: (r.products, r.known) for r in structures.queries()["k36_rule_products"](spark, str(tmp_path)).collect()}
    assert got[10][1] >= 1 and got[40][1] == 0 and got[40][0] >= 1


@pytest.mark.parametrize("name", ["k32_structure_keys", "k32_same_structures"])
def test_keys_of_odd_rows(spark, tmp_path, name):
    from peakloom.plans import structures

    rows = [(1, "CCO", None), (2, "OCC", None), (3, "OCC.[Na+]", None), (4, None, None), (5, "x?", None), (6, "", None), (None, "C", None), (7, "C" * 300, None)]
    spark.createDataFrame(rows, "sid bigint, smiles string, key string").write.parquet(f"{tmp_path}/train_structs.parquet")
    got = {r.sid: r for r in structures.queries()[name](spark, str(tmp_path)).collect()}
    if name == "k32_structure_keys":
        assert set(got) == set(range(1, 8)) and got[1]["key"] == got[2]["key"] != got[3]["key"] and got[3].parent == got[1].parent
        assert all(got[k]["key"] is None for k in (4, 5, 6))
    else:
        assert {k: (r["class"], r.n) for k, r in got.items()} == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
