import importlib

import pytest

from oracle import connect, same

MODULES = ["training", "scans", "relational", "lists", "kernels", "structures", "pipelines", "censuses"]


def plans():
    for m in MODULES:
        mod = importlib.import_module(f"peakloom.plans.{m}")
        yield from ((name, mod) for name in mod.queries())


#: Queries whose rows the smallest tables may lack: analogues an oxygen lighter, structures written twice, shared constant parts.
MAY_BE_EMPTY = {"k7_shifted_similarity", "k32_same_structures", "k34_rules_by_support", "k36_rule_products", "k38_expansion"}
#: Columns that are shares or similarities, ranks from one on, and names of what a row is about.
SHARES = {"score", "sim", "share", "count_share", "intensity_share", "top_share", "strict_share", "best_intensity", "best_count", "best_top", "best_strict", "mean_intensity", "prior", "likeliest"}
RANKS = {"rank", "r", "n", "records", "pairs", "consts", "molecules", "steps"}
IDENTS = ("qid", "rid", "sid", "mid", "key", "target", "rep", "molecule_id", "normalized_smiles", "v1", "v2", "env")


def sound(name, df):
    """What must hold for any rows: values in their range, no row twice, ranks without gaps, best first."""
    rows = df.collect()
    assert df.columns and (rows or name in MAY_BE_EMPTY)
    for r in rows:
        for c in df.columns:
            if c in SHARES:
                assert 0 <= r[c] <= 1, (name, r)
            if c in RANKS:
                assert r[c] >= 1, (name, r)
        if {"lo", "hi", "mean"} <= set(df.columns):
            assert r.lo <= r["mean"] <= r.hi
        if {"qid", "rid"} <= set(df.columns):
            assert r.qid % 100 == 0 and r.qid != r.rid
        if {"rid", "rep"} <= set(df.columns):
            assert r.rid != r.rep
    who = [c for c in IDENTS if c in df.columns]
    if who:
        assert len({tuple(r[c] for c in who) for r in rows}) == len(rows), name
    if {"qid", "r", "score"} <= set(df.columns):
        by = {}
        for r in sorted(rows, key=lambda r: r.r):
            by.setdefault(r.qid, []).append(r)
        for group in by.values():
            assert [r.r for r in group] == list(range(1, len(group) + 1))
            assert [(-r.score, r.rid) for r in group] == sorted((-r.score, r.rid) for r in group)


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name,mod", [pytest.param(n, m, id=n) for n, m in plans()])
def test_query(spark, data, duck, name, mod):
    df = mod.queries()[name](spark, data)
    sql = mod.oracle_sql().get(name)
    if sql is None:
        sound(name, df)
    else:
        same(df, duck.sql(sql))


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
