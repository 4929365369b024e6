"""Structure identity, fragments and replacement rules over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peakloom.functions import chem as C
from peakloom.functions.peaks import flat_peaks
from peakloom.operators import rules as R
from peakloom.plans.registry import Registry
from peakloom.session import cut

q = Registry()


@q("k27_structure_facts")
def _(t):
    return C.structure_facts(t.train_structs, "sid", "smiles").select(F.col("id").alias("sid"), "n_heavy", F.round("graph_mass", 4).alias("graph_mass"), "n_fragments", F.array_join("signature", ",").alias("signature"))


def fragment_shares(row, m, a, ok, loose, n, top=10):
    """(count share, intensity share, share of the ten strongest, share of intensity that needs one hydrogen at most) of n rows."""
    w = np.sqrt(a)
    per = lambda x: np.bincount(row, x, minlength=n)
    order = np.lexsort((m, -w, row))
    strong = order[np.arange(len(order)) - np.searchsorted(row, row) < top]
    few = np.bincount(row[strong], minlength=n)
    total, size = per(w), per(np.ones(len(w)))
    share = lambda x, y: np.round(x / np.where(y > 0, y, 1), 5)
    return share(per(loose * 1.0), size), share(per(w * loose), total), share(np.bincount(row[strong], loose[strong] * 1.0, minlength=n), few), share(per(w * ok), total)


@q("k28_peak_explanation")
def _(t):
    def run(batches):
        cached: dict[str, np.ndarray | None] = {}

        def masses(smiles):
            if smiles not in cached:
                if len(cached) >= 20_000:
                    cached.clear()
                g = C.parse_smiles(smiles)
                cached[smiles] = None if g is None else C.fragment_masses([C.MASS[e] + h * C.MASS["H"] for e, h in zip(g[0], g[1])], g[2])
            return cached[smiles]

        for b in batches:
            n = b.num_rows
            row, m, a, starts = flat_peaks(b.column(3), b.column(4), shares=False)
            known = np.zeros(n, bool)
            strict, loose = np.zeros(len(m), bool), np.zeros(len(m), bool)
            # all records of one structure and adduct at once
            pairs: dict[tuple, list[int]] = {}
            for r, pair in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                pairs.setdefault(pair, []).append(r)
            for (smiles, adduct), rows in pairs.items():
                parts = masses(smiles)
                if parts is None:
                    continue
                known[rows] = True
                at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                for ion in C.charge_carriers(adduct):
                    loose[at] |= C.explained(parts, m[at], ion, 2, ppm=15.0)
                    strict[at] |= C.explained(parts, m[at], ion, 1, ppm=15.0)
            keep = pa.array(known & (np.diff(starts) > 0))
            out = [pa.array(x).filter(keep) for x in fragment_shares(row, m, a, strict, loose, n)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), *out], ["rid", "count_share", "intensity_share", "top_share", "strict_share"])

    s = t.train_spectra.select("rid", "normalized_smiles", "adduct", F.col("ms2_mzs").cast("array<double>"), F.col("ms2_normalized_intensities").cast("array<double>")).where("normalized_smiles is not null")
    return s.mapInArrow(run, "rid bigint, count_share double, intensity_share double, top_share double, strict_share double")


@q("k29_fragment_features")
def _(t):
    # of each structure over its records: the best and mean shares
    each = t.train_spectra.select("rid", "normalized_smiles").join(q.plans["k28_peak_explanation"](t), "rid")
    best = [F.round(F.max(c), 5).alias(n) for c, n in (("intensity_share", "best_intensity"), ("count_share", "best_count"), ("top_share", "best_top"), ("strict_share", "best_strict"))]
    return each.groupBy("normalized_smiles").agg(*best, F.round(F.avg("intensity_share"), 5).alias("mean_intensity"), F.count("*").alias("records"))


@q("k32_structure_keys")
def _(t):
    return C.key_table(t.train_structs, "sid", "smiles").withColumnRenamed("id", "sid")


@q("k32_same_structures")
def _(t):
    # structures whose graphs are alike, however they are written: one row each with the class's smallest sid
    k = C.key_table(t.train_structs, "sid", "smiles").where("parent is not null")
    classes = k.groupBy("parent").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1")
    return k.join(classes, "parent").select(F.col("id").alias("sid"), "class", "n")


def cuts(t):
    return cut(C.cut_table(t.train_structs, "sid", "smiles"), "cuts")


@q("k34_rules_by_support")
def _(t):
    # all rules with their support; structures here share few constant parts, so nothing is asked of the support
    return R.mine_rules(cuts(t), 1)


@q("k36_rule_products")
def _(t):
    # products of every rule on structures whose sid is divisible by 10, and how many of them are structures that are known
    c = cuts(t)
    made = R.apply_rules(c.where("id % 10 = 0"), cut(R.mine_rules(c, 1), "rules"))
    there = c.select("const", F.col("var").alias("new"), "env").distinct().withColumn("known", F.lit(1))
    return made.join(there, ["const", "new", "env"], "left").groupBy(F.col("id").alias("sid")).agg(F.count("*").alias("products"), F.count("known").alias("known"), F.round(F.max("prior"), 6).alias("likeliest"))


@q("k38_expansion")
def _(t):
    c = cuts(t)
    made = R.apply_rules(c.where("id % 10 = 0"), cut(R.mine_rules(c, 1), "rules"))
    masses = t.train_structs.where("mass is not null").select("sid", "mass")
    found = R.expand(made, masses.withColumnRenamed("sid", "id"), masses.withColumnRenamed("sid", "target"))
    return found.select(F.col("id").alias("sid"), "target", "steps", F.round("prior", 6).alias("prior"), "rank")


queries, oracle_sql = q.queries, q.oracle_sql
