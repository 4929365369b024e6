"""Further operators: identities, representatives, rules, strata, interventions and bench slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.functions import chem as C
from peakloom.functions import spectra as S
from peakloom.operators import blocks as B
from peakloom.operators import evaluation as V
from peakloom.operators import ranking as R
from peakloom.operators.skew import hot_keys, salted_join
from peakloom.plans.kernels import BINS, SIMS, features, knn
from peakloom.plans.lists import CTE, cands, la, truth
from peakloom.plans.registry import Registry

q = Registry()


@q("n1_ordered_ids", "SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS row_id FROM train_spectra")
def _(t):
    return R.ordered_ids(t.train_spectra.select("rid"), ["rid"])


@q("a30_approximate_counts")
def _(t):
    return t.train_spectra.groupBy("ionization_mode").agg(F.approx_count_distinct("inchikey14", 0.02).alias("molecules"), F.approx_percentile("num_peaks", 0.5).alias("peaks"))


@q("j14_with_representative")
def _(t):
    # each record against its molecule's richest spectrum: linear in the records, where all pairs of a hot molecule aren't
    s = B.clean_lists(t.train_spectra.where("inchikey14 is not null"), "rid", "ms2_mzs", "ms2_normalized_intensities", "precursor_mz", ("inchikey14", "num_peaks"), sound=False)
    s = s.select(F.col("id").alias("rid"), "inchikey14", "num_peaks", F.col("mz").alias("m"), F.col("it").alias("v"))
    rep = R.first_by(s, ["inchikey14"], [F.desc("num_peaks"), F.col("rid")]).select("inchikey14", F.col("rid").alias("rep"), F.col("m").alias("ma"), F.col("v").alias("wa"))
    hot = hot_keys(t.train_spectra.where("inchikey14 is not null").groupBy("inchikey14").agg(F.count("*").alias("n")), "inchikey14")
    pairs = salted_join(s, rep, "inchikey14", hot, "rid", "inner").where("rid <> rep").select("rid", "rep", "ma", "wa", F.col("m").alias("mb"), F.col("v").alias("wb"))
    return S.score_pairs(pairs, "cosine").select("rid", "rep", F.round("score", 6).alias("score"))


@q("j25_nearest_profile", """WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
    d AS (SELECT e.vec_id, c.label, list_max(list_transform(list_zip(e.embedding, c.v), lambda z: abs(z[1]::DOUBLE - z[2]))) AS d FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), label) AS r FROM d)
    SELECT vec_id, max(label) FILTER (WHERE r = 1) AS label, round(round(max(d) FILTER (WHERE r = 1), 9), 5) AS d1, round(round(max(d) FILTER (WHERE r = 2), 9), 5) AS d2 FROM r GROUP BY vec_id""")
def _(t):
    from peakloom.operators.learning import mean_views

    centres = mean_views(t.embeddings.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v")), "label", "v")
    # all centres stand in one row, so each vector meets each once without a cross join; there are as many as labels
    table = [(r.label, r.v) for r in centres.collect()]
    shelf = F.array(*[F.struct(F.lit(n).alias("label"), F.array(*[F.lit(float(x)) for x in v]).alias("c")) for n, v in sorted(table)])
    far = F.transform(shelf, lambda s: F.struct(F.round(F.array_max(F.zip_with("embedding", s["c"], lambda x, y: F.abs(x.cast("double") - y))), 9).alias("d"), s["label"].alias("label")))
    near = t.embeddings.select("vec_id", F.array_sort(far).alias("n"))
    return near.select("vec_id", F.col("n")[0]["label"].alias("label"), F.round(F.col("n")[0]["d"], 5).alias("d1"), F.round(F.col("n")[1]["d"], 5).alias("d2"))


@q("k15_binned_cosine", f"WITH {BINS}, sc AS (SELECT a.rid, sum(a.w * b.w) AS c FROM n a JOIN n b ON a.bin = b.bin AND b.rid = (SELECT min(rid) FROM n) GROUP BY a.rid) SELECT rid, round(c, 5) AS sim FROM sc")
def _(t):
    f = features(t)
    # the cells of one record, at most twice its 150 peaks
    first = f.orderBy("id").limit(1).select(F.explode(F.arrays_zip("cells", "weights")).alias("c")).select("c.cells", F.col("c.weights").alias("v"))
    each = f.select("id", F.explode(F.arrays_zip("cells", "weights")).alias("c")).select("id", "c.cells", "c.weights")
    return each.join(F.broadcast(first), "cells").groupBy(F.col("id").alias("rid")).agg(F.round(F.sum(F.col("weights") * F.col("v")), 5).alias("sim"))


@q("k30_subformula_shares")
def _(t):
    def run(batches):
        import functools

        @functools.lru_cache(maxsize=4096)
        def search(formula):
            counts = C.parse_formula(formula or "")
            return counts and C.subformula_search(counts)

        for pdf in batches:
            out = []
            for rid, formula, adduct, mz in zip(pdf.rid, pdf.molecular_formula, pdf.adduct, pdf.mz):
                if search(formula) and mz is not None and len(mz):
                    ok = np.any([search(formula)(np.asarray(mz, "f8") - ion, 0.005) for ion in C.charge_carriers(adduct)], axis=0)
                    out.append((rid, float(ok.mean())))
            yield pd.DataFrame(out, columns=["rid", "share"])

    s = t.train_spectra.select("rid", "molecular_formula", "adduct", F.transform(S.peaks_of(), lambda p: p["mz"]).alias("mz"))
    return s.mapInPandas(run, "rid bigint, share double").select("rid", F.round("share", 5).alias("share"))


@q("k31_own_references", """WITH s AS (SELECT r.rid, r.inchikey14 AS k, unnest(r.ms2_mzs) AS mz FROM train_spectra r WHERE r.inchikey14 IS NOT NULL), c AS (SELECT k, CAST(floor(mz / 0.05) AS BIGINT) AS cell, count(DISTINCT rid) AS spectra FROM s GROUP BY ALL)
    SELECT k, count(*) AS cells, count(*) FILTER (WHERE spectra > 1) AS shared, max(spectra) AS most FROM c GROUP BY k""")
def _(t):
    s = t.train_spectra.where("inchikey14 is not null").select("rid", F.col("inchikey14").alias("k"), F.explode(F.array_distinct(F.transform("ms2_mzs", lambda m: F.floor(m / 0.05)))).alias("cell"))
    c = s.groupBy("k", "cell").agg(F.count("*").alias("spectra"))
    return c.groupBy("k").agg(F.count("*").alias("cells"), F.count_if(F.col("spectra") > 1).alias("shared"), F.max("spectra").alias("most"))


@q("k35_leak_clean_support", """WITH p AS (SELECT formula, inchikey14 AS a, coalesce(key, inchikey14) AS b FROM train_structs), h AS (SELECT inchikey14 AS k FROM train_structs WHERE sid % 10 = 0)
    SELECT formula, count(*) AS support, count(*) FILTER (WHERE a NOT IN (SELECT k FROM h) AND b NOT IN (SELECT k FROM h)) AS clean FROM p GROUP BY formula""")
def _(t):
    held = t.train_structs.where("sid % 10 = 0").select(F.col("inchikey14").alias("k"), F.lit(1).alias("x"))
    p = t.train_structs.select("formula", F.col("inchikey14").alias("a"), F.coalesce("key", "inchikey14").alias("b"))
    p = p.join(held.select(F.col("k").alias("a"), F.col("x").alias("xa")), "a", "left").join(held.select(F.col("k").alias("b"), F.col("x").alias("xb")), "b", "left")
    return p.groupBy("formula").agg(F.count("*").alias("support"), F.count_if(F.col("xa").isNull() & F.col("xb").isNull()).alias("clean"))


@q("o6_similarity_strata", f"{SIMS}, k AS (SELECT d.* FROM d JOIN train_spectra a ON a.rid = d.qid JOIN train_spectra b ON b.rid = d.rid WHERE a.inchikey14 IS DISTINCT FROM b.inchikey14), mx AS (SELECT qid, max(sim) AS sim FROM k GROUP BY qid) SELECT CASE WHEN sim >= 0.8 THEN 'S1' WHEN sim >= 0.6 THEN 'S2' WHEN sim >= 0.4 THEN 'S3' WHEN sim >= 0.2 THEN 'S4' ELSE 'S5' END AS stratum, count(*) AS n FROM mx GROUP BY 1")
def _(t):
    best = knn(t, masked=True).where("rank = 1")
    s = F.when(F.col("sim") >= 0.8, "S1").when(F.col("sim") >= 0.6, "S2").when(F.col("sim") >= 0.4, "S3").when(F.col("sim") >= 0.2, "S4").otherwise("S5")
    return best.groupBy(s.alias("stratum")).agg(F.count("*").alias("n"))


def _mrr(rank_sql: str) -> str:
    return f"round(avg(CASE WHEN {rank_sql} <= 25 THEN 1.0::DOUBLE / {rank_sql} ELSE 0 END), 6)"


@q("o7_intervention", CTE + """, w AS (SELECT ra.*, truth.key AS tk, row_number() OVER (PARTITION BY ra.mid ORDER BY ra.rank) AS x FROM ra JOIN truth ON truth.mid = ra.mid WHERE ra.key <> truth.key), k AS (SELECT ra.mid, ra.key, row_number() OVER (PARTITION BY ra.mid ORDER BY ra.rank) AS r FROM ra WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.mid = ra.mid AND w.key = ra.key AND w.x <= 1)),
    b AS (SELECT truth.mid, min(ra.rank) AS r0 FROM truth LEFT JOIN ra ON ra.mid = truth.mid AND ra.key = truth.key GROUP BY 1), a AS (SELECT truth.mid, min(k.r) AS r1 FROM truth LEFT JOIN k ON k.mid = truth.mid AND k.key = truth.key GROUP BY 1) """ + f"SELECT {_mrr('r0')} AS before, {_mrr('r1')} AS after FROM b JOIN a USING (mid)")
def _(t):
    # the best wrong candidate of each list is taken out, and the lists close up
    lists, right = la(t), truth(t)
    wrong = R.top_k(lists.join(right, ["mid", "key"], "left_anti"), ["mid"], [F.col("rank")], 1, "x").select("mid", "key")
    left = lists.join(wrong, ["mid", "key"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("mid").orderBy("rank")).cast("bigint"))
    rr = lambda df, n: V.answer_ranks(df, right).select("mid", F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0).alias(n))
    return rr(lists, "b").join(rr(left, "a"), "mid").agg(F.round(F.avg("b"), 6).alias("before"), F.round(F.avg("a"), 6).alias("after"))


@q("v5_stable_ties", CTE + ", r AS (SELECT truth.mid, count(*) FILTER (WHERE l.a > t.a) + count(*) FILTER (WHERE l.a = t.a AND l.key < t.key) + 1 AS r FROM truth JOIN l t ON t.mid = truth.mid AND t.key = truth.key JOIN l ON l.mid = truth.mid GROUP BY 1) " + f"SELECT count(*) AS n, {_mrr('r')} AS mrr FROM r")
def _(t):
    s = cands(t)
    best = s.join(truth(t), ["mid", "key"], "left_semi").select("mid", F.col("a").alias("ta"), F.col("key").alias("tk"))
    r = s.join(best, "mid").groupBy("mid").agg((F.count_if((F.col("a") > F.col("ta")) | ((F.col("a") == F.col("ta")) & (F.col("key") < F.col("tk")))) + 1).alias("r"))
    return r.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr"))


@q("v18_bench_slices", CTE + ", r AS (SELECT truth.mid, min(ra.rank) AS r FROM truth LEFT JOIN ra ON ra.mid = truth.mid AND ra.key = truth.key GROUP BY 1), s AS (SELECT mid, CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) <= 4 THEN 'few' ELSE 'many' END AS slice FROM l GROUP BY mid) " + f"SELECT slice, count(*) AS n, {_mrr('r')} AS mrr FROM r JOIN s USING (mid) GROUP BY slice")
def _(t):
    n = cands(t).groupBy("mid").agg(F.count("*").alias("c")).select("mid", F.when(F.col("c") == 1, "one").when(F.col("c") <= 4, "few").otherwise("many").alias("slice"))
    r = V.answer_ranks(la(t), truth(t)).join(n, "mid")
    return r.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr"))


queries, oracle_sql = q.queries, q.oracle_sql
