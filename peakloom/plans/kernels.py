"""Spectrum, mass and fingerprint kernels over whole tables."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.functions import chem as C
from peakloom.functions import fingerprints as P
from peakloom.functions import spectra as S
from peakloom.operators import blocks as B
from peakloom.operators import joins as J
from peakloom.operators import ranking as R
from peakloom.plans.registry import Registry
from peakloom.session import cut

q = Registry()
PEAKS = "SELECT rid, precursor_mz, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS it FROM train_spectra"
SOUND = f"SELECT * FROM ({PEAKS}) WHERE mz > 0 AND it > 0 AND NOT isnan(mz) AND NOT isnan(it)"
CLEAN = f"""c AS (SELECT * FROM ({SOUND}) WHERE precursor_mz IS NULL OR isnan(precursor_mz) OR mz <= precursor_mz + 0.5), b AS (SELECT *, max(it) OVER (PARTITION BY rid) AS base FROM c),
    k AS (SELECT rid, mz, it / base AS it, row_number() OVER (PARTITION BY rid ORDER BY it DESC, mz) AS r FROM b WHERE it >= 0.01 * base), p AS (SELECT * FROM k WHERE r <= 100)"""


@q("k1_sorted_peaks", f"SELECT rid, count(*) AS n, round(arg_min(it, mz), 6) AS first_it FROM ({SOUND}) GROUP BY rid HAVING count(DISTINCT mz) = count(*)")
def _(t):
    s = t.train_spectra.select("rid", S.peaks_of().alias("p"))
    return s.where((F.size("p") > 0) & (F.size(F.array_distinct(F.transform("p", lambda x: x["mz"]))) == F.size("p"))).select("rid", F.size("p").cast("bigint").alias("n"), F.round(F.col("p")[0]["it"], 6).alias("first_it"))


@q("k2_clean", f"WITH {CLEAN} SELECT rid, count(*) AS n, round(sum(it), 6) AS total, round(min(mz), 6) AS lo, round(max(mz), 6) AS hi FROM p GROUP BY rid")
def _(t):
    s = S.clean_peaks(t.train_spectra.select("rid", "precursor_mz", "ms2_mzs", "ms2_normalized_intensities")).where(F.size("peaks") > 0)
    return s.select("rid", F.size("peaks").cast("bigint").alias("n"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["it"]), 6).alias("total"), F.round(F.col("peaks")[0]["mz"], 6).alias("lo"), F.round(F.element_at("peaks", -1)["mz"], 6).alias("hi"))


@q("k4_entropy_weights", f"""WITH {CLEAN}, n AS (SELECT rid, it / sum(it) OVER (PARTITION BY rid) AS p FROM p), e AS (SELECT *, abs(sum(p * ln(p)) OVER (PARTITION BY rid)) AS s FROM n),
    w AS (SELECT rid, s, CASE WHEN s < 3 THEN pow(p, 0.25 + 0.25 * s) ELSE p END AS w FROM e) SELECT rid, round(max(s), 5) AS entropy, round(max(w) / sum(w), 5) AS top_weight FROM w GROUP BY rid""")
def _(t):
    s = S.clean_peaks(t.train_spectra.select("rid", "precursor_mz", "ms2_mzs", "ms2_normalized_intensities")).where(F.size("peaks") > 0)
    return S.entropy_weights(s).select("rid", F.round(F.abs("entropy"), 5).alias("entropy"), F.round(F.array_max("weights"), 5).alias("top_weight"))


@q("k12_merged_predictions", f"""WITH m AS (SELECT inchikey14 AS g, floor(mz * 10000 + 0.5) / 10000 AS mz, sum(it) AS it FROM (SELECT inchikey14, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS it FROM train_spectra) WHERE mz > 0 AND it > 0 AND g IS NOT NULL GROUP BY ALL)
    SELECT g, mz, round(it, 6) AS it FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(it, 9) DESC, mz) AS r FROM m) WHERE r <= 100""")
def _(t):
    m = S.merge_predictions(t.train_spectra.where("inchikey14 is not null").select(F.col("inchikey14").alias("g"), "ms2_mzs", "ms2_normalized_intensities"), "g")
    return m.select("g", "mz", F.round("it", 6).alias("it"))


@q("k13_window_picks", f"""WITH s AS ({SOUND}), w AS (SELECT rid, mz, it, row_number() OVER (PARTITION BY rid, floor(mz / 50) ORDER BY it DESC, mz) AS w FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN w > 8 THEN 1 ELSE 0 END, it DESC, mz) AS rank FROM w)
    SELECT rid, count(*) AS n, round(sum(sqrt(it)), 5) AS total FROM r WHERE rank <= 128 GROUP BY rid""")
def _(t):
    p = S.window_picks(t.train_spectra.select("rid", "ms2_mzs", "ms2_normalized_intensities"), "rid")
    return p.groupBy("rid").agg(F.count("*").alias("n"), F.round(F.sum("it"), 5).alias("total"))


BINS = f"""s AS (SELECT rid, precursor_mz, mz, sqrt(it) AS v FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY it DESC, mz) AS r FROM ({SOUND})) WHERE r <= 150), x AS (SELECT rid, CAST(floor(mz / 0.1::DOUBLE) AS BIGINT) AS bin, v FROM s
    UNION ALL SELECT rid, CAST(-1 - floor((precursor_mz - mz) / 0.1::DOUBLE) AS BIGINT), v FROM s WHERE precursor_mz - mz > 0.5 AND NOT isnan(precursor_mz)), f AS (SELECT rid, bin, sum(v) AS v FROM x GROUP BY ALL),
    n AS (SELECT rid, bin, v / sqrt(sum(v * v) OVER (PARTITION BY rid)) AS w FROM f)"""


def features(t, *more: str):
    """(id, cells, weights, ...) of the 150 strongest peaks in cells of 0.1."""
    return B.peak_cells(t.train_spectra, "rid", "ms2_mzs", "ms2_normalized_intensities", "precursor_mz", 0.1, 150, more=more)


@q("k14_bin_features", f"WITH {BINS} SELECT rid, count(*) AS n, round(sum(w), 5) AS total, min(bin) AS lo, max(bin) AS hi FROM n GROUP BY rid")
def _(t):
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return features(t).select(F.col("id").alias("rid"), F.size("cells").cast("bigint").alias("n"), F.round(total, 5).alias("total"), F.array_min("cells").alias("lo"), F.array_max("cells").alias("hi"))


def knn(t, masked=False):
    """(qid, rid, sim, rank): the five nearest of the same polarity to each record whose rid is divisible by 100; masked leaves out those of its own molecule."""
    more = ("ionization_mode", "inchikey14") if masked else ("ionization_mode",)
    f = features(t, *more).where("ionization_mode is not null").withColumnsRenamed({"ionization_mode": "grp", "inchikey14": "apart"})
    return B.nearest_by_cells(f, cut(f.where("id % 100 = 0"), "asked"), 5, digits=9, itself=True).withColumnsRenamed({"query": "qid", "other": "rid"})


SIMS = f"WITH {BINS}, m AS (SELECT n.*, t.ionization_mode AS mode FROM n JOIN train_spectra t USING (rid)), d AS (SELECT a.rid AS qid, b.rid, round(sum(a.w * b.w), 9) AS sim FROM m a JOIN m b ON a.bin = b.bin AND a.mode = b.mode WHERE a.rid % 100 = 0 GROUP BY ALL)"


@q("j20_nearest_spectra", f"{SIMS} SELECT qid, rank, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS rank FROM d) WHERE rank <= 5")
def _(t):
    return knn(t).select("qid", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 5).alias("sim"))


@q("j21_masked_nearest", f"{SIMS}, k AS (SELECT d.* FROM d JOIN train_spectra a ON a.rid = d.qid JOIN train_spectra b ON b.rid = d.rid WHERE a.inchikey14 IS DISTINCT FROM b.inchikey14) SELECT qid, rank, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS rank FROM k) WHERE rank <= 5")
def _(t):
    return knn(t, masked=True).select("qid", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 5).alias("sim"))


def best_scores(t, kind, reach=0.01, at=0.0):
    """(qid, rid, score, r): the five best of the same adduct and precursor to each record whose rid is divisible by 100."""
    found = B.best_by_peaks(t.train_spectra, F.col("rid") % 100 == 0, kind, 5, reach, at)
    return found.select(F.col("query").alias("qid"), F.col("other").alias("rid"), F.col("sim").alias("score"), F.col("rank").alias("r"))


@q("k5_entropy_similarity")
def _(t):
    return best_scores(t, "entropy")


@q("k6_cosine")
def _(t):
    return best_scores(t, "cosine")


@q("k9_modified_cosine")
def _(t):
    return best_scores(t, "modified")


@q("k7_shifted_similarity")
def _(t):
    # analogues: structures one oxygen lighter, asked for by their records
    return best_scores(t, "shifted", at=15.99491)


@q("k8_analogues")
def _(t):
    # one query against all references of its adduct within 150 Da, at shifted places too
    return best_scores(t, "shifted", reach=150.0)


@q("k10_greedy_cosine")
def _(t):
    return best_scores(t, "greedy")


@q("k11_merged_queries")
def _(t):
    m = S.merged_by_group(t.test_spectra.where("molecule_id is not null"), "molecule_id")
    return m.select("molecule_id", F.size("mz").cast("bigint").alias("n"), F.round(F.array_max("mz"), 6).alias("top"))


@q("k16_votes")
def _(t):
    fp = t.train_structs.select("inchikey14", P.words("fp").alias("w")).where("w is not null")
    near = knn(t).join(t.train_spectra.select("rid", "inchikey14"), "rid").join(fp, "inchikey14").withColumn("b", P.bits("w"))
    return P.vote(near, "qid", "sim", "b").groupBy("qid").agg(F.round(F.sum("p"), 5).alias("expected_bits"), F.count_if(F.col("p") > 0.5).alias("likely_bits"))


WINDOW = "SELECT a.sid AS qid, b.sid, a.fp AS fa, b.fp AS fb, b.n_heavy FROM train_structs a JOIN train_structs b ON b.mass BETWEEN a.mass - 1.0 AND a.mass + 1.0 AND a.sid <> b.sid WHERE a.sid % 10 = 0 AND octet_length(a.fp) = 128 AND octet_length(b.fp) = 128"


def fp_pairs(t):
    s = t.train_structs.select("sid", "mass", P.words("fp").alias("w")).where("w is not null and mass is not null")
    a = s.where("sid % 10 = 0").select(F.col("sid").alias("qid"), F.col("mass").alias("m"), F.col("w").alias("wa"))
    return J.tolerance_join(a, s.select("sid", "mass", F.col("w").alias("wb")), "m", "mass", da=1.0, width=1.0).where("sid <> qid")


@q("k20_tanimoto_in_window", f"WITH p AS ({WINDOW}), s AS (SELECT qid, sid, round(coalesce(bit_count(fa::BIT & fb::BIT) / nullif(bit_count(fa::BIT | fb::BIT), 0), 0), 6) AS sim FROM p) SELECT qid, sid, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, sid) AS r FROM s) WHERE r <= 5")
def _(t):
    s = fp_pairs(t).select("qid", "sid", F.round(P.tanimoto("wa", "wb"), 6).alias("sim"))
    return R.top_k(s, ["qid"], [F.desc("sim"), F.col("sid")], 5).select("qid", "sid", "sim")


@q("k21_propagated", f"""WITH p AS ({WINDOW}), s AS (SELECT qid, sid, coalesce(bit_count(fa::BIT & fb::BIT) / nullif(bit_count(fa::BIT | fb::BIT), 0), 0) * pow(0.5, 4) AS s FROM p) SELECT qid, round(max(s), 6) AS best, round(sum(s), 5) AS total, round(avg(s), 6) AS mean FROM s GROUP BY qid""")
def _(t):
    p = fp_pairs(t)
    asked = t.train_structs.where("sid % 10 = 0 and mass is not null").select(F.col("sid").alias("qid"), P.words("fp").alias("w")).where("w is not null").withColumn("key", F.lit("self"))
    analogs = p.select("qid", F.col("wb").alias("w"), F.lit(0.5).alias("sim"))
    return P.propagate(asked, analogs, "qid", "key").select("qid", F.round("best", 6).alias("best"), F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean"))


VEC = "SELECT a.vec_id AS qid, b.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"


def vec_pairs(t):
    e = t.embeddings
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("x"))
    return a.join(e.select("vec_id", "label", F.col("embedding").alias("y")), "label").where("vec_id <> qid")


@q("k17_cosine_scores", f"WITH p AS ({VEC}) SELECT qid, vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE)))), 5) AS score FROM p")
def _(t):
    return vec_pairs(t).select("qid", "vec_id", F.round(P.cosine("x", "y"), 5).alias("score"))


@q("k18_bernoulli_scores", f"WITH p AS ({VEC}) SELECT qid, vec_id, round(list_sum(list_transform(list_zip(y, x), lambda z: CASE WHEN z[1] > 0 THEN ln(least(greatest(1 / (1 + exp(-z[2]::DOUBLE)), 0.01), 0.99)) ELSE ln(1 - least(greatest(1 / (1 + exp(-z[2]::DOUBLE)), 0.01), 0.99)) END)), 5) AS score FROM p")
def _(t):
    p = vec_pairs(t).withColumn("b", F.transform("y", lambda v: (v > 0).cast("int"))).withColumn("pr", F.transform("x", lambda v: 1 / (1 + F.exp(-v.cast("double")))))
    return p.select("qid", "vec_id", F.round(P.bernoulli("b", "pr"), 5).alias("score"))


@q("k19_bit_logit_dot", f"WITH p AS ({VEC}) SELECT qid, vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: CASE WHEN z[1] > 0 THEN z[2]::DOUBLE ELSE 0 END)), 5) AS score FROM p")
def _(t):
    return vec_pairs(t).withColumn("b", F.transform("x", lambda v: (v > 0).cast("int"))).select("qid", "vec_id", F.round(P.dot("b", "y"), 5).alias("score"))


@q("k22_library_evidence", """WITH s AS (SELECT ik AS mid, depositor AS query, cid AS cand, max(coalesce(trust, 0)) AS s FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL), nq AS (SELECT mid, count(DISTINCT query) AS nq FROM s GROUP BY mid),
    r AS (SELECT *, row_number() OVER (PARTITION BY mid, cand ORDER BY s DESC, query) AS r FROM s) SELECT mid, cand, max(s) AS best, round(sum(s) / max(nq), 6) AS mean_all, round(avg(s) FILTER (WHERE r <= 3), 6) AS mean_top3, round(ln(1 + count(*) / max(nq)), 6) AS support FROM r JOIN nq USING (mid) GROUP BY mid, cand""")
def _(t):
    s = t.pubchem_rows.where("ik is not null").groupBy(F.col("ik").alias("mid"), F.col("depositor").alias("query"), F.col("cid").alias("cand")).agg(F.max(F.coalesce("trust", F.lit(0))).alias("s"))
    nq = s.groupBy("mid").agg(F.count_distinct("query").alias("nq"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("mid", "cand").orderBy(F.desc("s"), F.col("query").asc_nulls_last())))
    return r.join(nq, "mid").groupBy("mid", "cand").agg(F.max("s").alias("best"), F.round(F.sum("s") / F.max("nq"), 6).alias("mean_all"), F.round(F.avg(F.when(F.col("r") <= 3, F.col("s"))), 6).alias("mean_top3"), F.round(F.ln(1 + F.count("*") / F.max("nq")), 6).alias("support"))


MASSES = ", ".join(f"'{e}': {m!r}" for e, m in C.MASS.items())


@q("k24_formula_mass", f"""WITH f AS (SELECT DISTINCT formula FROM train_structs WHERE formula IS NOT NULL), p AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1)) AS e, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 2)) AS n FROM f)
    SELECT formula, round(sum(MAP {{{MASSES}}}[e]::DOUBLE * CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END), 5) AS mass, CAST(sum(CASE WHEN e = 'C' THEN CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END ELSE 0 END) AS BIGINT) AS carbons FROM p GROUP BY formula""")
def _(t):
    f = t.train_structs.where("formula is not null").select("formula").distinct()
    return f.select("formula", F.round(C.formula_mass("formula"), 5).alias("mass"), C.element_count("formula", "C").cast("bigint").alias("carbons"))


ADDUCTS = ", ".join("('{}', {}, {}, {!r})".format(a, *C.parse_adduct(a)[:3]) for a in ("[M+H]+", "[M+Na]+", "[M+K]+", "[M+NH4]+", "[M-H2O+H]+", "[M-H]-", "[M+CH2O2-H]-", "[M+Cl]-", "[2M+H]+", "[M+2H]2+", "[M-H2O-H]-", "[M-2H2O+H]+", "[2M+Na]+", "[2M-H]-"))


@q("k25_adducts", f"SELECT a.adduct, v.n, v.z, round(v.delta, 6) AS delta FROM (SELECT DISTINCT adduct FROM train_spectra WHERE adduct IS NOT NULL) a LEFT JOIN (VALUES {ADDUCTS}) v(adduct, n, z, delta) USING (adduct)")
def _(t):
    return C.adduct_table(t.train_spectra).select("adduct", "n", "z", F.round("delta", 6).alias("delta"))


@q("k26_neutral_mass", f"SELECT spectrum_id, round((precursor_mz * v.z - v.delta) / v.n, 5) AS neutral_mass FROM test_spectra LEFT JOIN (VALUES {ADDUCTS}) v(adduct, n, z, delta) USING (adduct) WHERE precursor_mz IS NOT NULL AND NOT isnan(precursor_mz)")
def _(t):
    return C.neutral_mass(t.test_spectra.where("precursor_mz is not null and not isnan(precursor_mz)")).select("spectrum_id", F.round("neutral_mass", 5).alias("neutral_mass"))


@q("k37_rule_combinations", """WITH r AS (SELECT * FROM (VALUES (1, 14.01565), (2, 15.994915), (3, 18.010565), (4, 2.01565), (5, 42.010565)) r(id, d)), c AS (SELECT a.id AS a, b.id AS b, round(a.d::DOUBLE + b.d::DOUBLE, 6) AS d FROM r a JOIN r b ON a.id <= b.id UNION ALL SELECT id, NULL, round(d::DOUBLE, 6) FROM r),
    m AS (SELECT x.sid, y.sid AS other, y.mass - x.mass AS diff FROM train_structs x JOIN train_structs y ON y.mass > x.mass AND y.mass <= x.mass + 90 WHERE x.sid % 10 = 0) SELECT c.a, c.b, count(*) AS n FROM m JOIN c ON m.diff BETWEEN c.d - 0.001 AND c.d + 0.001 GROUP BY c.a, c.b""")
def _(t):
    rules = {1: 14.01565, 2: 15.994915, 3: 18.010565, 4: 2.01565, 5: 42.010565}
    combos = [(a, b, round(rules[a] + rules[b], 6)) for a in rules for b in rules if a <= b] + [(a, None, d) for a, d in rules.items()]
    asked = t.train_structs.where("sid % 10 = 0 and mass is not null").select("sid", F.col("mass").alias("m"))
    # twenty combinations stand at each asked structure, then one range join
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).cast("int").alias("b"), F.lit(d).alias("d")) for a, b, d in combos]))
    wanted = asked.select("sid", "m", each.alias("c")).select("sid", "c.a", "c.b", (F.col("m") + F.col("c.d") - 0.001).alias("lo"), (F.col("m") + F.col("c.d") + 0.001).alias("hi"), "m", "c.d")
    hit = J.range_join(wanted, t.train_structs.select(F.col("sid").alias("other"), "mass"), "lo", "hi", "mass", 0.01)
    return hit.where((F.col("mass") > F.col("m")) & (F.col("mass") - F.col("m")).between(F.col("d") - 0.001, F.col("d") + 0.001)).groupBy("a", "b").agg(F.count("*").alias("n"))


queries, oracle_sql = q.queries, q.oracle_sql
