"""Joins, aggregations, windows, top-k, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import joins as J
from peakloom.operators import ranking as R
from peakloom.plans.registry import Registry

q = Registry()
FINITE = "precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND precursor_mz > 0"


def finite(df):
    return df.where(F.col("precursor_mz").isNotNull() & ~F.isnan("precursor_mz") & (F.col("precursor_mz") > 0))


# ---- joins
@q("j2_range_join", f"""SELECT t.spectrum_id, count(*) AS n, min(r.rid) AS first_rid FROM test_spectra t JOIN train_spectra r ON r.precursor_mz BETWEEN t.precursor_mz - 0.01 AND t.precursor_mz + 0.01
    WHERE t.precursor_mz > 0 AND NOT isnan(t.precursor_mz) AND NOT isnan(r.precursor_mz) GROUP BY 1""")
def _(t):
    w = finite(t.test_spectra).select("spectrum_id", (F.col("precursor_mz") - 0.01).alias("lo"), (F.col("precursor_mz") + 0.01).alias("hi"))
    return J.range_join(w, t.train_spectra.select("rid", F.col("precursor_mz").alias("p")), "lo", "hi", "p", 0.02).groupBy("spectrum_id").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"))


@q("j2_candidates_by_mass", """SELECT s.sid, count(*) AS n FROM train_structs s JOIN pubchem_rows p ON p.mass BETWEEN s.mass - s.mass * 5e-6 AND s.mass + s.mass * 5e-6 WHERE s.mass > 0 AND p.mass > 0 AND p.mass < 5000 GROUP BY 1""")
def _(t):
    s = t.train_structs.where("mass > 0").select("sid", F.col("mass").alias("m"))
    return J.tolerance_join(s, t.pubchem_rows.where("mass > 0 and mass < 5000").select("cid", "mass"), "m", "mass", ppm=5.0).groupBy("sid").agg(F.count("*").alias("n"))


@q("j4_fallback_tolerance", """WITH w AS (SELECT s.sid, p.cid, abs(p.mass - s.mass) / s.mass * 1e6 AS ppm FROM train_structs s JOIN (SELECT DISTINCT cid, mass FROM pubchem_rows WHERE mass > 0 AND mass < 5000) p
        ON p.mass BETWEEN s.mass - abs(s.mass) * 30 * 1e-6 AND s.mass + abs(s.mass) * 30 * 1e-6 WHERE s.mass > 0),
    n AS (SELECT *, max(CASE WHEN ppm <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY sid) AS near FROM w) SELECT sid, count(*) AS n, bool_or(near = 1) AS near FROM n WHERE ppm <= 10 OR near = 0 GROUP BY sid""")
def _(t):
    s = t.train_structs.where("mass > 0").select("sid", F.col("mass").alias("m"))
    p = t.pubchem_rows.where("mass > 0 and mass < 5000").select("cid", "mass").distinct()
    return J.fallback_window(s, p, "sid", "m", "mass", 10.0, 30.0).groupBy("sid").agg(F.count("*").alias("n"), F.bool_or(F.col("ppm") <= 10).alias("near"))


@q("j5_range_semi", "SELECT rid FROM train_spectra r WHERE r.precursor_mz > 0 AND NOT isnan(r.precursor_mz) AND EXISTS (SELECT 1 FROM test_spectra t WHERE t.qset = 'public' AND NOT isnan(t.precursor_mz) AND r.precursor_mz BETWEEN t.precursor_mz - 0.005 AND t.precursor_mz + 0.005)")
def _(t):
    w = t.test_spectra.where("qset = 'public'").select((F.col("precursor_mz") - 0.005).alias("lo"), (F.col("precursor_mz") + 0.005).alias("hi")).distinct()
    return J.range_join(w, finite(t.train_spectra).select("rid", "precursor_mz"), "lo", "hi", "precursor_mz", 0.01, how="semi").select("rid")


@q("j6_band_then_window", """WITH t AS (SELECT precursor_mz AS p FROM test_spectra WHERE precursor_mz > 0 AND NOT isnan(precursor_mz)), b AS (SELECT min(p) - 0.01::DOUBLE AS lo, max(p) + 0.01::DOUBLE AS hi FROM t),
    w AS (SELECT rid, precursor_mz AS p FROM train_spectra, b WHERE precursor_mz BETWEEN lo AND hi) SELECT count(*) AS n FROM w WHERE EXISTS (SELECT 1 FROM t WHERE w.p BETWEEN t.p - 0.01::DOUBLE AND t.p + 0.01::DOUBLE)""")
def _(t):
    asked = finite(t.test_spectra)
    w = asked.select((F.col("precursor_mz") - 0.01).alias("lo"), (F.col("precursor_mz") + 0.01).alias("hi"))
    lo, hi = asked.agg(F.min("precursor_mz") - 0.01, F.max("precursor_mz") + 0.01).first()
    # one pushed-down band for all queries, then the exact windows
    band = t.train_spectra.where(F.col("precursor_mz").between(lo, hi)).select("rid", "precursor_mz")
    return J.range_join(w, band, "lo", "hi", "precursor_mz", 0.02, how="semi").agg(F.count("*").alias("n"))


@q("j7_using_join", "SELECT r.rid, s.sid, s.n_heavy FROM train_spectra r JOIN train_structs s USING (inchikey14)")
def _(t):
    return t.train_spectra.select("rid", "inchikey14").join(t.train_structs.select("inchikey14", "sid", "n_heavy"), "inchikey14").select("rid", "sid", "n_heavy")


@q("j8_left_join_aggregate", "SELECT s.sid, coalesce(a.n, 0) AS n, a.libs FROM train_structs s LEFT JOIN (SELECT inchikey14, count(*) AS n, count(DISTINCT ingest_lib) AS libs FROM train_spectra GROUP BY 1) a USING (inchikey14)")
def _(t):
    a = t.train_spectra.groupBy("inchikey14").agg(F.count("*").alias("n"), F.count_distinct("ingest_lib").alias("libs"))
    return t.train_structs.select("sid", "inchikey14").join(a, "inchikey14", "left").select("sid", F.coalesce("n", F.lit(0)).alias("n"), "libs")


@q("j9_left_residual", "SELECT s.sid, count(p.cid) AS n FROM train_structs s LEFT JOIN pubchem_rows p ON p.ik = s.inchikey14 AND abs(p.mass - s.mass) <= 0.01 GROUP BY s.sid")
def _(t):
    s, p = t.train_structs.select("sid", "inchikey14", "mass"), t.pubchem_rows.select("ik", "cid", F.col("mass").alias("pm"))
    return s.join(p, (p.ik == s.inchikey14) & (F.abs(p.pm - s.mass) <= 0.01), "left").groupBy("sid").agg(F.count("cid").alias("n"))


@q("j10_presence_counts", """SELECT count(*) AS n, count(a.inchikey14) AS in_train, count(b.ik) AS in_pubchem FROM train_structs s LEFT JOIN (SELECT DISTINCT inchikey14 FROM train_spectra) a USING (inchikey14) LEFT JOIN (SELECT DISTINCT ik FROM pubchem_rows) b ON b.ik = s.inchikey14""")
def _(t):
    a = t.train_spectra.select("inchikey14").distinct().withColumn("a", F.lit(1))
    b = t.pubchem_rows.select(F.col("ik").alias("inchikey14")).distinct().withColumn("b", F.lit(1))
    return t.train_structs.select("inchikey14").join(a, "inchikey14", "left").join(b, "inchikey14", "left").agg(F.count("*").alias("n"), F.count("a").alias("in_train"), F.count("b").alias("in_pubchem"))


@q("j11_semi", "SELECT cid, ik FROM pubchem_rows WHERE EXISTS (SELECT 1 FROM train_structs s WHERE s.inchikey14 = ik AND s.charged)")
def _(t):
    return t.pubchem_rows.select("cid", "ik").join(t.train_structs.where("charged").select(F.col("inchikey14").alias("ik")), "ik", "left_semi").select("cid", "ik")


@q("j12_anti", "SELECT sid FROM train_structs s WHERE NOT EXISTS (SELECT 1 FROM train_spectra r WHERE r.inchikey14 = s.inchikey14)")
def _(t):
    return t.train_structs.join(t.train_spectra.select("inchikey14"), "inchikey14", "left_anti").select("sid")


@q("j13_replicate_cells", """WITH c AS (SELECT inchikey14 AS k, ingest_lib AS l, adduct AS a, count(*) AS n FROM train_spectra WHERE inchikey14 IS NOT NULL AND adduct IS NOT NULL GROUP BY ALL)
    SELECT x.k, count(*) AS pairs, CAST(sum(x.n * y.n) AS BIGINT) AS weight FROM c x JOIN c y ON x.k = y.k AND (x.l, x.a) > (y.l, y.a) GROUP BY x.k""")
def _(t):
    # cells of a molecule are few (libraries x adducts), however many records it has
    c = t.train_spectra.where("inchikey14 is not null and adduct is not null").groupBy(F.col("inchikey14").alias("k"), F.col("ingest_lib").alias("l"), F.col("adduct").alias("a")).agg(F.count("*").alias("n"))
    x, y = c.alias("x"), c.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.struct("x.l", "x.a") > F.struct("y.l", "y.a"))).groupBy("x.k").agg(F.count("*").alias("pairs"), F.sum(F.col("x.n") * F.col("y.n")).alias("weight"))


@q("j15_prefix_join", "SELECT r.rid, p.cid FROM train_spectra r JOIN (SELECT ik, min(cid) AS cid FROM pubchem_rows GROUP BY ik) p ON left(r.inchikey, 14) = p.ik")
def _(t):
    p = t.pubchem_rows.groupBy("ik").agg(F.min("cid").alias("cid"))
    return t.train_spectra.select("rid", F.substring("inchikey", 1, 14).alias("ik")).join(p, "ik").select("rid", "cid")


@q("j17_map_lookup", "SELECT r.rid, s.formula FROM train_spectra r LEFT JOIN train_structs s ON s.inchikey14 = r.inchikey14")
def _(t):
    return t.train_spectra.select("rid", "inchikey14").join(t.train_structs.select("inchikey14", "formula"), "inchikey14", "left").select("rid", "formula")


@q("j18_fallback_lookup", """WITH p AS (SELECT ik, CAST(sum(coalesce(n_sid, 0)) AS BIGINT) AS n FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ik)
    SELECT s.sid, CASE WHEN a.ik IS NOT NULL THEN a.n ELSE b.n END AS n, CASE WHEN a.ik IS NOT NULL THEN 'exact' WHEN b.ik IS NOT NULL THEN 'fallback' ELSE 'unknown' END AS how
    FROM train_structs s LEFT JOIN p a ON a.ik = s.inchikey14 LEFT JOIN p b ON b.ik = s.key""")
def _(t):
    p = t.pubchem_rows.where("ik is not null").groupBy("ik").agg(F.sum(F.coalesce("n_sid", F.lit(0))).alias("n"))
    return J.fallback_lookup(t.train_structs.select("sid", "inchikey14", "key"), p, "inchikey14", "key", "ik", ("n",)).select("sid", "n", "how")


@q("j19_member_flag", "SELECT sid, inchikey14 IN (SELECT ik FROM pubchem_rows WHERE ik IS NOT NULL) AS in_pubchem FROM train_structs")
def _(t):
    return J.flag_member(t.train_structs.select("sid", "inchikey14"), t.pubchem_rows.select(F.col("ik").alias("inchikey14")), "inchikey14", "in_pubchem").select("sid", "in_pubchem")


@q("j22_nearest_mass", """WITH c AS (SELECT s.sid, p.cid, p.mass, row_number() OVER (PARTITION BY s.sid ORDER BY round(abs(p.mass - s.mass), 9), p.mass, p.cid) AS rank
    FROM train_structs s JOIN pubchem_rows p ON p.mass BETWEEN s.mass - 0.5 AND s.mass + 0.5 WHERE s.mass > 0 AND p.mass > 0 AND p.ik IS DISTINCT FROM s.inchikey14) SELECT sid, cid, rank FROM c WHERE rank <= 5""")
def _(t):
    s = t.train_structs.where("mass > 0").select("sid", "inchikey14", F.col("mass").alias("m"))
    near = J.tolerance_join(s, t.pubchem_rows.where("mass > 0").select("cid", "ik", "mass"), "m", "mass", da=0.5, width=0.5).where(~F.col("ik").eqNullSafe(F.col("inchikey14")))
    return R.top_k(near, ["sid"], [F.round(F.abs(F.col("mass") - F.col("m")), 9), F.col("mass"), F.col("cid")], 5).select("sid", "cid", "rank")


@q("j23_shift_windows", """WITH d AS (SELECT unnest([14.01565, 15.994915, 18.010565, 162.052825]::DOUBLE[]) AS delta), c AS (SELECT s.sid, d.delta, p.sid AS seed, row_number() OVER (PARTITION BY s.sid, d.delta ORDER BY p.sid) AS rank
    FROM train_structs s, d JOIN train_structs p ON p.mass BETWEEN s.mass - d.delta - 0.002 AND s.mass - d.delta + 0.002 WHERE s.mass > 0) SELECT sid, delta, seed, rank FROM c WHERE rank <= 3""")
def _(t):
    deltas = F.array(*[F.lit(x) for x in (14.01565, 15.994915, 18.010565, 162.052825)])
    w = t.train_structs.where("mass > 0").select("sid", F.col("mass").alias("m"), F.explode(deltas).alias("delta")).select("sid", "delta", (F.col("m") - F.col("delta") - 0.002).alias("lo"), (F.col("m") - F.col("delta") + 0.002).alias("hi"))
    hits = J.range_join(w, t.train_structs.select(F.col("sid").alias("seed"), "mass"), "lo", "hi", "mass", 0.01)
    return R.top_k(hits, ["sid", "delta"], [F.col("seed")], 3).select("sid", "delta", "seed", "rank")


@q("j24_analog_window", """SELECT t.spectrum_id, count(*) AS n FROM test_spectra t JOIN train_spectra r ON r.adduct = t.adduct AND r.precursor_mz BETWEEN t.precursor_mz - 150 AND t.precursor_mz + 150
    WHERE t.precursor_mz > 0 AND NOT isnan(t.precursor_mz) AND NOT isnan(r.precursor_mz) GROUP BY 1""")
def _(t):
    w = finite(t.test_spectra).select("spectrum_id", "adduct", (F.col("precursor_mz") - 150).alias("lo"), (F.col("precursor_mz") + 150).alias("hi"))
    # records of the same adduct and precursor stand once with their number, so a hot molecule adds no pairs
    p = t.train_spectra.groupBy("adduct", F.col("precursor_mz").alias("p")).agg(F.count("*").alias("c"))
    return J.range_join(w, p, "lo", "hi", "p", 150.0, on=("adduct",)).groupBy("spectrum_id").agg(F.sum("c").alias("n"))


# ---- aggregations
@q("a1_global_counts", "SELECT count(*) AS n, count(DISTINCT inchikey14) AS molecules, count(DISTINCT adduct) AS adducts, count(instrument_type) AS instruments FROM train_spectra")
def _(t):
    return t.train_spectra.agg(F.count("*").alias("n"), F.count_distinct("inchikey14").alias("molecules"), F.count_distinct("adduct").alias("adducts"), F.count("instrument_type").alias("instruments"))


@q("a2_grouped_count", "SELECT ingest_lib, count(*) AS n FROM train_spectra GROUP BY 1 ORDER BY n DESC, 1")
def _(t):
    return t.train_spectra.groupBy("ingest_lib").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ingest_lib")


@q("a3_count_of_counts", "SELECT n, count(*) AS molecules FROM (SELECT inchikey14, count(*) AS n FROM train_spectra GROUP BY 1) GROUP BY n")
def _(t):
    return t.train_spectra.groupBy("inchikey14").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("molecules"))


@q("a4_having", "SELECT inchikey14, count(*) AS n, count(DISTINCT ingest_lib) AS libs FROM train_spectra GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT ingest_lib) > 1")
def _(t):
    return t.train_spectra.groupBy("inchikey14").agg(F.count("*").alias("n"), F.count_distinct("ingest_lib").alias("libs")).where("n >= 5 and libs > 1")


@q("a5_summary", "SELECT adduct, min(num_peaks) AS lo, median(num_peaks) AS mid, round(avg(num_peaks), 6) AS mean, max(num_peaks) AS hi FROM train_spectra GROUP BY 1")
def _(t):
    return t.train_spectra.groupBy("adduct").agg(F.min("num_peaks").alias("lo"), F.median("num_peaks").alias("mid"), F.round(F.avg("num_peaks"), 6).alias("mean"), F.max("num_peaks").alias("hi"))


@q("a6_filtered_count", "SELECT ingest_lib, count(*) FILTER (WHERE ionization_mode = 'positive') AS pos, count(*) FILTER (WHERE num_peaks < 10) AS few FROM train_spectra GROUP BY 1")
def _(t):
    return t.train_spectra.groupBy("ingest_lib").agg(F.count_if(F.col("ionization_mode") == "positive").alias("pos"), F.count_if(F.col("num_peaks") < 10).alias("few"))


@q("a7_null_census", "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ("inchikey14", "inchikey", "instrument_type", "precursor_mz", "quality_score", "acquired_at", "base_peak_intensity")) + " FROM train_spectra")
def _(t):
    return t.train_spectra.agg(*[F.sum(F.isnull(c).cast("int")).alias(c) for c in ("inchikey14", "inchikey", "instrument_type", "precursor_mz", "quality_score", "acquired_at", "base_peak_intensity")])


@q("a8_duplicate_census", "SELECT count(*) AS duplicate_groups, CAST(sum(n) AS BIGINT) AS rows_involved, max(n) AS largest FROM (SELECT count(*) AS n FROM train_spectra GROUP BY precursor_mz, ms2_mzs, ms2_normalized_intensities HAVING count(*) > 1)")
def _(t):
    g = t.train_spectra.groupBy(F.xxhash64("precursor_mz", "ms2_mzs", "ms2_normalized_intensities").alias("h"), "precursor_mz").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("duplicate_groups"), F.sum("n").alias("rows_involved"), F.max("n").alias("largest"))


@q("a9_distinct_tuples", "SELECT count(*) AS n FROM (SELECT DISTINCT inchikey14, adduct, instrument_type FROM train_spectra)")
def _(t):
    return t.train_spectra.select("inchikey14", "adduct", "instrument_type").distinct().agg(F.count("*").alias("n"))


@q("a10_arg_best", "SELECT inchikey14, arg_max(rid, struct_pack(a := num_peaks, b := -rid)) AS richest, arg_min(rid, struct_pack(a := num_peaks, b := rid)) AS poorest FROM train_spectra WHERE inchikey14 IS NOT NULL GROUP BY 1")
def _(t):
    return t.train_spectra.where("inchikey14 is not null").groupBy("inchikey14").agg(F.max_by("rid", F.struct("num_peaks", -F.col("rid"))).alias("richest"), F.min_by("rid", F.struct("num_peaks", "rid")).alias("poorest"))


@q("a11_any_value", "SELECT inchikey14, min(molecular_formula) AS formula FROM train_spectra GROUP BY 1 HAVING count(DISTINCT molecular_formula) = 1")
def _(t):
    # which value is taken isn't defined, so those keys come out of which every value is the same
    g = t.train_spectra.groupBy("inchikey14").agg(F.any_value("molecular_formula", True).alias("formula"), F.min("molecular_formula").alias("lo"), F.max("molecular_formula").alias("hi"))
    return g.where("lo = hi").select("inchikey14", "formula")


@q("a12_bool_or", "SELECT inchikey14, bool_or(instrument_type ILIKE '%tims%') AS any_tims, bool_and(num_peaks >= 5) AS all_rich, min(molecular_formula) AS formula FROM train_spectra GROUP BY 1")
def _(t):
    return t.train_spectra.groupBy("inchikey14").agg(F.bool_or(F.col("instrument_type").ilike("%tims%")).alias("any_tims"), F.every(F.col("num_peaks") >= 5).alias("all_rich"), F.min("molecular_formula").alias("formula"))


@q("a13_distinct_lists", "SELECT inchikey14, list_sort(list(DISTINCT ingest_lib)) AS libs FROM train_spectra WHERE inchikey14 IS NOT NULL GROUP BY 1")
def _(t):
    return t.train_spectra.where("inchikey14 is not null").groupBy("inchikey14").agg(F.array_sort(F.collect_set("ingest_lib")).alias("libs"))


@q("a14_rollup", "SELECT coalesce(ionization_mode, 'ALL') AS mode, coalesce(adduct, 'ALL') AS adduct, count(*) AS n FROM train_spectra WHERE ionization_mode IS NOT NULL AND adduct IS NOT NULL GROUP BY ROLLUP (ionization_mode, adduct)")
def _(t):
    r = t.train_spectra.where("ionization_mode is not null and adduct is not null").rollup("ionization_mode", "adduct").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("ionization_mode", F.lit("ALL")).alias("mode"), F.coalesce("adduct", F.lit("ALL")).alias("adduct"), "n")


@q("a15_max_then_sum", """WITH m AS (SELECT inchikey14 AS k, adduct AS a, max(base_peak_intensity) AS s FROM train_spectra WHERE base_peak_intensity IS NOT NULL AND NOT isnan(base_peak_intensity) GROUP BY ALL)
    SELECT k, round(max(s), 4) AS best, round(sum(s), 4) AS total, count(*) AS parts FROM m GROUP BY k""")
def _(t):
    m = t.train_spectra.where("base_peak_intensity is not null and not isnan(base_peak_intensity)").groupBy(F.col("inchikey14").alias("k"), F.col("adduct").alias("a")).agg(F.max("base_peak_intensity").alias("s"))
    return m.groupBy("k").agg(F.round(F.max("s"), 4).alias("best"), F.round(F.sum("s"), 4).alias("total"), F.count("*").alias("parts"))


@q("a16_multi_agg", "SELECT ik, CAST(sum(n_sid) AS BIGINT) AS sids, max(n_pmid) AS pmids, bool_and(trust >= 2) AS trusted, count(*) AS n FROM pubchem_rows GROUP BY ik")
def _(t):
    return t.pubchem_rows.groupBy("ik").agg(F.sum("n_sid").alias("sids"), F.max("n_pmid").alias("pmids"), F.every(F.col("trust") >= 2).alias("trusted"), F.count("*").alias("n"))


@q("a17_median_mass", "SELECT molecule_id, round(median(precursor_mz), 6) AS mid FROM test_spectra WHERE precursor_mz > 0 AND NOT isnan(precursor_mz) GROUP BY 1")
def _(t):
    return finite(t.test_spectra).groupBy("molecule_id").agg(F.round(F.median("precursor_mz"), 6).alias("mid"))


@q("a18_quantiles", """SELECT ingest_lib, round(quantile_cont(num_peaks, 0.25), 6) AS q25, round(quantile_cont(num_peaks, 0.9), 6) AS q90, list_sort(list(num_peaks))[CAST(floor((count(num_peaks) - 1) * 0.9) AS BIGINT) + 1] AS floor90 FROM train_spectra GROUP BY 1""")
def _(t):
    # the floor-index percentile comes from counts of values, so a large group is never collected
    n = t.train_spectra.where("num_peaks is not null").groupBy("ingest_lib", "num_peaks").agg(F.count("*").alias("c"))
    w = Window.partitionBy("ingest_lib")
    run = n.withColumn("upto", F.sum("c").over(w.orderBy("num_peaks"))).withColumn("total", F.sum("c").over(w))
    f90 = run.where(F.col("upto") >= F.floor((F.col("total") - 1) * 0.9) + 1).groupBy("ingest_lib").agg(F.min("num_peaks").alias("floor90"))
    quant = t.train_spectra.groupBy("ingest_lib").agg(F.round(F.percentile("num_peaks", 0.25), 6).alias("q25"), F.round(F.percentile("num_peaks", 0.9), 6).alias("q90"))
    return quant.join(f90, "ingest_lib").select("ingest_lib", "q25", "q90", "floor90")


@q("a19_histogram", "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 16 THEN '5-16' ELSE '17+' END AS bucket, count(*) AS molecules, CAST(sum(n) AS BIGINT) AS records FROM (SELECT inchikey14, count(*) AS n FROM train_spectra GROUP BY 1) GROUP BY 1")
def _(t):
    g = t.train_spectra.groupBy("inchikey14").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") <= 4, "2-4").when(F.col("n") <= 16, "5-16").otherwise("17+")
    return g.groupBy(b.alias("bucket")).agg(F.count("*").alias("molecules"), F.sum("n").alias("records"))


@q("a20_weighted_bincount", "SELECT CAST(floor(mass / 50) AS BIGINT) AS bin, count(*) AS n, CAST(sum(n_spec) AS BIGINT) AS weight FROM train_structs WHERE mass > 0 GROUP BY 1")
def _(t):
    return t.train_structs.where("mass > 0").groupBy(F.floor(F.col("mass") / 50).alias("bin")).agg(F.count("*").alias("n"), F.sum("n_spec").alias("weight"))


@q("a21_segment_reduce", "SELECT rid, round(list_sum(ms2_normalized_intensities), 6) AS total, round(list_min(ms2_mzs), 6) AS lo, round(list_max(ms2_mzs), 6) AS hi FROM train_spectra WHERE len(ms2_mzs) > 0")
def _(t):
    return t.train_spectra.where(F.size("ms2_mzs") > 0).select("rid", F.round(F.aggregate("ms2_normalized_intensities", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_min("ms2_mzs"), 6).alias("lo"), F.round(F.array_max("ms2_mzs"), 6).alias("hi"))


@q("a22_segment_softmax", """WITH s AS (SELECT ik, cid, max(n_sid) AS x FROM pubchem_rows WHERE ik IS NOT NULL AND n_sid IS NOT NULL GROUP BY ALL), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY ik)) AS e FROM s) SELECT ik, cid, round(e / sum(e) OVER (PARTITION BY ik), 6) AS p FROM e""")
def _(t):
    s = t.pubchem_rows.where("ik is not null and n_sid is not null").groupBy("ik", "cid").agg(F.max("n_sid").alias("x"))
    return R.with_softmax(s, "x", ["ik"]).select("ik", "cid", F.round("p", 6).alias("p"))


@q("a23_reasons", """WITH r AS (SELECT ik, CASE WHEN smiles IS NULL THEN 1 WHEN mass IS NULL THEN 2 WHEN trust IS NULL THEN 3 ELSE 9 END AS pri, CASE WHEN smiles IS NULL THEN 'no smiles' WHEN mass IS NULL THEN 'no mass' WHEN trust IS NULL THEN 'no trust' ELSE 'ok' END AS why FROM pubchem_rows WHERE ik IS NOT NULL)
    SELECT ik, string_agg(why, ';' ORDER BY pri) AS reasons FROM (SELECT DISTINCT * FROM r) GROUP BY ik""")
def _(t):
    c = F.when(F.col("smiles").isNull(), F.struct(F.lit(1).alias("pri"), F.lit("no smiles").alias("why"))).when(F.col("mass").isNull(), F.struct(F.lit(2).alias("pri"), F.lit("no mass").alias("why"))).when(F.col("trust").isNull(), F.struct(F.lit(3).alias("pri"), F.lit("no trust").alias("why"))).otherwise(F.struct(F.lit(9).alias("pri"), F.lit("ok").alias("why")))
    return t.pubchem_rows.where("ik is not null").groupBy("ik").agg(F.array_sort(F.collect_set(c)).alias("r")).select("ik", F.concat_ws(";", F.transform("r", lambda x: x.why)).alias("reasons"))


@q("a24_pivot", "SELECT ionization_mode, count(*) FILTER (WHERE adduct = '[M+H]+') AS h, count(*) FILTER (WHERE adduct = '[M+Na]+') AS na, count(*) FILTER (WHERE adduct = '[M-H]-') AS neg FROM train_spectra WHERE adduct IN ('[M+H]+', '[M+Na]+', '[M-H]-') GROUP BY 1")
def _(t):
    p = t.train_spectra.where(F.col("adduct").isin("[M+H]+", "[M+Na]+", "[M-H]-")).groupBy("ionization_mode").pivot("adduct", ["[M+H]+", "[M+Na]+", "[M-H]-"]).agg(F.count(F.lit(1))).na.fill(0)
    return p.toDF("ionization_mode", "h", "na", "neg")


@q("a26_mode_with_tie", "WITH c AS (SELECT inchikey14, adduct, count(*) AS n FROM train_spectra WHERE inchikey14 IS NOT NULL AND adduct IS NOT NULL GROUP BY ALL) SELECT inchikey14, arg_min(adduct, struct_pack(a := -n, b := adduct)) AS adduct FROM c GROUP BY 1")
def _(t):
    c = t.train_spectra.where("inchikey14 is not null and adduct is not null").groupBy("inchikey14", "adduct").agg(F.count("*").alias("n"))
    return c.groupBy("inchikey14").agg(F.min_by("adduct", F.struct(-F.col("n"), "adduct")).alias("adduct"))


@q("a27_distinct_support", "SELECT molecular_formula, count(DISTINCT (inchikey14, adduct)) AS pairs, count(DISTINCT inchikey14) AS molecules FROM train_spectra WHERE inchikey14 IS NOT NULL AND adduct IS NOT NULL GROUP BY 1")
def _(t):
    d = t.train_spectra.where("inchikey14 is not null and adduct is not null").groupBy("molecular_formula", "inchikey14", "adduct").agg(F.lit(1).alias("one"))
    return d.groupBy("molecular_formula").agg(F.count("*").alias("pairs"), F.count_distinct("inchikey14").alias("molecules"))


@q("a28_popularity", "SELECT ik, CAST(sum(n_sid) AS BIGINT) AS n_sid, max(n_pmid) AS n_pmid, count(DISTINCT cid) AS n_cid FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ik")
def _(t):
    return t.pubchem_rows.where("ik is not null").groupBy("ik").agg(F.sum("n_sid").alias("n_sid"), F.max("n_pmid").alias("n_pmid"), F.count_distinct("cid").alias("n_cid"))


@q("a29_alias_closure", """WITH a AS (SELECT inchikey14 AS alias, coalesce(key, inchikey14) AS grp FROM train_structs UNION SELECT inchikey14, inchikey14 FROM train_structs), p AS (SELECT ik, CAST(sum(n_sid) AS BIGINT) AS n FROM pubchem_rows GROUP BY ik),
    g AS (SELECT grp, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM a LEFT JOIN p ON p.ik = a.alias GROUP BY grp) SELECT alias, max(g.n) AS n FROM a JOIN g USING (grp) GROUP BY alias""")
def _(t):
    s = t.train_structs.select(F.col("inchikey14").alias("alias"), F.explode(F.array_distinct(F.array(F.coalesce("key", "inchikey14"), "inchikey14"))).alias("grp"))
    p = t.pubchem_rows.groupBy(F.col("ik").alias("alias")).agg(F.sum("n_sid").alias("n"))
    g = s.join(p, "alias", "left").groupBy("grp").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return s.join(g, "grp").groupBy("alias").agg(F.max("n").alias("n"))


# ---- windows
@q("n2_capped_sample", "SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY inchikey14, ingest_lib ORDER BY md5('s1:' || rid), rid) AS r FROM train_spectra) WHERE r <= 3")
def _(t):
    return R.capped_sample(t.train_spectra.select("rid", "inchikey14", "ingest_lib"), ["inchikey14", "ingest_lib"], "rid", 3, "s1").select("rid")


@q("n3_representative_with_totals", """WITH c AS (SELECT ik, smiles, count(*) AS n FROM pubchem_rows WHERE ik IS NOT NULL AND smiles IS NOT NULL GROUP BY ALL)
    SELECT ik, smiles, total, variants FROM (SELECT *, row_number() OVER (PARTITION BY ik ORDER BY n DESC, smiles) AS r, CAST(sum(n) OVER (PARTITION BY ik) AS BIGINT) AS total, count(*) OVER (PARTITION BY ik) AS variants FROM c) WHERE r = 1""")
def _(t):
    c = t.pubchem_rows.where("ik is not null and smiles is not null").groupBy("ik", "smiles").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ik")
    return c.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "smiles")), "total": F.sum("n").over(w), "variants": F.count("*").over(w)}).where("r = 1").select("ik", "smiles", "total", "variants")


LIST = "SELECT ik AS g, cid, max(coalesce(n_sid, 0)) AS x FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL"


def ranked(t):
    return t.pubchem_rows.where("ik is not null").groupBy(F.col("ik").alias("g"), "cid").agg(F.max(F.coalesce("n_sid", F.lit(0))).alias("x"))


@q("n4_group_rank", f"WITH l AS ({LIST}) SELECT g, cid, row_number() OVER (PARTITION BY g ORDER BY x DESC, cid) AS rank FROM l")
def _(t):
    return ranked(t).select("g", "cid", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), "cid")).cast("bigint").alias("rank"))


@q("n6_rank_share", f"WITH l AS ({LIST}) SELECT g, cid, round((rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0) / count(*) OVER (PARTITION BY g), 6) AS share FROM l")
def _(t):
    return ranked(t).select("g", "cid", F.round(R.rank_share(["g"], [F.col("x")]), 6).alias("share"))


@q("n7_rank01", f"WITH l AS ({LIST}) SELECT g, cid, round((row_number() OVER (PARTITION BY g ORDER BY x DESC, cid) - 1) / greatest(1, count(*) OVER (PARTITION BY g) - 1), 6) AS r01 FROM l")
def _(t):
    return ranked(t).select("g", "cid", F.round(R.rank01(["g"], [F.desc("x"), F.col("cid")]), 6).alias("r01"))


@q("n8_gap_to_best", f"WITH l AS ({LIST}) SELECT g, cid, x - max(x) OVER (PARTITION BY g) AS gap FROM l")
def _(t):
    return ranked(t).select("g", "cid", R.gap_to_best("x", ["g"]).alias("gap"))


@q("n9_zscores", f"""WITH l AS ({LIST}), s AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sp, stddev_samp(x) OVER w AS ss FROM l WINDOW w AS (PARTITION BY g))
    SELECT g, cid, round(CASE WHEN sp <= 1e-9 THEN 0 ELSE (x - m) / sp END, 5) AS za, round(CASE WHEN ss IS NULL THEN 0 ELSE (x - m) / (ss + 1e-6) END, 5) AS zb, round((x - m) / (sp + 1e-9), 5) AS zd FROM s""")
def _(t):
    z = lambda **k: F.round(R.zscore("x", ["g"], **k), 5)
    return ranked(t).select("g", "cid", z(least=1e-9).alias("za"), z(sample=True, add=1e-6).alias("zb"), z(add=1e-9).alias("zd"))


@q("n10_softmax_entropy_margin", f"""WITH l AS ({LIST}), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY g)) AS e, row_number() OVER (PARTITION BY g ORDER BY x DESC, cid) AS r FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY g) AS p FROM e)
    SELECT g, round(abs(sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 5) AS entropy, max(x) FILTER (WHERE r = 1) - max(x) FILTER (WHERE r = 2) AS margin FROM p GROUP BY g""")
def _(t):
    p = R.with_softmax(ranked(t), "x", ["g"]).withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), "cid")))
    return p.groupBy("g").agg(F.round(F.abs(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))), 5).alias("entropy"), (F.max(F.when(F.col("r") == 1, F.col("x"))) - F.max(F.when(F.col("r") == 2, F.col("x")))).alias("margin"))


@q("n11_group_share", "WITH n AS (SELECT inchikey14, adduct, count(*) AS c FROM train_spectra GROUP BY ALL) SELECT inchikey14, adduct, round(c / sum(c) OVER (PARTITION BY inchikey14), 6) AS share, count(*) OVER (PARTITION BY inchikey14) AS kinds FROM n")
def _(t):
    n, w = t.train_spectra.groupBy("inchikey14", "adduct").agg(F.count("*").alias("c")), Window.partitionBy("inchikey14")
    return n.select("inchikey14", "adduct", F.round(F.col("c") / F.sum("c").over(w), 6).alias("share"), F.count("*").over(w).alias("kinds"))


@q("n12_group_flag", "SELECT s.sid FROM train_structs s JOIN (SELECT formula FROM train_structs GROUP BY formula HAVING max(CASE WHEN charged THEN 1 ELSE 0 END) = 0 AND count(*) > 1) f USING (formula)")
def _(t):
    w = Window.partitionBy("formula")
    return t.train_structs.where("formula is not null").select("sid", F.max(F.col("charged").cast("int")).over(w).alias("any"), F.count("*").over(w).alias("n")).where("coalesce(any, 0) = 0 and n > 1").select("sid")


@q("n13_run_starts", "SELECT cid, ik FROM (SELECT cid, ik, lag(ik) OVER (PARTITION BY depositor ORDER BY cid, updated_at, ik, mass, smiles) AS prev, depositor FROM (SELECT DISTINCT cid, ik, depositor, updated_at, mass, smiles FROM pubchem_rows)) WHERE prev IS NOT NULL AND ik <> prev")
def _(t):
    w = Window.partitionBy("depositor").orderBy(F.col("cid").asc_nulls_last(), F.col("updated_at").asc_nulls_last(), F.col("ik").asc_nulls_last(), F.col("mass").asc_nulls_last(), F.col("smiles").asc_nulls_last())
    return t.pubchem_rows.select("cid", "ik", "depositor", "updated_at", "mass", "smiles").distinct().withColumn("prev", F.lag("ik").over(w)).where("prev is not null and ik <> prev").select("cid", "ik")


@q("n15_quartiles", """WITH b AS (SELECT quantile_cont(mass, 0.25) AS a, quantile_cont(mass, 0.5) AS b, quantile_cont(mass, 0.75) AS c FROM train_structs WHERE mass > 0) SELECT sid, CASE WHEN mass <= a THEN 0 WHEN mass <= b THEN 1 WHEN mass <= c THEN 2 ELSE 3 END AS quartile FROM train_structs, b WHERE mass > 0""")
def _(t):
    s = t.train_structs.where("mass > 0")
    a, b, c = s.agg(F.percentile("mass", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).first()[0] or (0.0, 0.0, 0.0)  # three numbers
    m = F.col("mass")
    return s.select("sid", F.when(m <= a, 0).when(m <= b, 1).when(m <= c, 2).otherwise(3).alias("quartile"))


@q("n16_fixed_bins", "SELECT CASE WHEN mass < 250 THEN '<250' WHEN mass < 500 THEN '250-500' WHEN mass < 750 THEN '500-750' ELSE '750+' END AS bin, count(*) AS n FROM train_structs WHERE mass IS NOT NULL GROUP BY 1")
def _(t):
    m = F.col("mass")
    return t.train_structs.where(m.isNotNull()).groupBy(F.when(m < 250, "<250").when(m < 500, "250-500").when(m < 750, "500-750").otherwise("750+").alias("bin")).agg(F.count("*").alias("n"))


@q("n17_frames", """SELECT sid, formula, lead(sid) OVER w AS next_sid, round(cume_dist() OVER (PARTITION BY formula ORDER BY mass), 6) AS share_below,
        count(*) OVER (PARTITION BY formula ORDER BY mass RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING) AS within_one, round(avg(n_heavy) OVER (PARTITION BY formula ORDER BY sid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS running
    FROM train_structs WHERE mass IS NOT NULL AND formula IS NOT NULL WINDOW w AS (PARTITION BY formula ORDER BY sid)""")
def _(t):
    by = Window.partitionBy("formula")
    s = t.train_structs.where("mass is not null and formula is not null")
    return s.select(
        "sid", "formula", F.lead("sid").over(by.orderBy("sid")).alias("next_sid"), F.round(F.cume_dist().over(by.orderBy("mass")), 6).alias("share_below"),
        F.expr("count(*) OVER (PARTITION BY formula ORDER BY mass RANGE BETWEEN 1D PRECEDING AND 1D FOLLOWING)").alias("within_one"), F.round(F.avg("n_heavy").over(by.orderBy("sid").rowsBetween(-2, 0)), 6).alias("running"),
    )


# ---- sort, top-k, dedup, sampling
@q("t1_order_limit", "SELECT rid, num_peaks FROM train_spectra ORDER BY num_peaks DESC, rid LIMIT 10")
def _(t):
    return t.train_spectra.select("rid", "num_peaks").orderBy(F.desc("num_peaks"), "rid").limit(10)


@q("t3_group_head", "SELECT ingest_lib, rid FROM (SELECT ingest_lib, rid, row_number() OVER (PARTITION BY ingest_lib ORDER BY num_peaks DESC, rid) AS r FROM train_spectra) WHERE r <= 5")
def _(t):
    return R.top_k(t.train_spectra.select("ingest_lib", "rid", "num_peaks"), ["ingest_lib"], [F.desc("num_peaks"), F.col("rid")], 5).select("ingest_lib", "rid")


@q("t14_shuffled_head", "SELECT inchikey14, rid FROM (SELECT inchikey14, rid, row_number() OVER (PARTITION BY inchikey14 ORDER BY md5('s:' || rid), rid) AS r FROM train_spectra WHERE inchikey14 IS NOT NULL) WHERE r <= 4")
def _(t):
    return R.capped_sample(t.train_spectra.where("inchikey14 is not null").select("inchikey14", "rid"), ["inchikey14"], "rid", 4, "s").select("inchikey14", "rid")


@q("t6_priority_dedup", "SELECT inchikey14, rid FROM (SELECT inchikey14, rid, row_number() OVER (PARTITION BY inchikey14 ORDER BY CASE WHEN instrument_type ILIKE '%tims%' THEN 0 ELSE 1 END, num_peaks DESC, rid) AS r FROM train_spectra WHERE inchikey14 IS NOT NULL) WHERE r = 1")
def _(t):
    tims = F.when(F.col("instrument_type").ilike("%tims%"), 0).otherwise(1)
    return R.first_by(t.train_spectra.where("inchikey14 is not null").select("inchikey14", "rid", "instrument_type", "num_peaks"), ["inchikey14"], [tims, F.desc("num_peaks"), F.col("rid")]).select("inchikey14", "rid")


@q("t7_list_dedup", f"WITH l AS (SELECT depositor, ik, row_number() OVER (PARTITION BY depositor ORDER BY n_sid DESC NULLS LAST, cid, ik NULLS LAST, mass NULLS LAST, smiles NULLS LAST) AS r FROM pubchem_rows), b AS (SELECT depositor, ik, min(r) AS r FROM l WHERE ik IS NOT NULL GROUP BY ALL) SELECT depositor, ik, rank FROM (SELECT depositor, ik, row_number() OVER (PARTITION BY depositor ORDER BY r) AS rank FROM b) WHERE rank <= 25")
def _(t):
    w = Window.partitionBy("depositor").orderBy(F.col("n_sid").desc_nulls_last(), "cid", F.col("ik").asc_nulls_last(), F.col("mass").asc_nulls_last(), F.col("smiles").asc_nulls_last())
    return R.list_dedup(t.pubchem_rows.withColumn("r", F.row_number().over(w)).where("ik is not null"), ["depositor"], "ik", "r", 25).withColumnRenamed("r", "rank")


@q("t8_provenance_merge", """WITH u AS (SELECT inchikey14 AS k, 'train' AS src, 0 AS pri FROM train_structs UNION ALL SELECT ik, 'pubchem', 1 FROM pubchem_rows WHERE ik IS NOT NULL)
    SELECT k, string_agg(src, '+' ORDER BY pri) AS srcs FROM (SELECT DISTINCT * FROM u) GROUP BY k""")
def _(t):
    u = t.train_structs.select(F.col("inchikey14").alias("k"), F.lit("train").alias("src"), F.lit(0).alias("pri")).unionByName(t.pubchem_rows.where("ik is not null").select(F.col("ik").alias("k"), F.lit("pubchem").alias("src"), F.lit(1).alias("pri")))
    return u.groupBy("k").agg(F.concat_ws("+", F.transform(F.array_sort(F.collect_set(F.struct("pri", "src"))), lambda x: x.src)).alias("srcs"))


@q("t9_cap_by_popularity", "SELECT ik, cid FROM (SELECT ik, cid, row_number() OVER (PARTITION BY ik ORDER BY n DESC, cid) AS r FROM (SELECT ik, cid, CAST(sum(coalesce(n_sid, 0)) AS BIGINT) AS n FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL)) WHERE r <= 4")
def _(t):
    p = t.pubchem_rows.where("ik is not null").groupBy("ik", "cid").agg(F.sum(F.coalesce("n_sid", F.lit(0))).alias("n"))
    return R.top_k(p, ["ik"], [F.desc("n"), F.col("cid")], 4).select("ik", "cid")


@q("t10_seeded_sample", "SELECT rid FROM train_spectra ORDER BY md5('42:' || rid), rid LIMIT 100")
def _(t):
    return t.train_spectra.select("rid").orderBy(R.hash_order("rid", "42"), "rid").limit(100)


@q("t12_stratified_sample", "SELECT adduct, rid FROM (SELECT adduct, rid, row_number() OVER (PARTITION BY adduct ORDER BY md5('st:' || rid), rid) AS r FROM train_spectra) WHERE r <= 20")
def _(t):
    return R.capped_sample(t.train_spectra.select("adduct", "rid"), ["adduct"], "rid", 20, "st").select("adduct", "rid")


@q("t16_hash_split", """SELECT sid, CASE WHEN CAST(('0x' || substr(md5('v1' || inchikey14), 1, 12)) AS BIGINT) / pow(16, 12) < 0.1 * CASE WHEN n_spec > 5 THEN 2 ELSE 1 END THEN 'held' ELSE 'train' END AS part, CAST(('0x' || substr(md5(inchikey14), 1, 12)) AS BIGINT) % 5 AS fold FROM train_structs""")
def _(t):
    rate = 0.1 * F.when(F.col("n_spec") > 5, 2).otherwise(1)
    return t.train_structs.select("sid", F.when(R.unit_hash("inchikey14", "v1") < rate, "held").otherwise("train").alias("part"), R.fold("inchikey14", 5).alias("fold"))


@q("t18_negatives_in_window", """WITH c AS (SELECT s.sid, d.sid AS decoy, d.formula = s.formula AS same, md5('neg:' || d.sid) AS h FROM train_structs s JOIN train_structs d ON d.mass BETWEEN s.mass - 1.0 AND s.mass + 1.0 AND d.sid <> s.sid WHERE s.mass > 0)
    SELECT sid, decoy, rank FROM (SELECT sid, decoy, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN same THEN 0 ELSE 1 END, h, decoy) AS rank FROM c) WHERE rank <= 6""")
def _(t):
    s = t.train_structs.where("mass > 0").select("sid", F.col("formula").alias("f"), F.col("mass").alias("m"))
    c = J.tolerance_join(s, t.train_structs.select(F.col("sid").alias("decoy"), "formula", "mass"), "m", "mass", da=1.0, width=1.0).where("decoy <> sid")
    return R.top_k(c, ["sid"], [F.when(F.col("formula") == F.col("f"), 0).otherwise(1), R.hash_order("decoy", "neg"), F.col("decoy")], 6).select("sid", "decoy", "rank")


@q("t19_balanced_groups", "SELECT inchikey14, ionization_mode, rid FROM (SELECT inchikey14, ionization_mode, rid, row_number() OVER (PARTITION BY inchikey14, ionization_mode ORDER BY md5('b:' || rid), rid) AS r FROM train_spectra WHERE inchikey14 IS NOT NULL) WHERE r <= 2")
def _(t):
    return R.capped_sample(t.train_spectra.where("inchikey14 is not null").select("inchikey14", "ionization_mode", "rid"), ["inchikey14", "ionization_mode"], "rid", 2, "b")


# ---- sets
@q("u1_union_all", "SELECT src, count(*) AS n FROM (SELECT 'train' AS src, precursor_mz FROM train_spectra UNION ALL SELECT 'test', precursor_mz FROM test_spectra) GROUP BY src")
def _(t):
    a = t.train_spectra.select(F.lit("train").alias("src"), "precursor_mz").unionByName(t.test_spectra.select(F.lit("test").alias("src"), "precursor_mz"))
    return a.groupBy("src").agg(F.count("*").alias("n"))


@q("u3_left_priority_union", "SELECT inchikey14 AS k, 'train' AS src FROM train_structs UNION ALL SELECT DISTINCT ik, 'pubchem' FROM pubchem_rows WHERE ik IS NOT NULL AND ik NOT IN (SELECT inchikey14 FROM train_structs)")
def _(t):
    return J.union_with_priority(t.train_structs.select(F.col("inchikey14").alias("k"), F.lit("train").alias("src")), t.pubchem_rows.where("ik is not null").select(F.col("ik").alias("k"), F.lit("pubchem").alias("src")).distinct(), "k")


@q("u4_set_algebra", """SELECT 'both' AS part, count(*) AS n FROM (SELECT inchikey14 FROM train_structs INTERSECT SELECT ik FROM pubchem_rows) UNION ALL SELECT 'only train', count(*) FROM (SELECT inchikey14 FROM train_structs EXCEPT SELECT ik FROM pubchem_rows)
    UNION ALL SELECT 'either', count(*) FROM (SELECT inchikey14 FROM train_structs UNION SELECT ik FROM pubchem_rows)""")
def _(t):
    a, b = t.train_structs.select(F.col("inchikey14").alias("k")), t.pubchem_rows.select(F.col("ik").alias("k"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only train")).union(n(a.union(b).distinct(), "either"))


@q("u5_set_equality", "SELECT (SELECT count(*) FROM (SELECT inchikey14 FROM train_structs EXCEPT SELECT inchikey14 FROM train_spectra)) = 0 AND (SELECT count(*) FROM (SELECT inchikey14 FROM train_spectra EXCEPT SELECT inchikey14 FROM train_structs)) = 0 AS same")
def _(t):
    a, b = t.train_structs.select("inchikey14"), t.train_spectra.select("inchikey14")
    return a.subtract(b).union(b.subtract(a)).agg((F.count("*") == 0).alias("same"))


@q("u6_aliases", """SELECT DISTINCT a.sid, b.sid AS alias FROM train_structs a JOIN train_structs b ON a.sid <> b.sid AND ((a.formula = b.formula AND b.mass BETWEEN a.mass - 0.002 AND a.mass + 0.002) OR coalesce(a.key, a.inchikey14) = coalesce(b.key, b.inchikey14))""")
def _(t):
    s = t.train_structs.select("sid", "formula", "mass", F.coalesce("key", "inchikey14").alias("k"))
    o = s.select(*[F.col(c).alias(f"o_{c}") for c in s.columns])
    near = J.tolerance_join(s.where("mass is not null").withColumnRenamed("mass", "m"), t.train_structs.select(F.col("sid").alias("alias"), "formula", "mass"), "m", "mass", da=0.002, on=("formula",), width=0.01).select("sid", "alias")
    same = s.join(o, F.col("k") == F.col("o_k")).select("sid", F.col("o_sid").alias("alias"))
    return near.union(same).where("sid <> alias").distinct()


@q("u7_group_closure", "SELECT formula FROM train_structs WHERE formula IS NOT NULL GROUP BY formula HAVING bool_and(n_spec = 0) AND bool_or(ok)")
def _(t):
    return t.train_structs.where("formula is not null").groupBy("formula").agg(F.every(F.col("n_spec") == 0).alias("all"), F.some(F.col("ok")).alias("any")).where("all and any").select("formula")


queries, oracle_sql = q.queries, q.oracle_sql
