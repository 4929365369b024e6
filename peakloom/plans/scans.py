"""Scans, projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.plans.registry import Registry

q = Registry()


@q("s3_projected_scan", "SELECT rid, adduct, precursor_mz FROM train_spectra WHERE adduct = '[M+H]+' AND precursor_mz BETWEEN 100 AND 300")
def _(t):
    return t.train_spectra.select("rid", "adduct", "precursor_mz").where((F.col("adduct") == "[M+H]+") & F.col("precursor_mz").between(100, 300))


@q("s3_limited_scan", "SELECT spectrum_id, qset FROM test_spectra WHERE ionization_mode IS NOT NULL ORDER BY spectrum_id LIMIT 50")
def _(t):
    return t.test_spectra.where("ionization_mode is not null").select("spectrum_id", "qset").orderBy("spectrum_id").limit(50)


@q("s6_content_key", "SELECT cid, md5(concat_ws('|', coalesce(ik, ''), cid, coalesce(smiles, ''))) AS content_key FROM pubchem_rows")
def _(t):
    return t.pubchem_rows.select("cid", F.md5(F.concat_ws("|", F.coalesce("ik", F.lit("")), F.col("cid").cast("string"), F.coalesce("smiles", F.lit("")))).alias("content_key"))


@q("s16_point_lookup", "SELECT rid, ingest_lib, num_peaks FROM train_spectra WHERE rid IN (SELECT sid FROM train_structs WHERE n_heavy > 40)")
def _(t):
    want = t.train_structs.where("n_heavy > 40").select(F.col("sid").alias("rid"))
    return t.train_spectra.select("rid", "ingest_lib", "num_peaks").join(want, "rid", "left_semi")


@q("s19_parameterised_scan", "SELECT sid, mass FROM train_structs WHERE mass BETWEEN 200 AND 400 AND n_heavy >= 15")
def _(t):
    t.train_structs.createOrReplaceTempView("structs_in")
    return t.spark.sql("SELECT sid, mass FROM structs_in WHERE mass BETWEEN :lo AND :hi AND n_heavy >= :heavy", args={"lo": 200.0, "hi": 400.0, "heavy": 15})


@q("f3_scalar_window", """SELECT rid, precursor_mz FROM train_spectra WHERE NOT isnan(precursor_mz) AND precursor_mz BETWEEN
    (SELECT min(precursor_mz) - 0.01 FROM test_spectra WHERE qset = 'public' AND precursor_mz > 100) AND (SELECT max(precursor_mz) + 0.01 FROM test_spectra WHERE qset = 'public' AND precursor_mz < 700)""")
def _(t):
    t.train_spectra.createOrReplaceTempView("f3_train")
    t.test_spectra.createOrReplaceTempView("f3_test")
    return t.spark.sql("""SELECT rid, precursor_mz FROM f3_train WHERE NOT isnan(precursor_mz) AND precursor_mz BETWEEN
        (SELECT min(precursor_mz) - 0.01D FROM f3_test WHERE qset = 'public' AND precursor_mz > 100) AND (SELECT max(precursor_mz) + 0.01D FROM f3_test WHERE qset = 'public' AND precursor_mz < 700)""")


@q("f4_in_list", "SELECT adduct, count(*) AS n FROM train_spectra WHERE adduct IN ('[M+H]+', '[M-H]-', '[M+Na]+') GROUP BY adduct")
def _(t):
    return t.train_spectra.where(F.col("adduct").isin("[M+H]+", "[M-H]-", "[M+Na]+")).groupBy("adduct").agg(F.count("*").alias("n"))


@q("f5_in_not_in", """SELECT inchikey14, smiles FROM train_structs WHERE inchikey14 IN (SELECT ik FROM pubchem_rows WHERE trust >= 3)
    AND inchikey14 NOT IN (SELECT key FROM train_structs WHERE key IS NOT NULL AND key <> inchikey14)""")
def _(t):
    s = t.train_structs
    led = s.where("key is not null and key <> inchikey14").select(F.col("key").alias("inchikey14"))
    return s.select("inchikey14", "smiles").join(t.pubchem_rows.where("trust >= 3").select(F.col("ik").alias("inchikey14")), "inchikey14", "left_semi").join(led, "inchikey14", "left_anti")


@q("f6_not_exists_lists", """SELECT spectrum_id FROM test_spectra t WHERE NOT EXISTS (SELECT 1 FROM train_spectra r WHERE r.precursor_mz = t.precursor_mz
    AND r.ms2_mzs = t.ms2_mzs AND r.ms2_normalized_intensities = t.ms2_normalized_intensities)""")
def _(t):
    return t.test_spectra.join(t.train_spectra.select("precursor_mz", "ms2_mzs", "ms2_normalized_intensities"), ["precursor_mz", "ms2_mzs", "ms2_normalized_intensities"], "left_anti").select("spectrum_id")


@q("f7_distinct_from", "SELECT rid FROM train_spectra WHERE adduct IS DISTINCT FROM adduct_orig")
def _(t):
    return t.train_spectra.where(~F.col("adduct").eqNullSafe(F.col("adduct_orig"))).select("rid")


@q("f8_ilike", "SELECT rid, instrument_type FROM train_spectra WHERE instrument_type ILIKE '%tims%'")
def _(t):
    return t.train_spectra.where(F.col("instrument_type").ilike("%tims%")).select("rid", "instrument_type")


@q("f9_not_like", "SELECT adduct, count(*) AS n FROM train_spectra WHERE adduct NOT LIKE '[M-%' GROUP BY adduct")
def _(t):
    return t.train_spectra.where(~F.col("adduct").like("[M-%")).groupBy("adduct").agg(F.count("*").alias("n"))


@q("f10_list_contains", "SELECT inchikey14, len(libs) AS n_libs FROM (SELECT inchikey14, list(DISTINCT ingest_lib) AS libs FROM train_spectra WHERE inchikey14 IS NOT NULL GROUP BY inchikey14) WHERE list_contains(libs, 'nordspec')")
def _(t):
    g = t.train_spectra.where("inchikey14 is not null").groupBy("inchikey14").agg(F.collect_set("ingest_lib").alias("libs"))
    return g.where(F.array_contains("libs", "nordspec")).select("inchikey14", F.size("libs").cast("bigint").alias("n_libs"))


@q("f11_case_when", "SELECT CASE WHEN num_peaks < 10 THEN 'few' WHEN num_peaks < 50 THEN 'some' ELSE 'many' END AS size_class, count(*) AS n FROM train_spectra GROUP BY 1")
def _(t):
    return t.train_spectra.groupBy(F.when(F.col("num_peaks") < 10, "few").when(F.col("num_peaks") < 50, "some").otherwise("many").alias("size_class")).agg(F.count("*").alias("n"))


@q("f12_source_tag", "SELECT 'r' || rid AS rec, 'train' AS src FROM train_spectra UNION ALL SELECT 'q' || spectrum_id, 'test' FROM test_spectra")
def _(t):
    a = t.train_spectra.select(F.concat(F.lit("r"), F.col("rid").cast("string")).alias("rec"), F.lit("train").alias("src"))
    return a.unionByName(t.test_spectra.select(F.concat(F.lit("q"), "spectrum_id").alias("rec"), F.lit("test").alias("src")))


@q("f13_tuple_order", "SELECT count(*) AS n FROM train_spectra WHERE (coalesce(ingest_lib, ''), coalesce(instrument_type, ''), coalesce(adduct, '')) > ('nordspec', 'Orbitrap', '[M+H]+')")
def _(t):
    full = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("ingest_lib", "instrument_type", "adduct")])
    return t.train_spectra.where(full > F.struct(F.lit("nordspec"), F.lit("Orbitrap"), F.lit("[M+H]+"))).agg(F.count("*").alias("n"))


@q("f14_validity_reason", """SELECT CASE WHEN precursor_mz IS NULL OR isnan(precursor_mz) THEN 'no precursor' WHEN precursor_mz <= 0 THEN 'impossible precursor'
    WHEN len(ms2_mzs) = 0 THEN 'empty' WHEN len(ms2_mzs) <> len(ms2_normalized_intensities) THEN 'lengths differ'
    WHEN len(list_filter(ms2_mzs, lambda x: isnan(x) OR x <= 0)) > 0 THEN 'bad peak' ELSE 'ok' END AS reason, count(*) AS n FROM train_spectra GROUP BY 1""")
def _(t):
    p = F.col("precursor_mz")
    reason = (
        F.when(p.isNull() | F.isnan(p), "no precursor").when(p <= 0, "impossible precursor").when(F.size("ms2_mzs") == 0, "empty")
        .when(F.size("ms2_mzs") != F.size("ms2_normalized_intensities"), "lengths differ").when(F.exists("ms2_mzs", lambda x: F.isnan(x) | (x <= 0)), "bad peak").otherwise("ok")
    )
    return t.train_spectra.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@q("f15_adduct_guard", "SELECT spectrum_id FROM test_spectra WHERE precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND adduct IN ('[M+H]+', '[M+Na]+', '[M-H]-')")
def _(t):
    return t.test_spectra.where(F.col("precursor_mz").isNotNull() & ~F.isnan("precursor_mz") & F.col("adduct").isin("[M+H]+", "[M+Na]+", "[M-H]-")).select("spectrum_id")


@q("f16_structure_text", """SELECT cid FROM pubchem_rows WHERE length(smiles) BETWEEN 3 AND 200 AND NOT contains(smiles, '.') AND regexp_matches(smiles, '^[A-Za-z0-9@+\\-\\[\\]()=#/\\\\]+$')
    AND len(list_filter(regexp_extract_all(smiles, '\\[[^\\]]*\\]'), lambda x: x NOT IN ('[nH]', '[C@H]', '[C@@H]', '[O-]', '[N+]'))) = 0""")
def _(t):
    s = F.col("smiles")
    odd = F.filter(F.regexp_extract_all(s, F.lit(r"(\[[^\]]*\])"), F.lit(1)), lambda x: ~x.isin("[nH]", "[C@H]", "[C@@H]", "[O-]", "[N+]"))
    return t.pubchem_rows.where(F.length(s).between(3, 200) & ~s.contains(".") & s.rlike(r"^[A-Za-z0-9@+\-\[\]()=#/\\]+$") & (F.size(odd) == 0)).select("cid")


@q("f17_reason_counters", """SELECT CASE WHEN smiles IS NULL OR trim(smiles) = '' THEN 'no text' WHEN contains(smiles, '.') THEN 'salt' WHEN mass IS NULL OR isnan(mass) OR mass <= 0 THEN 'no mass'
    WHEN mass > 900 THEN 'heavy' ELSE 'kept' END AS reason, count(*) AS n FROM pubchem_rows GROUP BY 1""")
def _(t):
    m = F.col("mass")
    reason = F.when(F.col("smiles").isNull() | (F.trim("smiles") == ""), "no text").when(F.col("smiles").contains("."), "salt").when(m.isNull() | F.isnan(m) | (m <= 0), "no mass").when(m > 900, "heavy").otherwise("kept")
    return t.pubchem_rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@q("x_math", """SELECT sid, CAST(floor(mass * 1000) AS BIGINT) AS milli, round(sqrt(mass), 6) AS root, round(ln(1 + n_spec), 6) AS l1p, round(log2(n_heavy + 1), 6) AS l2, round(log10(mass), 6) AS l10,
    round(pow(mass, 0.25), 6) AS quarter, round(exp(-mass / 500), 6) AS decay, greatest(n_heavy, n_spec) AS most, least(n_heavy, n_spec) AS fewest FROM train_structs WHERE mass > 0""")
def _(t):
    m = F.col("mass")
    return t.train_structs.where(m > 0).select("sid", F.floor(m * 1000).alias("milli"), F.round(F.sqrt(m), 6).alias("root"), F.round(F.log1p("n_spec"), 6).alias("l1p"), F.round(F.log2(F.col("n_heavy") + 1), 6).alias("l2"), F.round(F.log10(m), 6).alias("l10"), F.round(F.pow(m, 0.25), 6).alias("quarter"), F.round(F.exp(-m / 500), 6).alias("decay"), F.greatest("n_heavy", "n_spec").alias("most"), F.least("n_heavy", "n_spec").alias("fewest"))


@q("x_logit", "SELECT rid, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-quality_score)), 6) AS sigmoid FROM (SELECT rid, quality_score, least(greatest(quality_score, 0.01), 0.99) AS p FROM train_spectra WHERE NOT isnan(quality_score) AND quality_score BETWEEN 0 AND 1)")
def _(t):
    p = F.least(F.greatest(F.col("quality_score"), F.lit(0.01)), F.lit(0.99))
    return t.train_spectra.where("quality_score between 0 and 1").select("rid", F.round(F.ln(p / (1 - p)), 6).alias("logit"), F.round(1 / (1 + F.exp(-F.col("quality_score"))), 6).alias("sigmoid"))


@q("x_try_cast", "SELECT rid, TRY_CAST(regexp_extract(collision_energy_orig, '[0-9.]+') AS DOUBLE) AS energy FROM train_spectra WHERE collision_energy_orig IS NOT NULL")
def _(t):
    return t.train_spectra.where("collision_energy_orig is not null").select("rid", F.expr("try_cast(regexp_extract(collision_energy_orig, '[0-9.]+', 0) as double)").alias("energy"))


@q("x_strings", """SELECT sid, left(inchikey14, 4) AS head, inchikey14 || '/' || formula AS tag, lower(replace(formula, 'H', 'h')) AS low, contains(smiles, 'C(=O)') AS carbonyl, list_aggregate(string_split(smiles, '('), 'count') AS parts
    FROM train_structs WHERE smiles IS NOT NULL AND formula IS NOT NULL""")
def _(t):
    return t.train_structs.where("smiles is not null and formula is not null").select("sid", F.left("inchikey14", F.lit(4)).alias("head"), F.concat("inchikey14", F.lit("/"), "formula").alias("tag"), F.lower(F.replace("formula", F.lit("H"), F.lit("h"))).alias("low"), F.col("smiles").contains("C(=O)").alias("carbonyl"), F.size(F.split("smiles", r"\(")).cast("bigint").alias("parts"))


@q("x_instrument_family", """SELECT CASE WHEN s LIKE '%tims%' THEN 'tims' WHEN s LIKE '%orbi%' OR s LIKE '%itft%' OR s LIKE '%qft%' OR s LIKE '%hybrid ft%' THEN 'orbi' WHEN s LIKE '%tof%' THEN 'tof' WHEN s LIKE '%trap%' THEN 'trap' ELSE 'other' END AS family, count(*) AS n
    FROM (SELECT lower(coalesce(instrument_type, '')) AS s FROM train_spectra) GROUP BY 1""")
def _(t):
    s = F.lower(F.coalesce("instrument_type", F.lit("")))
    has = lambda *xs: F.greatest(*[s.contains(x) for x in xs], F.lit(False))
    family = F.when(has("tims"), "tims").when(has("orbi", "itft", "qft", "hybrid ft"), "orbi").when(has("tof"), "tof").when(has("trap"), "trap").otherwise("other")
    return t.train_spectra.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@q("x_hashes", "SELECT sid, md5(inchikey14) AS m, sha256(inchikey14) AS s, CAST(('0x' || substr(md5(inchikey14), 1, 8)) AS BIGINT) % 5 AS fold FROM train_structs")
def _(t):
    return t.train_structs.select("sid", F.md5("inchikey14").alias("m"), F.sha2("inchikey14", 256).alias("s"), (F.conv(F.substring(F.md5("inchikey14"), 1, 8), 16, 10).cast("bigint") % 5).alias("fold"))


@q("x_arrays", """SELECT rid, len(ms2_mzs) AS n, round(list_max(ms2_mzs), 6) AS top, len(list_filter(ms2_normalized_intensities, lambda x: x >= 0.1)) AS strong, len(list_distinct(list_transform(ms2_mzs, lambda x: CAST(floor(x) AS BIGINT)))) AS cells,
    round(list_avg(list_transform(collision_energy_ev, lambda x: abs(x))), 6) AS energy FROM train_spectra""")
def _(t):
    e = F.filter("collision_energy_ev", lambda x: x.isNotNull())
    return t.train_spectra.select("rid", F.size("ms2_mzs").cast("bigint").alias("n"), F.round(F.array_max("ms2_mzs"), 6).alias("top"), F.size(F.filter("ms2_normalized_intensities", lambda x: x >= 0.1)).cast("bigint").alias("strong"), F.size(F.array_distinct(F.transform("ms2_mzs", lambda x: F.floor(x)))).cast("bigint").alias("cells"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size(e), F.lit(0)), 6).alias("energy"))


@q("x_unnest_peaks", "SELECT adduct, count(*) AS n_peaks, round(max(mz), 6) AS top FROM (SELECT adduct, unnest(ms2_mzs) AS mz FROM train_spectra) GROUP BY adduct")
def _(t):
    return t.train_spectra.select("adduct", F.explode("ms2_mzs").alias("mz")).groupBy("adduct").agg(F.count("*").alias("n_peaks"), F.round(F.max("mz"), 6).alias("top"))


@q("x_bits", "SELECT sid, bit_count(('0x' || substr(md5(inchikey14), 1, 15))::BIGINT) AS ones, xor(n_spec, CAST(n_heavy AS BIGINT)) AS mixed, n_spec & 7 AS low FROM train_structs")
def _(t):
    return t.train_structs.select("sid", F.bit_count(F.conv(F.substring(F.md5("inchikey14"), 1, 15), 16, 10).cast("bigint")).cast("bigint").alias("ones"), F.col("n_spec").bitwiseXOR(F.col("n_heavy").cast("bigint")).alias("mixed"), F.col("n_spec").bitwiseAND(7).alias("low"))


@q("x_energy_missing", "SELECT CASE WHEN collision_energy_ev IS NULL OR len(collision_energy_ev) = 0 THEN 'unknown' ELSE 'known' END AS energy, coalesce(collision_energy_orig_units, 'none') AS units, count(*) AS n FROM train_spectra GROUP BY 1, 2")
def _(t):
    return t.train_spectra.groupBy(F.when(F.col("collision_energy_ev").isNull() | (F.size("collision_energy_ev") == 0), "unknown").otherwise("known").alias("energy"), F.coalesce("collision_energy_orig_units", F.lit("none")).alias("units")).agg(F.count("*").alias("n"))


queries, oracle_sql = q.queries, q.oracle_sql
