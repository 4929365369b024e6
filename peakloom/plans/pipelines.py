"""Staged pipelines: masks, censuses, query building, learned ranking, streams as batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.functions import spectra as S
from peakloom.operators import joins as J
from peakloom.operators import learning as L
from peakloom.operators import ranking as R
from peakloom.plans.lists import cands, truth
from peakloom.plans.registry import Registry
from peakloom.streaming import events as E

q = Registry()


@q("m2_mean_views", "WITH l AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS i, round(avg(x::DOUBLE), 5) AS x FROM l GROUP BY label, i")
def _(t):
    m = L.mean_views(t.embeddings.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v")), "label", "v")
    return m.select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


@q("m3_learned_ranking")
def _(t):
    c = cands(t).select("mid", "key", F.col("a").cast("double").alias("a"), F.coalesce("b", F.lit(0)).cast("double").alias("b"))
    y = J.flag_member(c.withColumn("pair", F.concat_ws("/", "mid", "key")), truth(t).select(F.concat_ws("/", "mid", "key").alias("pair")), "pair", "label").withColumn("label", F.col("label").cast("double"))
    s = L.ranker_scores(y.withColumn("fold", R.fold("mid", 2)), ["a", "b"], "label", "fold", 2)
    return R.top_k(s.withColumn("score", F.round("score", 6)).select("mid", "key", "score"), ["mid"], [F.desc("score"), F.col("key")], 5)


@q("m7_pad_lists", "SELECT rid, list_resize(ms2_mzs, 128, 0.0) AS mz, least(len(ms2_mzs), 128) AS filled FROM train_spectra WHERE ms2_mzs IS NOT NULL")
def _(t):
    p = L.pad_lists(t.train_spectra.where("ms2_mzs is not null").select("rid", F.col("ms2_mzs").alias("mz")), "mz", 128)
    return p.select("rid", "mz", F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("filled"))


UNIT = lambda salt: f"CAST(('0x' || substr(md5('{salt}:' || rid || ':' || r), 1, 12)) AS BIGINT) / pow(16, 12)"


@q("m7b_augmented", f"""WITH k AS (SELECT rid, mz, it, row_number() OVER (PARTITION BY rid ORDER BY it DESC, mz) AS r FROM (SELECT rid, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS it FROM train_spectra) WHERE mz > 0 AND it > 0 AND NOT isnan(mz) AND NOT isnan(it)),
    j AS (SELECT rid, mz * (1 + (2 * {UNIT("mz")} - 1) * 5e-6) AS mz, it * (1 + (2 * {UNIT("it")} - 1) * 0.1) AS it FROM k WHERE r <= 3 OR {UNIT("drop")} >= 0.2) SELECT rid, count(*) AS n, round(max(mz), 4) AS top_mz, round(sum(it), 4) AS total FROM j GROUP BY rid""")
def _(t):
    s = S.augment(t.train_spectra.select("rid", "ms2_mzs", "ms2_normalized_intensities"), "rid").where(F.size("peaks") > 0)
    return s.select("rid", F.size("peaks").cast("bigint").alias("n"), F.round(F.array_max(F.transform("peaks", lambda p: p["mz"])), 4).alias("top_mz"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["it"]), 4).alias("total"))


@q("m8_query_regimes", """WITH s AS (SELECT inchikey14 AS k, count(*) AS n, count(DISTINCT ingest_lib) AS libs FROM train_spectra WHERE inchikey14 IS NOT NULL GROUP BY 1), r AS (SELECT k, CASE WHEN libs > 1 THEN 'other library' WHEN n > 1 THEN 'same library' ELSE 'unseen' END AS regime FROM s)
    SELECT k, regime FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5('q:' || k), k) AS x FROM r) WHERE x <= 30""")
def _(t):
    s = t.train_spectra.where("inchikey14 is not null").groupBy(F.col("inchikey14").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("ingest_lib").alias("libs"))
    r = s.select("k", F.when(F.col("libs") > 1, "other library").when(F.col("n") > 1, "same library").otherwise("unseen").alias("regime"))
    return R.capped_sample(r, ["regime"], "k", 30, "q").select("k", "regime")


@q("o3_leak_masks", """SELECT t.spectrum_id, count(r.rid) AS masked FROM test_spectra t LEFT JOIN train_spectra r ON r.precursor_mz = t.precursor_mz AND r.adduct = t.adduct AND r.instrument_type = t.instrument_type GROUP BY 1""")
def _(t):
    m = t.train_spectra.select("rid", "precursor_mz", "adduct", "instrument_type")
    return t.test_spectra.select("spectrum_id", "precursor_mz", "adduct", "instrument_type").join(m, ["precursor_mz", "adduct", "instrument_type"], "left").groupBy("spectrum_id").agg(F.count("rid").alias("masked"))


@q("o4_strip_congeners", "SELECT sid FROM train_structs s WHERE NOT EXISTS (SELECT 1 FROM train_structs h WHERE h.sid % 10 = 0 AND h.formula = s.formula AND h.sid <> s.sid)")
def _(t):
    held = t.train_structs.where("sid % 10 = 0").select(F.col("sid").alias("h"), "formula")
    s = t.train_structs.select("sid", "formula")
    return s.join(held, (s.formula == held.formula) & (s.sid != held.h), "left_anti").select("sid")


@q("o5_class_census", """WITH c AS (SELECT s.inchikey14 AS k, s.inchikey14 IN (SELECT inchikey14 FROM train_spectra WHERE inchikey14 IS NOT NULL) AS in_train, s.inchikey14 IN (SELECT ik FROM pubchem_rows WHERE ik IS NOT NULL) AS in_pub FROM train_structs s)
    SELECT CASE WHEN in_train AND in_pub THEN 'both' WHEN in_train THEN 'train only' WHEN in_pub THEN 'pub only' ELSE 'neither' END AS class, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    s = J.flag_member(t.train_structs.select("inchikey14"), t.train_spectra.select("inchikey14"), "inchikey14", "in_train")
    s = J.flag_member(s, t.pubchem_rows.select(F.col("ik").alias("inchikey14")), "inchikey14", "in_pub")
    c = F.when(F.col("in_train") & F.col("in_pub"), "both").when(F.col("in_train"), "train only").when(F.col("in_pub"), "pub only").otherwise("neither")
    return s.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@q("o5_census_by_library", "SELECT lib, count(*) AS molecules FROM (SELECT inchikey14, unnest(list(DISTINCT ingest_lib)) AS lib FROM train_spectra GROUP BY 1) GROUP BY lib")
def _(t):
    return t.train_spectra.groupBy("inchikey14").agg(F.collect_set("ingest_lib").alias("libs")).select(F.explode("libs").alias("lib")).groupBy("lib").agg(F.count("*").alias("molecules"))


@q("o8_counterfactual", """WITH l AS (SELECT ik AS mid, cid AS key, max(coalesce(n_pmid, 0)) AS c FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL), t AS (SELECT mid, arg_min(key, struct_pack(x := -c, y := key)) AS tk FROM l GROUP BY mid),
    d AS (SELECT l.mid, arg_min(l.c, struct_pack(h := md5('d:' || l.key), k := l.key)) AS c FROM l JOIN t ON t.mid = l.mid AND l.key <> t.tk GROUP BY l.mid) SELECT l.mid, l.key, CASE WHEN l.key = t.tk THEN d.c ELSE l.c END AS c FROM l JOIN t USING (mid) JOIN d USING (mid)""")
def _(t):
    c = cands(t).select("mid", "key", "c").join(truth(t).withColumnRenamed("key", "tk"), "mid")
    d = c.where("key <> tk").groupBy("mid").agg(F.min_by("c", F.struct(R.hash_order("key", "d"), "key")).alias("d"))
    return c.join(d, "mid").select("mid", "key", F.when(F.col("key") == F.col("tk"), F.col("d")).otherwise(F.col("c")).alias("c"))


@q("st_daily_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return E.windowed_counts(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@q("st_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def _(t):
    return E.sessions(t.events, "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@q("st_json_props", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS kinds FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("props").alias("kinds"))


@q("h_pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(avg(l_extendedprice) AS DOUBLE), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.avg("l_extendedprice").cast("double"), 4).alias("avg_price"), F.count("*").alias("n"))


@q("h_peaks_of_spectra", "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return t.orders.select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count_distinct("o_orderkey").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


@q("h_second_source", "SELECT src, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT 'supplier' AS src, s_acctbal AS bal FROM supplier UNION ALL SELECT 'customer', c_acctbal FROM customer) GROUP BY src")
def _(t):
    u = t.supplier.select(F.lit("supplier").alias("src"), F.col("s_acctbal").alias("bal")).unionByName(t.customer.select(F.lit("customer").alias("src"), F.col("c_acctbal").alias("bal")))
    return u.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("total"))


@q("w_share_of_group", "SELECT ik, cid, round(n / sum(n) OVER (PARTITION BY ik), 6) AS share FROM (SELECT ik, cid, count(*) AS n FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL)")
def _(t):
    n = t.pubchem_rows.where("ik is not null").groupBy("ik", "cid").agg(F.count("*").alias("n"))
    return n.select("ik", "cid", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ik")), 6).alias("share"))


queries, oracle_sql = q.queries, q.oracle_sql
