"""Ranked-list algebra and its evaluation, over candidate lists of structures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import evaluation as V
from peakloom.operators import fusion as U
from peakloom.operators import ranking as R
from peakloom.plans.registry import Registry

q = Registry()

CTE = """WITH l AS (SELECT ik AS mid, cid AS key, max(coalesce(n_sid, 0)) AS a, max(trust) AS b, max(coalesce(n_pmid, 0)) AS c, min(depositor) AS grp FROM pubchem_rows WHERE ik IS NOT NULL GROUP BY ALL),
    ra AS (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY a DESC, key) AS rank FROM l),
    rb AS (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY b DESC, key) AS rank FROM l WHERE b IS NOT NULL),
    truth AS (SELECT mid, arg_min(key, struct_pack(x := -c, y := key)) AS key FROM l GROUP BY mid) """


def cands(t):
    return t.pubchem_rows.where("ik is not null").groupBy(F.col("ik").alias("mid"), F.col("cid").alias("key")).agg(F.max(F.coalesce("n_sid", F.lit(0))).alias("a"), F.max("trust").alias("b"), F.max(F.coalesce("n_pmid", F.lit(0))).alias("c"), F.min("depositor").alias("grp"))


def la(t):
    return U.rerank(cands(t), [F.desc("a"), F.col("key")])


def lb(t):
    return U.rerank(cands(t).where("b is not null"), [F.desc("b"), F.col("key")])


def truth(t):
    return cands(t).groupBy("mid").agg(F.min_by("key", F.struct(-F.col("c"), "key")).alias("key"))


def merged(positions: str, cap: int | None = None) -> str:
    """SQL of lists merged by position; positions: a union of (mid, key, p, i)."""
    end = f" WHERE rank <= {cap}" if cap else ""
    return f"{CTE}, u AS ({positions}), f AS (SELECT mid, key, min(struct_pack(p := CAST(p AS DOUBLE), i := i)) AS place FROM u GROUP BY ALL) SELECT mid, key, rank FROM (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY place, key) AS rank FROM f){end}"


@q("r1_library_first", merged("SELECT mid, key, CAST(rank AS DOUBLE) AS p, 0 AS i FROM (SELECT rb.*, max(l.b) OVER (PARTITION BY rb.mid) AS best FROM rb JOIN l USING (mid, key)) WHERE best >= 4 UNION ALL SELECT mid, key, rank + 1000000.0, 1 FROM ra", 25))
def _(t):
    return U.library_first(lb(t).join(cands(t).select("mid", "key", "b"), ["mid", "key"]), la(t), "b", 4)


@q("r2_rrf", CTE + """, s AS (SELECT mid, key, 0.6 / (3 + rank) AS s, 0 AS i, rank AS r FROM ra UNION ALL SELECT mid, key, 0.4 / (3 + rank), 1, rank FROM rb), f AS (SELECT mid, key, round(sum(s::DOUBLE), 12) AS s, min(struct_pack(i := i, r := r)) AS seen FROM s GROUP BY ALL)
    SELECT mid, key, rank FROM (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY s DESC, seen, key) AS rank FROM f) WHERE rank <= 25""")
def _(t):
    return U.reciprocal_rank_fusion([(la(t), 0.6), (lb(t), 0.4)], cap=25)


#: Weights of the second list that are tried (fixed values).
WEIGHTS = (0.0, 0.2, 0.4, 0.6, 1.0)


@q("r2_rrf_weights", CTE + ", v AS (SELECT unnest([" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + """]) AS w), s AS (SELECT w, mid, key, 1.0::DOUBLE / (3 + rank) AS s FROM ra, v UNION ALL SELECT w, mid, key, w / (3 + rank) FROM rb, v), f AS (SELECT w, mid, key, round(sum(s), 12) AS s FROM s GROUP BY ALL),
    k AS (SELECT w, mid, key, row_number() OVER (PARTITION BY w, mid ORDER BY s DESC, key) AS rank FROM f), a AS (SELECT k.w, k.mid, min(k.rank) AS r FROM k JOIN truth ON truth.mid = k.mid AND truth.key = k.key GROUP BY 1, 2)
    SELECT w AS weight, count(*) AS n, round(avg(CASE WHEN r <= 25 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr FROM a GROUP BY w""")
def _(t):
    # both lists once, each row with all weights; one pass ranks them all
    weighted = lambda df, own: df.select("mid", "key", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(w if own else 1.0).alias("x")) for w in WEIGHTS])).alias("v"), "rank").select("v.weight", "mid", "key", (F.col("v.x") / (3 + F.col("rank"))).alias("s"))
    fused = weighted(la(t), False).union(weighted(lb(t), True)).groupBy("weight", "mid", "key").agg(F.round(F.sum("s"), 12).alias("s"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("weight", "mid").orderBy(F.desc("s"), "key")))
    right = ranked.join(truth(t), ["mid", "key"]).groupBy("weight", "mid").agg(F.min("rank").alias("r"))
    return right.groupBy("weight").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr"))


@q("r3_rrf_zero_based", CTE + """, s AS (SELECT mid, key, 1.0::DOUBLE / (60 + rank - 1) AS s FROM ra UNION ALL SELECT mid, key, 0.6::DOUBLE / (60 + rank - 1) FROM rb), f AS (SELECT mid, key, round(sum(s), 12) AS s FROM s GROUP BY ALL)
    SELECT mid, key, rank FROM (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY s DESC, key) AS rank FROM f) WHERE rank <= 25""")
def _(t):
    return U.reciprocal_rank_fusion([(la(t), 1.0), (lb(t), 0.6)], k=60, base=0, cap=25, by_key=True)


@q("r4_rank_blend", CTE + """, x AS (SELECT mid, key, 1 - (rank - 1) / greatest(1, count(*) OVER (PARTITION BY mid) - 1) AS x FROM ra), y AS (SELECT mid, key, 1 - (rank - 1) / greatest(1, count(*) OVER (PARTITION BY mid) - 1) AS y FROM rb),
    s AS (SELECT mid, key, round(0.7 * coalesce(x, 0) + (1 - 0.7) * coalesce(y, 0) + 1e-6 * coalesce(x, 0), 9) AS s FROM x FULL JOIN y USING (mid, key)) SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY s DESC, key) AS rank FROM s""")
def _(t):
    return U.rank_blend(la(t), lb(t), 0.7)


@q("r5_interleave", merged("SELECT mid, key, CASE WHEN rank <= 2 THEN rank - 1e9 ELSE 2.0 * (rank - 2) END AS p, 0 AS i FROM ra UNION ALL SELECT mid, key, 2.0 * rank + 1, 1 FROM rb", 40))
def _(t):
    return U.interleave(la(t), lb(t), head=2)


@q("r6_pattern_merge", merged("""SELECT mid, key, CASE WHEN rank <= 3 THEN CAST([1, 3, 4][rank] AS DOUBLE) ELSE 1e6 + rank END AS p, 0 AS i FROM ra UNION ALL SELECT mid, key, CASE WHEN rank <= 2 THEN CAST([2, 5][rank] AS DOUBLE) ELSE 2e6 + rank END, 1 FROM rb"""))
def _(t):
    return U.pattern_merge(la(t), lb(t), "EPEEP")


@q("r7_block_insert", merged("""SELECT mid, key, CASE WHEN rank <= 3 THEN CAST(rank AS DOUBLE) ELSE rank + 1000000.0 END AS p, 0 AS i FROM ra WHERE key % 2 = 0
    UNION ALL SELECT mid, key, 1000.0 + row_number() OVER (PARTITION BY mid ORDER BY rank, key), 1 FROM rb WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.mid = rb.mid AND ra.key = rb.key AND ra.key % 2 = 0 AND ra.rank <= 25) QUALIFY row_number() OVER (PARTITION BY mid ORDER BY rank, key) <= 5""", 25))
def _(t):
    return U.block_insert(la(t).where("key % 2 = 0"), lb(t))


@q("r8_slot_insert", merged("""SELECT mid, key, CASE r WHEN 1 THEN 2.0 ELSE 4.0 END AS p, 0 AS i FROM (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY rank, key) AS r FROM rb WHERE key % 2 = 1) WHERE r <= 2
    UNION ALL SELECT mid, key, CASE WHEN f >= 4 THEN f + 1.0 ELSE CAST(f AS DOUBLE) END, 1 FROM (SELECT mid, key, CASE WHEN r >= 2 THEN r + 1 ELSE r END AS f FROM (SELECT mid, key, row_number() OVER (PARTITION BY mid ORDER BY rank) AS r FROM ra WHERE key % 2 = 0))"""))
def _(t):
    return U.slot_insert(U.rerank(la(t).where("key % 2 = 0"), [F.col("rank")]), lb(t).where("key % 2 = 1"), [2, 4])


@q("r9_round_robin", merged("SELECT mid, key, 2.0 * rank AS p, 0 AS i FROM ra UNION ALL SELECT mid, key, 2.0 * rank + 1, 1 FROM rb", 10))
def _(t):
    return U.by_position([(la(t), 2 * F.col("rank")), (lb(t), 2 * F.col("rank") + 1)], 10)


@q("r10_rerank_in_groups", CTE + """, g AS (SELECT ra.*, l.grp, round(0.5 * coalesce(l.b, 0) + 0.1 * l.c, 9) AS f FROM ra JOIN l USING (mid, key)), s AS (SELECT mid, grp, rank, row_number() OVER (PARTITION BY mid, grp ORDER BY rank) AS s FROM g),
    m AS (SELECT mid, grp, key, row_number() OVER (PARTITION BY mid, grp ORDER BY f DESC, rank) AS s FROM g) SELECT mid, key, rank FROM m JOIN s USING (mid, grp, s)""")
def _(t):
    g = la(t).join(cands(t).select("mid", "key", "b", "c", "grp"), ["mid", "key"])
    return U.rerank_in_groups(g, "grp", 0.5 * F.coalesce("b", F.lit(0)) + 0.1 * F.col("c"))


@q("r11_prior_isotonic")
def _(t):
    # isotonic fit of the scores in list order, on the logit scale, with a popularity term; one group a list
    x = la(t).join(cands(t).select("mid", "key", (F.col("a") / (F.col("a") + 5.0)).alias("x"), "c"), ["mid", "key"]).select("mid", "key", "rank", "x", "c")
    fit = R.isotonic_decreasing(x, ["mid"], "rank", "x")
    p = F.least(F.greatest(F.col("fit"), F.lit(0.01)), F.lit(0.99))
    return U.rerank(fit.withColumn("s", F.round(F.ln(p / (1 - p)) + 0.3 * F.log1p("c"), 9)), [F.desc("s"), F.col("rank")])


@q("r12_protected", CTE + "SELECT mid, key, rank FROM ra JOIN l USING (mid, key) WHERE NOT (coalesce(b, 0) >= 5 AND rank <= 3)")
def _(t):
    return la(t).join(cands(t).select("mid", "key", "b"), ["mid", "key"]).where(~((F.coalesce("b", F.lit(0)) >= 5) & (F.col("rank") <= 3))).select("mid", "key", "rank")


@q("r13_gated", CTE + ", t AS (SELECT mid, max(coalesce(b, 0)) AS top FROM l GROUP BY mid) SELECT mid, key, rank FROM ra JOIN t USING (mid) WHERE top >= 5 UNION ALL SELECT mid, key, rank FROM rb JOIN t USING (mid) WHERE top < 5")
def _(t):
    top = cands(t).groupBy("mid").agg(F.max(F.coalesce("b", F.lit(0))).alias("top"))
    return la(t).join(top.where("top >= 5"), "mid", "left_semi").unionByName(lb(t).join(top.where("top < 5"), "mid", "left_semi"))


@q("r14_list_changes", CTE + """SELECT coalesce(x.mid, y.mid) AS mid, coalesce(bool_or(x.rank = 1 AND y.rank = 1), false) AS top1_same, bool_and(coalesce(x.rank = y.rank, false)) AS order_same, bool_and(x.rank IS NOT NULL AND y.rank IS NOT NULL) AS set_same FROM ra x FULL JOIN rb y ON x.mid = y.mid AND x.key = y.key GROUP BY 1""")
def _(t):
    return U.list_changes(la(t), lb(t))


@q("r15_pad", CTE + "SELECT i.mid, coalesce(CAST(rb.key AS VARCHAR), 'none') AS key, i.rank FROM (SELECT DISTINCT mid, unnest([1, 2, 3]) AS rank FROM l) i LEFT JOIN rb ON rb.mid = i.mid AND rb.rank = i.rank")
def _(t):
    return U.pad(lb(t), cands(t).select("mid").distinct(), 3, "none")


@q("r16_assemble", CTE + "SELECT mid, string_agg(CAST(key AS VARCHAR), ';' ORDER BY rank) AS entries FROM ra WHERE rank <= 25 GROUP BY mid")
def _(t):
    return U.assemble(la(t))


@q("r16_problems", CTE + "SELECT mid, 'missing' AS problem FROM l GROUP BY mid HAVING count(b) = 0")
def _(t):
    return U.problems(lb(t), cands(t).select("mid"), 1_000_000)


RANKS = CTE + ", r AS (SELECT truth.mid, min(ra.rank) AS r FROM truth LEFT JOIN ra ON ra.mid = truth.mid AND ra.key = truth.key GROUP BY 1) "
RANKS_B = CTE + ", r AS (SELECT truth.mid, min(rb.rank) AS r FROM truth LEFT JOIN rb ON rb.mid = truth.mid AND rb.key = truth.key GROUP BY 1) "


@q("v1_summary", RANKS_B + "SELECT count(*) AS n, round(avg(CASE WHEN r <= 25 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 5, 25)) + " FROM r")
def _(t):
    return V.summary(V.answer_ranks(lb(t), truth(t)))


@q("v2_by_variant", CTE + ", r AS (SELECT 'a' AS variant, truth.mid, min(ra.rank) AS r FROM truth LEFT JOIN ra ON ra.mid = truth.mid AND ra.key = truth.key GROUP BY 1, 2 UNION ALL SELECT 'b', truth.mid, min(rb.rank) FROM truth LEFT JOIN rb ON rb.mid = truth.mid AND rb.key = truth.key GROUP BY 1, 2) SELECT variant, count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 5)) + ", FROM r GROUP BY variant")
def _(t):
    rows = V.answer_ranks(la(t), truth(t)).withColumn("variant", F.lit("a")).unionByName(V.answer_ranks(lb(t), truth(t)).withColumn("variant", F.lit("b")))
    return V.summary(rows, (1, 5), ["variant"])


@q("v3_expected_rank", CTE + """, t AS (SELECT truth.mid, l.a AS t FROM truth JOIN l USING (mid, key)), c AS (SELECT mid, count(*) FILTER (WHERE l.a > t) AS better, count(*) FILTER (WHERE l.a = t) AS tied FROM l JOIN t USING (mid) GROUP BY mid)
    SELECT mid, better, tied, better + (tied + 1) / 2 AS e_rank, round(list_sum(list_transform(range(better + 1, better + tied + 1), lambda r: CASE WHEN r <= 25 THEN 1.0::DOUBLE / r ELSE 0 END)) / tied, 6) AS e_rr FROM c""")
def _(t):
    return V.expected_rank(cands(t).select("mid", "key", F.col("a").alias("score")), truth(t))


@q("v4_half_ties", CTE + ", t AS (SELECT truth.mid, l.a AS t FROM truth JOIN l USING (mid, key)) SELECT mid, 1 + count(*) FILTER (WHERE l.a > t) + 0.5::DOUBLE * (count(*) FILTER (WHERE l.a = t) - 1) AS r FROM l JOIN t USING (mid) GROUP BY mid")
def _(t):
    s = cands(t)
    best = s.join(truth(t), ["mid", "key"], "left_semi").select("mid", F.col("a").alias("t"))
    return s.join(best, "mid").groupBy("mid").agg((1 + F.count_if(F.col("a") > F.col("t")) + 0.5 * (F.count_if(F.col("a") == F.col("t")) - 1)).alias("r"))


@q("v6_chance", CTE + "SELECT mid, round(list_sum(list_transform(range(1, least(25, count(*)) + 1), lambda r: 1.0::DOUBLE / r)) / count(*), 6) AS rr FROM l GROUP BY mid")
def _(t):
    return cands(t).groupBy("mid").agg(F.count("*").alias("n")).select("mid", F.round(V.chance_rr(F.col("n")), 6).alias("rr"))


@q("v7_bootstrap")
def _(t):
    r = V.answer_ranks(la(t), truth(t)).withColumn("x", F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0))
    return V.bootstrap(r, "mid", "x")


@q("v7_paired_bootstrap")
def _(t):
    rr = lambda c: F.when(F.col(c) <= 25, 1 / F.col(c)).otherwise(0.0)
    both = V.answer_ranks(la(t), truth(t)).join(V.answer_ranks(lb(t), truth(t)).withColumnRenamed("r", "rb"), "mid")
    return V.bootstrap(both.withColumn("d", rr("r") - rr("rb")), "mid", "d")


@q("v8_error_buckets", RANKS_B + "SELECT CASE WHEN r IS NULL THEN 'absent' WHEN r = 1 THEN 'top' WHEN r <= 5 THEN 'near' ELSE 'far' END AS bucket, count(*) AS n, round(sum(1 - CASE WHEN r <= 25 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS lost FROM r GROUP BY 1")
def _(t):
    r = V.answer_ranks(lb(t), truth(t))
    bucket = F.when(F.col("r").isNull(), "absent").when(F.col("r") == 1, "top").when(F.col("r") <= 5, "near").otherwise("far")
    return r.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(1 - F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0)), 6).alias("lost"))


@q("v9_transitions", CTE + ", x AS (SELECT truth.mid, coalesce(min(ra.rank) <= 1, false) AS a_ok FROM truth LEFT JOIN ra ON ra.mid = truth.mid AND ra.key = truth.key GROUP BY 1), y AS (SELECT truth.mid, coalesce(min(rb.rank) <= 1, false) AS b_ok FROM truth LEFT JOIN rb ON rb.mid = truth.mid AND rb.key = truth.key GROUP BY 1) SELECT a_ok, b_ok, count(*) AS n FROM x JOIN y USING (mid) GROUP BY ALL")
def _(t):
    ok = lambda df, n: df.select("mid", F.coalesce(F.col("r") <= 1, F.lit(False)).alias(n))
    return ok(V.answer_ranks(la(t), truth(t)), "a_ok").join(ok(V.answer_ranks(lb(t), truth(t)), "b_ok"), "mid").groupBy("a_ok", "b_ok").agg(F.count("*").alias("n"))


@q("v10_spearman", CTE + ", r AS (SELECT mid, rank() OVER (PARTITION BY mid ORDER BY a) + (count(*) OVER (PARTITION BY mid, a) - 1) / 2 AS x, rank() OVER (PARTITION BY mid ORDER BY c) + (count(*) OVER (PARTITION BY mid, c) - 1) / 2 AS y FROM l) SELECT mid, count(*) AS n, round(corr(x, y), 5) AS rho FROM r GROUP BY mid HAVING count(*) > 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0")
def _(t):
    s = V.spearman(cands(t).select("mid", "a", "c"), "a", "c", ["mid"])
    return s.where("n > 2 and rho is not null and not isnan(rho)").select("mid", "n", F.round("rho", 5).alias("rho"))


@q("v11_pearson", "SELECT adduct, round(corr(precursor_mz, num_peaks), 5) AS r FROM train_spectra WHERE precursor_mz > 0 AND NOT isnan(precursor_mz) GROUP BY adduct HAVING count(*) > 5")
def _(t):
    return t.train_spectra.where("precursor_mz > 0 and not isnan(precursor_mz)").groupBy("adduct").agg(F.round(F.corr("precursor_mz", "num_peaks"), 5).alias("r"), F.count("*").alias("n")).where("n > 5").select("adduct", "r")


@q("v12_ks_distance", """WITH v AS (SELECT num_peaks AS x, count(*) FILTER (WHERE ionization_mode = 'positive') AS a, count(*) FILTER (WHERE ionization_mode <> 'positive') AS b FROM train_spectra WHERE ionization_mode IS NOT NULL AND num_peaks IS NOT NULL GROUP BY 1)
    SELECT round(max(abs(ca / ta - cb / tb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v)""")
def _(t):
    s = t.train_spectra.where("ionization_mode is not null and num_peaks is not null").withColumn("pos", F.col("ionization_mode") == "positive")
    return V.ks_distance(s, "num_peaks", "pos")


@q("v13_margin", CTE + "SELECT mid, max(a) FILTER (WHERE truth.key = l.key) - max(a) FILTER (WHERE truth.key <> l.key) AS margin FROM l JOIN truth USING (mid) GROUP BY mid".replace("USING (mid)", "ON truth.mid = l.mid").replace("SELECT mid,", "SELECT l.mid,").replace("GROUP BY mid", "GROUP BY l.mid"))
def _(t):
    s = cands(t).join(truth(t).withColumnRenamed("key", "true_key"), "mid")
    return s.groupBy("mid").agg((F.max(F.when(F.col("key") == F.col("true_key"), F.col("a"))) - F.max(F.when(F.col("key") != F.col("true_key"), F.col("a")))).alias("margin"))


@q("v14_weighted_total", RANKS + ", n AS (SELECT mid, count(*) AS w FROM l GROUP BY mid) SELECT round(sum(w * CASE WHEN r <= 25 THEN 1.0::DOUBLE / r ELSE 0 END) / sum(w), 6) AS total FROM r JOIN n USING (mid)")
def _(t):
    n = cands(t).groupBy("mid").agg(F.count("*").alias("w"))
    return V.answer_ranks(la(t), truth(t)).join(n, "mid").agg(F.round(F.sum(F.col("w") * F.when(F.col("r") <= 25, 1 / F.col("r")).otherwise(0.0)) / F.sum("w"), 6).alias("total"))


@q("v16_cross_fit", RANKS + ", f AS (SELECT mid, r, CAST(('0x' || substr(md5(mid), 1, 12)) AS BIGINT) % 5 AS fold FROM r) SELECT fold, count(*) AS n, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM f GROUP BY fold")
def _(t):
    return V.answer_ranks(la(t), truth(t)).groupBy(R.fold("mid", 5).alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg(1 / F.col("r")), 6).alias("mrr"))


@q("v17_source_share", CTE + "SELECT grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ra JOIN l USING (mid, key) WHERE rank <= 5 GROUP BY grp")
def _(t):
    g = la(t).where("rank <= 5").join(cands(t).select("mid", "key", "grp"), ["mid", "key"]).groupBy("grp").agg(F.count("*").alias("n"))
    return g.select("grp", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@q("v19_projection", CTE + ", n AS (SELECT mid, count(*) AS n, (count(*) FILTER (WHERE a > 3) + 1) / (count(*) + 1.0::DOUBLE) AS q FROM l GROUP BY mid) SELECT mid, pool, round((1 - pow(1 - q, pool)) / (pool * q), 6) AS rr FROM (SELECT *, unnest([10, 100, 1000]) AS pool FROM n)")
def _(t):
    n = cands(t).groupBy("mid").agg(((F.count_if(F.col("a") > 3) + 1) / (F.count("*") + 1.0)).alias("q"))
    p = n.select("mid", "q", F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))).alias("pool"))
    return p.select("mid", "pool", F.round((1 - F.pow(1 - F.col("q"), F.col("pool"))) / (F.col("pool") * F.col("q")), 6).alias("rr"))


@q("v20_group_error", CTE + ", t AS (SELECT truth.mid, l.a AS t, l.grp, l.key AS tk FROM truth JOIN l USING (mid, key)) SELECT l.mid, round(avg(CASE WHEN l.a > t THEN 1.0::DOUBLE WHEN l.a = t THEN 0.5 ELSE 0 END), 6) AS err FROM l JOIN t ON t.mid = l.mid AND t.grp = l.grp AND l.key <> t.tk GROUP BY l.mid")
def _(t):
    s = cands(t)
    best = s.join(truth(t), ["mid", "key"], "left_semi").select("mid", "grp", F.col("a").alias("t"), F.col("key").alias("tk"))
    return s.join(best, ["mid", "grp"]).where("key <> tk").groupBy("mid").agg(F.round(F.avg(F.when(F.col("a") > F.col("t"), 1.0).when(F.col("a") == F.col("t"), 0.5).otherwise(0.0)), 6).alias("err"))


@q("v21_disagreements", CTE + "SELECT ra.mid, ra.key AS by_a, rb.key AS by_b FROM ra JOIN rb ON ra.mid = rb.mid AND ra.rank = 1 AND rb.rank = 1 WHERE ra.key <> rb.key")
def _(t):
    a, b = la(t).where("rank = 1").select("mid", F.col("key").alias("by_a")), lb(t).where("rank = 1").select("mid", F.col("key").alias("by_b"))
    return a.join(b, "mid").where("by_a <> by_b")


@q("v15_mix_calibration")
def _(t):
    # which mix of the instruments' mean qualities explains the libraries' best, with each library left out once
    s = t.train_spectra.where("quality_score between 0 and 1").select(F.lower(F.trim("ingest_lib")).alias("system"), F.coalesce("ionization_mode", F.lit("none")).alias("class"), "quality_score", "num_peaks")
    cells = s.groupBy("system", "class").agg(F.avg("quality_score").alias("x"))
    seen = s.where("system is not null").groupBy("system").agg(F.avg(F.when(F.col("num_peaks") >= 20, F.col("quality_score")).otherwise(0.0)).alias("y"))
    return V.mix_calibration(cells.where("system is not null"), seen)


queries, oracle_sql = q.queries, q.oracle_sql
