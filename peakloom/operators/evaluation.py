"""Measures of ranked lists against known answers, and statistics of comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_ranks(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """(mid, r): the rank of the first right answer, null where none is in the list. truth: (mid, key)."""
    hit = lists.join(truth.select("mid", "key").distinct(), ["mid", "key"], "left_semi").groupBy("mid").agg(F.min("rank").alias("r"))
    return truth.select("mid").distinct().join(hit, "mid", "left")


def summary(ranks: DataFrame, ks: Sequence[int] = (1, 5, 25), by: Sequence[str] = ()) -> DataFrame:
    """n, mrr at the largest k, recall at each k; missing answers count as 0."""
    top = max(ks)
    out = [F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") <= top, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr")]
    out += [F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(*by).agg(*out) if by else ranks.agg(*out)


def expected_rank(scores: DataFrame, truth: DataFrame, cutoff: int = 25) -> DataFrame:
    """(mid, better, tied, e_rank, e_rr): expectations over the order of equal scores. scores: (mid, key, score)."""
    best = scores.join(truth.select("mid", "key").distinct(), ["mid", "key"], "left_semi").groupBy("mid").agg(F.max("score").alias("t"))
    c = scores.join(best, "mid").groupBy("mid").agg(F.count_if(F.col("score") > F.col("t")).alias("better"), F.count_if(F.col("score") == F.col("t")).alias("tied"))
    span = F.sequence(F.col("better") + 1, F.col("better") + F.col("tied"))
    rr = F.aggregate(span, F.lit(0.0), lambda a, r: a + F.when(r <= cutoff, 1 / r).otherwise(0.0))
    return c.select("mid", "better", "tied", (F.col("better") + (F.col("tied") + 1) / 2).alias("e_rank"), F.round(rr / F.col("tied"), 6).alias("e_rr"))


def chance_rr(n: Column, cutoff: int = 25) -> Column:
    """Expected reciprocal rank of a random order of n candidates."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(cutoff), n).cast("int")), F.lit(0.0), lambda a, r: a + 1 / r) / n


def hash_poisson(key: Column, replicate: Column) -> Column:
    """A draw from Poisson(1), by inversion of a hash of (key, replicate): bootstrap weights without a random state."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)

    def draw(v: Column) -> Column:
        out, term, total, limits = F.lit(8), 0.36787944117144233, 0.0, []
        for k in range(8):
            total += term
            limits.append((total, k))
            term /= k + 1
        for limit, k in reversed(limits):
            out = F.when(v < limit, k).otherwise(out)
        return out

    # the hash is bound once, not computed in each branch
    return F.get(F.transform(F.array(u), draw), F.lit(0))


def bootstrap(df: DataFrame, unit: str, x: str, replicates: int = 200) -> DataFrame:
    """(mean, lo, hi): percentile interval of the mean. Each row gets a weight for each replicate; sums are pre-aggregated."""
    # replicate -1 has all weights 1: the mean itself
    rows = df.where(F.col(x).isNotNull()).select(F.col(unit).alias("u"), F.col(x).alias("x"), F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))).alias("b"))
    w = F.when(F.col("b") < 0, 1).otherwise(hash_poisson(F.col("u"), F.col("b")))
    per = rows.withColumn("w", w).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))
    drawn = F.when(F.col("b") >= 0, F.col("m"))
    return per.agg(F.max(F.when(F.col("b") < 0, F.col("m"))).alias("mean"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation within groups, equal values sharing their average rank."""
    def avg_rank(c):
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    r = df.withColumn("__a", avg_rank(a)).withColumn("__b", avg_rank(b))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("rho"))


def ks_distance(df: DataFrame, x: str, side: str, weight: str | None = None) -> DataFrame:
    """(ks): the largest difference of the two sides' weighted distributions; ``side`` is a boolean column.

    Values are summed first, so the running sum is over distinct values, within one partition of them.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    v = df.groupBy(x).agg(F.sum(F.when(F.col(side), w).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col(side), w).otherwise(0.0)).alias("b"))
    run = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return v.select(F.abs(F.sum("a").over(run) / F.sum("a").over(Window.partitionBy()) - F.sum("b").over(run) / F.sum("b").over(Window.partitionBy())).alias("d")).agg(F.round(F.max("d"), 6).alias("ks"))


def capped_weights(x: np.ndarray, y: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Weights w of at least 0 and a sum of at most 1 that bring x w nearest to y, by projected gradients with momentum."""
    def nearest_allowed(v: np.ndarray) -> np.ndarray:
        w = np.maximum(v, 0)
        if w.sum() <= 1:
            return w
        u = np.sort(v)[::-1]
        over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
        return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)

    w = ahead = np.zeros(x.shape[1])
    size, t = max(np.linalg.norm(x, 2) ** 2, 1e-12), 1.0
    for _ in range(rounds):
        new = nearest_allowed(ahead - x.T @ (x @ ahead - y) / size)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - w)
        if np.abs(new - w).max(initial=0) < 1e-12:
            return new
        w = new
    return w


def mix_calibration(profiles: DataFrame, seen: DataFrame, most: int = 10_000) -> DataFrame:
    """(name, kind, value): the weights of classes that best explain the systems' totals, and what each total would be without it.

    profiles: (system, class, x), what is missing being 0; seen: (system, y). Weights are at least 0 and sum to at most 1. Rows
    are ``weight`` for each class, ``left_out`` for each system (predicted by a fit without it) and ``rmse`` of these. Both
    tables are of systems and classes, not of records; more than ``most`` rows are an error.
    """
    from peakloom.session import few

    cells, totals = few(profiles.select("system", "class", "x"), most, "profile cells"), dict(map(tuple, few(seen.select("system", "y"), most, "systems")))
    names, classes = sorted(totals), sorted({r[1] for r in cells})
    x, y = np.zeros((len(names), len(classes))), np.array([totals[n] for n in names])
    for s, c, v in cells:
        if s in totals:
            x[names.index(s), classes.index(c)] = v
    rows = [(c, "weight", round(float(w), 4)) for c, w in zip(classes, capped_weights(x, y))] if names else []
    left = [float(x[i] @ capped_weights(np.delete(x, i, 0), np.delete(y, i))) for i in range(len(names))] if len(names) > 1 else []
    rows += [(n, "left_out", round(p, 4)) for n, p in zip(names, left)]
    if left:
        rows.append(("all", "rmse", round(float(np.sqrt(np.mean((np.array(left) - y) ** 2))), 4)))
    return profiles.sparkSession.createDataFrame(rows, "name string, kind string, value double")
