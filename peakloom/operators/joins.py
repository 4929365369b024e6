"""Joins on ranges, nearest values and fallback keys, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def range_join(windows: DataFrame, points: DataFrame, lo: str, hi: str, value: str, width: float, on: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Points whose ``value`` lies in [lo, hi] of a window, as an equi-join on cells of ``width``.

    A window stands in every cell it touches, a point in one, so a pair meets once. ``width`` should be near the usual width of
    a window. ``how`` is inner or semi (the points inside any window). Windows or points with a null or NaN bound meet nothing.
    """
    w = windows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & (F.col(lo) <= F.col(hi)))
    w = w.withColumn("__cell", F.explode(_cells(F.col(lo), F.col(hi), width)))
    p = points.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__cell", F.floor(F.col(value) / width))
    inside = p[value].between(w[lo], w[hi])
    same = [w[c] == p[c] for c in (*on, "__cell")]
    if how == "semi":
        return p.join(w, [*same, inside], "left_semi").drop("__cell")
    out = w.join(p, [*same, inside], "inner").drop(w["__cell"]).drop(p["__cell"])
    for c in on:
        out = out.drop(p[c])
    return out


def tolerance_join(queries: DataFrame, points: DataFrame, q: str, p: str, da: float | None = None, ppm: float | None = None, on: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Points within an absolute or relative tolerance of a query's value."""
    tol = F.lit(da) if da is not None else F.abs(F.col(q)) * ppm * 1e-6
    w = queries.withColumn("__lo", F.col(q) - tol).withColumn("__hi", F.col(q) + tol)
    return range_join(w, points, "__lo", "__hi", p, width or (2 * da if da is not None else 0.02), on).drop("__lo", "__hi")


def fallback_window(queries: DataFrame, points: DataFrame, qid: str, q: str, p: str, near_ppm: float, wide_ppm: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Points within ``near_ppm`` of each query, or within ``wide_ppm`` where there is none so near. One range join serves both."""
    wide = tolerance_join(queries, points, q, p, ppm=wide_ppm, on=on).withColumn("ppm", F.abs(F.col(p) - F.col(q)) / F.col(q) * 1e6)
    hit = F.max((F.col("ppm") <= near_ppm).cast("int")).over(Window.partitionBy(qid))
    return wide.withColumn("__near", hit).where((F.col("ppm") <= near_ppm) | (F.col("__near") == 0)).drop("__near")


def nearest_by_value(queries: DataFrame, points: DataFrame, qid: str, q: str, pid: str, p: str, n: int, reach: float) -> DataFrame:
    """The ``n`` points nearest to each query within ``reach``; at equal distance the lower one first, then the smaller id."""
    near = tolerance_join(queries, points, q, p, da=reach, width=reach)
    w = Window.partitionBy(qid).orderBy(F.round(F.abs(F.col(p) - F.col(q)), 9), F.col(p), F.col(pid))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fallback_lookup(rows: DataFrame, lookup: DataFrame, first: str, second: str, key: str, values: tuple[str, ...]) -> DataFrame:
    """Values by the first key, else by the second; column ``how`` says which: exact, fallback or unknown."""
    a = lookup.select(F.col(key).alias(first), *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__a"))
    b = lookup.select(F.col(key).alias(second), *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(True).alias("__b"))
    out = rows.join(a, first, "left").join(b, second, "left")
    for v in values:
        out = out.withColumn(v, F.when(F.col("__a"), F.col(f"__a_{v}")).otherwise(F.col(f"__b_{v}")))
    how = F.when(F.col("__a"), "exact").when(F.col("__b"), "fallback").otherwise("unknown")
    return out.withColumn("how", how).drop("__a", "__b", *[f"__{s}_{v}" for s in "ab" for v in values])


def flag_member(rows: DataFrame, members: DataFrame, on: str, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the key stands in ``members``."""
    m = members.select(F.col(on)).where(F.col(on).isNotNull()).distinct().withColumn("__in", F.lit(True))
    return rows.join(m, on, "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")


def not_in(rows: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """NOT IN over the members' non-null keys; rows with a null key don't come out, as in SQL."""
    return rows.where(F.col(on).isNotNull()).join(members.select(on).where(F.col(on).isNotNull()), on, "left_anti")


def union_with_priority(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``second`` what has a key that ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
