"""Algebra of ranked lists in long form: one row for each (list, key) with its rank from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MID, KEY, RANK = "mid", "key", "rank"


def rerank(df: DataFrame, order: Sequence[Column], cap: int | None = None) -> DataFrame:
    """(mid, key, rank) by a total order within each list."""
    out = df.withColumn(RANK, F.row_number().over(Window.partitionBy(MID).orderBy(*order)).cast("bigint")).select(MID, KEY, RANK)
    return out.where(F.col(RANK) <= cap) if cap else out


def by_position(parts: Sequence[tuple[DataFrame, Column]], cap: int | None = None) -> DataFrame:
    """Lists merged by a position that each computes from its ranks; a key stands at its first position, the earlier list first."""
    rows = None
    for i, (df, pos) in enumerate(parts):
        part = df.select(MID, KEY, F.struct(pos.cast("double").alias("p"), F.lit(i).alias("i")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rerank(rows.groupBy(MID, KEY).agg(F.min("at").alias("at")), [F.col("at"), F.col(KEY)], cap)


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], k: float = 3.0, base: int = 1, cap: int | None = None, by_key: bool = False) -> DataFrame:
    """Sum of weight / (k + rank), ranks from ``base``; ties by key, or by first appearance in the lists."""
    rows = None
    for i, (df, w) in enumerate(lists):
        part = df.select(MID, KEY, (F.lit(w) / (F.lit(k) + F.col(RANK) - 1 + base)).alias("s"), F.struct(F.lit(i).alias("i"), F.col(RANK).alias("r")).alias("seen"))
        rows = part if rows is None else rows.unionByName(part)
    s = rows.groupBy(MID, KEY).agg(F.round(F.sum("s"), 12).alias("s"), F.min("seen").alias("seen"))
    return rerank(s, [F.desc("s"), F.col(KEY) if by_key else F.col("seen"), F.col(KEY)], cap)


def library_first(heads: DataFrame, tails: DataFrame, score: str, gate: float, cap: int = 25) -> DataFrame:
    """Heads whose list's best score reaches the gate come before the tail; else the tail alone."""
    best = F.max(score).over(Window.partitionBy(MID))
    h = heads.withColumn("__best", best).where(F.col("__best") >= gate)
    return by_position([(h, F.col(RANK)), (tails, F.col(RANK) + 1_000_000)], cap)


def rank_blend(a: DataFrame, b: DataFrame, wa: float) -> DataFrame:
    """wa * (1 - rank01 in a) + (1 - wa) * (1 - rank01 in b); a key missing from a list counts as its last."""
    def r01(df, name):
        n = F.count("*").over(Window.partitionBy(MID))
        return df.select(MID, KEY, (1 - (F.col(RANK) - 1) / F.greatest(F.lit(1), n - 1)).alias(name))

    both = r01(a, "x").join(r01(b, "y"), [MID, KEY], "full")
    s = both.withColumn("s", F.round(wa * F.coalesce("x", F.lit(0.0)) + (1 - wa) * F.coalesce("y", F.lit(0.0)) + 1e-6 * F.coalesce("x", F.lit(0.0)), 9))
    return rerank(s, [F.desc("s"), F.col(KEY)])


def interleave(e: DataFrame, p: DataFrame, head: int = 0, cap: int = 40, block: bool = False) -> DataFrame:
    """The first ``head`` of e, then e and p in turns (or all of p, then e)."""
    r = F.col(RANK)
    if block:
        return by_position([(e, F.when(r <= head, r).otherwise(r + 2_000_000)), (p, r + 1_000_000)], cap)
    return by_position([(e, F.when(r <= head, r - 1e9).otherwise(2 * (r - head))), (p, 2 * r + 1)], cap)


def pattern_merge(e: DataFrame, p: DataFrame, pattern: str, cap: int | None = None) -> DataFrame:
    """Lists drawn in the order of a string of E and P; what is left follows, e before p. Keys met before are skipped."""
    def place(letter: str) -> Column:
        spots = [i + 1 for i, c in enumerate(pattern) if c == letter]
        known = F.array(*[F.lit(float(x)) for x in spots]) if spots else F.array().cast("array<double>")
        return F.when(F.col(RANK) <= len(spots), F.try_element_at(known, F.col(RANK).cast("int"))).otherwise(F.lit(1e6 if letter == "E" else 2e6) + F.col(RANK))

    return by_position([(e, place("E")), (p, place("P"))], cap)


def block_insert(base: DataFrame, extra: DataFrame, keep: int = 3, add: int = 5, cap: int = 25) -> DataFrame:
    """The base's first ``keep``, the first ``add`` extra keys that its first ``cap`` lack, the rest of the base."""
    new = extra.join(base.where(F.col(RANK) <= cap).select(MID, KEY), [MID, KEY], "left_anti")
    new = rerank(new, [F.col(RANK), F.col(KEY)], add)
    return by_position([(base, F.when(F.col(RANK) <= keep, F.col(RANK)).otherwise(F.col(RANK) + 1_000_000)), (new, F.col(RANK) + 1000)], cap)


def slot_insert(base: DataFrame, extra: DataFrame, slots: Sequence[int], promote: bool = False) -> DataFrame:
    """Extra keys at fixed positions of the result, base keys in the others; promoted, the first extra key leads instead."""
    new = rerank(extra.join(base.select(MID, KEY), [MID, KEY], "left_anti"), [F.col(RANK), F.col(KEY)], len(slots))
    slots = sorted(slots)
    slots = [1, *slots[1:]] if promote else slots
    places = F.array(*[F.lit(float(s)) for s in slots])
    # base rank r goes to the r-th position that no slot takes
    free = F.col(RANK).cast("double")
    for s in slots:
        free = F.when(free >= s, free + 1).otherwise(free)
    return by_position([(new, F.element_at(places, F.col(RANK).cast("int"))), (base, free)])


def rerank_in_groups(df: DataFrame, group: str, fused: Column) -> DataFrame:
    """Members of a group exchange their positions by ``fused`` from high to low; no one else moves.

    Values are rounded to 1e-9 and ties keep their order; rows with a null group keep their rank.
    """
    part = Window.partitionBy(MID, group)
    rows = df.withColumn("__f", F.round(fused, 9)).where(F.col(group).isNotNull())
    slots = rows.select(MID, group, RANK, F.row_number().over(part.orderBy(RANK)).alias("__s"))
    moved = rows.select(MID, group, KEY, F.row_number().over(part.orderBy(F.col("__f").desc_nulls_last(), RANK)).alias("__s"))
    out = moved.join(slots, [MID, group, "__s"]).select(MID, KEY, RANK)
    return out.unionByName(df.where(F.col(group).isNull()).select(MID, KEY, RANK))


def list_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mid, top1_same, order_same, set_same) of two versions of each list."""
    x = a.select(MID, KEY, F.col(RANK).alias("ra"))
    y = b.select(MID, KEY, F.col(RANK).alias("rb"))
    return x.join(y, [MID, KEY], "full").groupBy(MID).agg(
        F.coalesce(F.bool_or((F.col("ra") == 1) & (F.col("rb") == 1)), F.lit(False)).alias("top1_same"),
        F.every(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).alias("order_same"),
        F.every(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("set_same"),
    )


def pad(df: DataFrame, ids: DataFrame, n: int, default: str) -> DataFrame:
    """Exactly ``n`` entries for every id: missing ones are ``default``."""
    full = ids.select(MID, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias(RANK))
    return full.join(df.where(F.col(RANK) <= n), [MID, RANK], "left").select(MID, F.coalesce(F.col(KEY).cast("string"), F.lit(default)).alias(KEY), RANK)


def assemble(df: DataFrame, value: str = KEY, n: int = 25, sep: str = ";") -> DataFrame:
    """(mid, entries): the first n values of each list in order, joined."""
    top = df.where(F.col(RANK) <= n).groupBy(MID).agg(F.array_sort(F.collect_list(F.struct(RANK, F.col(value).cast("string").alias("v")))).alias("l"))
    return top.select(MID, F.concat_ws(sep, F.transform("l", lambda x: x.v)).alias("entries"))


def problems(df: DataFrame, ids: DataFrame, n: int = 25) -> DataFrame:
    """(mid, problem) of lists that are missing, unknown, too long, with gaps, repeated or empty entries."""
    per = df.groupBy(MID).agg(F.count("*").alias("n"), F.count_distinct(KEY).alias("d"), F.max(RANK).alias("top"), F.count_if(F.col(KEY).isNull() | (F.trim(F.col(KEY).cast("string")) == "")).alias("empty"))
    out = ids.select(MID).distinct().withColumn("known", F.lit(True)).join(per, MID, "full")
    why = F.when(F.col("known").isNull(), "unknown id").when(F.col("n").isNull(), "missing").when(F.col("n") > n, "too long").when(F.col("top") != F.col("n"), "gaps").when(F.col("empty") > 0, "empty entry").when(F.col("d") < F.col("n"), "repeated entry")
    return out.select(MID, why.alias("problem")).where("problem is not null")
