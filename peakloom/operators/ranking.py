"""Ranks, normalisations and samples within groups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _w(group: Sequence[str]):
    return Window.partitionBy(*group)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. Spark limits ranks before the exchange, so hot keys stay small."""
    return df.withColumn("__r", F.row_number().over(_w(keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(_w(group).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)


def hash_order(key: Column | str, seed: str) -> Column:
    """An order that any engine gets the same: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def capped_sample(df: DataFrame, group: Sequence[str], key: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows of each group, in the order of a hash, so in any run the same ones."""
    return top_k(df, group, [hash_order(key, seed), F.col(key)], cap, "__r").drop("__r")


def unit_hash(key: str, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 12 digits of md5(salt + key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)


def fold(key: str, k: int, salt: str = "") -> Column:
    """md5(salt + key) mod k, by its first 12 digits."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint"), F.lit(k)).cast("bigint")


def rank01(group: Sequence[str], order: Sequence[Column]) -> Column:
    """0 for the best, 1 for the last, by position; a group of one has 0."""
    w = _w(group)
    return (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1)


def rank_share(group: Sequence[str], order: Sequence[Column]) -> Column:
    """rank / n, equal values sharing the average rank."""
    w = _w(group)
    ties = F.count("*").over(Window.partitionBy(*group, *order))
    return (F.rank().over(w.orderBy(*order)) + (ties - 1) / 2) / F.count("*").over(w)


def gap_to_best(x: str, group: Sequence[str]) -> Column:
    return F.col(x) - F.max(x).over(_w(group))


def zscore(x: str, group: Sequence[str], sample: bool = False, add: float = 0.0, least: float | None = None) -> Column:
    """(x - mean) / (sd + add); population or sample sd; 0 where the sd is at most ``least`` or missing."""
    w = _w(group)
    sd = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    z = F.try_divide(F.col(x) - F.avg(x).over(w), sd + add)
    low = sd.isNull() | F.isnan(sd)
    if least is not None:
        low = low | (sd <= least)
    return F.when(low, F.lit(0.0)).otherwise(z)


def with_softmax(df: DataFrame, x: str, group: Sequence[str], name: str = "p") -> DataFrame:
    """Adds the softmax of ``x`` within the group."""
    w = _w(group)
    return df.withColumn("__e", F.exp(F.col(x) - F.max(x).over(w))).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def isotonic_decreasing(df: DataFrame, group: Sequence[str], order: str, x: str, name: str = "fit", weight: str | None = None) -> DataFrame:
    """Least-squares fit that never rises in list order, by pooling adjacent violators; groups are ranked lists of bounded length."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        blocks: list[list[float]] = []
        ws = pdf[weight] if weight else [1.0] * len(pdf)
        for v, w in zip(pdf[x], ws):
            blocks.append([v, w, 1])
            while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        pdf[name] = [b[0] for b in blocks for _ in range(int(b[2]))]
        return pdf

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.groupBy(*group).applyInPandas(fit, schema)


def list_dedup(df: DataFrame, group: Sequence[str], key: str, rank: str, cap: int | None = None) -> DataFrame:
    """A ranked list without repeated keys: each key at its best rank, ranks from 1 anew, at most ``cap``."""
    best = df.groupBy(*group, key).agg(F.min(rank).alias("__b"))
    out = best.withColumn(rank, F.row_number().over(_w(group).orderBy("__b", key)).cast("bigint")).drop("__b")
    return out.where(F.col(rank) <= cap) if cap else out


def ordered_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Numbers from 0 in a total order of the whole table, without one task that holds it.

    Rows are range-partitioned, counted for each partition and numbered within; the table is cut in between, so that a task
    that runs again numbers the same rows.
    """
    from peakloom.session import cut

    cols = [F.col(c) for c in order]
    rows = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__p", F.spark_partition_id()), "ordered")
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__off"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*cols)) - 1
    return rows.withColumn("__w", within).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__w") + F.col("__off")).drop("__p", "__w", "__off")
