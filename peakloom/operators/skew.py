"""Per-key results without a reducer that waits for one hot key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
SALTS = 32


#: States of a key that one merge receives at most.
FAN_IN = 16


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: dict[str, tuple[Column, str]], fan_in: int | None = None) -> DataFrame:
    """Multi-level tree aggregation of mergeable states.

    ``states`` maps an output name to (expression of the rows, merge), merge being ``sum``, ``min`` or ``max``. Each input
    chunk (what a scan task reads, a fixed size) is combined where it lies, before the exchange; then rounds merge the states
    of ``fan_in`` neighbouring chunks until one is left, so no reducer ever receives more than ``fan_in`` states of a key,
    however many chunks hold it. The fan-in is the root of the number of chunks, FAN_IN at most, unless it is given; so more
    than one chunk takes two rounds at least. Null keys form groups of their own; an empty input gives an empty result.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    for _, how in states.values():
        if how not in merge:
            raise ValueError(f"not a merge: {how}")
    clash = set(states) & set(keys)
    if clash:
        raise ValueError(f"states named like keys: {sorted(clash)}")
    n, fan_in = _tree(df, fan_in)
    rows = df.select(*keys, *(e.alias(k) for k, (e, _) in states.items()), F.spark_partition_id().alias("__chunk"))
    while True:
        n = -(-n // fan_in)
        rows = rows.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in)).groupBy(*keys, "__chunk").agg(*(merge[how](k).alias(k) for k, (_, how) in states.items()))
        if n <= fan_in:
            return rows.groupBy(*keys).agg(*(merge[how](k).alias(k) for k, (_, how) in states.items()))


def _tree(df: DataFrame, fan_in: int | None) -> tuple[int, int]:
    """(chunks, fan-in) of a tree over the tasks that read ``df``."""
    n = max(1, df.rdd.getNumPartitions())
    return n, max(2, fan_in or min(FAN_IN, math.isqrt(n - 1) + 1))


def smallest_k(c: Column, k: int) -> Column:
    """Aggregate: the ``k`` smallest values in order, from a heap that is bounded at ``k``, kept on the map side and merged.

    Spark has this as an aggregate for its recommenders; it isn't among the functions of the Python API, so it is asked for by
    name. Values must not be null; structs may hold nulls, which come first.
    """
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    sc = SparkSession.active().sparkContext
    columns = getattr(getattr(sc._jvm.org.apache.spark.sql, "Column$"), "MODULE$")
    return Column(columns.internalFn("collect_top_k", _to_seq(sc, [c, F.lit(k), F.lit(True)], _to_java_column)))


def tree_heaps(df: DataFrame, keys: Sequence[str], value: Column, k: int, fan_in: int | None = None) -> DataFrame:
    """(keys, value): the ``k`` smallest values of each key, one row each, in rounds as ``tree_aggregate``.

    A task hands on a heap of at most ``k`` values of a key, and no merge receives more than ``fan_in`` heaps of a key.
    """
    n, fan_in = _tree(df, fan_in)
    rows = df.select(*keys, value.alias("__v"), F.spark_partition_id().alias("__chunk"))
    while True:
        n = -(-n // fan_in)
        rows = rows.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in)).groupBy(*keys, "__chunk").agg(smallest_k(F.col("__v"), k).alias("__v"))
        rows = rows.withColumn("__v", F.explode("__v"))
        if n <= fan_in:
            return rows.groupBy(*keys).agg(smallest_k(F.col("__v"), k).alias("__v")).select(*keys, F.explode("__v").alias("value"))


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE) -> DataFrame:
    """(key) of the keys with at least ``share`` of all rows, at most 1/share of them, from one row of counts a key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) >= max(2, total * share)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, row_id: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join of many rows (left, skewed) with one row a key (right), the hot keys spread over ``salts`` partitions each.

    ``hot`` has at most 1 / HOT_SHARE keys, so it may be broadcast. Rows of ``left`` with a null key stay in a left join.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    mark = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    salted = left.join(mark, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.lit(0))).cast("int")).drop("__hot")
    spread = right.join(mark, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def bucketed_prefix(df: DataFrame, part: Sequence[str], by: Sequence[Column | str], value: Column, name: str = "before", buckets: int = 1024, seed: str = "") -> DataFrame:
    """Running sum of ``value`` before each row, within ``part``, in the order of a hash of ``by`` (then ``by``).

    The order is split into ``buckets`` ranges of the hash: each (part, bucket) is summed, the sums of a part (at most
    ``buckets`` numbers) give the offsets, and the running sum runs within a bucket. No task holds a whole part.
    """
    # the hash gives the order; its leading bits are the bucket
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in by))), 1, 12), 16, 10).cast("bigint")
    rows = df.withColumn("__h", h).withColumn("__b", F.floor(F.col("__h") / F.lit((1 << 48) // buckets)).cast("int")).withColumn("__v", value)
    sums = rows.groupBy(*part, "__b").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(part)], F.col("__b").alias("__ob"), F.coalesce(before, F.lit(0)).alias("__off"))
    within = F.sum("__v").over(Window.partitionBy(*part, "__b").orderBy("__h", *by).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__w", F.coalesce(within, F.lit(0)))
    on = [F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(part)] + [F.col("__b") == F.col("__ob")]
    return rows.join(offsets, on, "inner").withColumn(name, F.col("__w") + F.col("__off")).drop("__h", "__b", "__v", "__w", "__off", "__ob", *[f"__p{i}" for i in range(len(part))])
