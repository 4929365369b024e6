"""Bit fingerprints as arrays of 32-bit words, and scores on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(fp: str | Column, size: int = 128) -> Column:
    """The bytes as ``size``/4 unsigned words (bigint), the first bit highest; null for another length."""
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.when(F.length(c) == size, F.array(*[F.conv(F.hex(F.substring(c, 4 * i + 1, 4)), 16, 10).cast("bigint") for i in range(size // 4)]))


def ones(w: Column | str) -> Column:
    return F.aggregate(F.col(w) if isinstance(w, str) else w, F.lit(0), lambda a, x: a + F.bit_count(x))


def common(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def tanimoto(a: str, b: str) -> Column:
    """Common bits divided by bits in either; 0 where neither has any."""
    c = common(a, b)
    return F.coalesce(F.try_divide(c, ones(a) + ones(b) - c), F.lit(0.0))


def bits(w: str, size: int = 1024) -> Column:
    """0/1 list of all bits."""
    return F.flatten(F.transform(w, lambda x: F.transform(F.sequence(F.lit(31), F.lit(0)), lambda k: F.getbit(x, k).cast("int"))))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def bernoulli(b: str, p: str, low: float = 0.01, high: float = 0.99) -> Column:
    """Log-likelihood of 0/1 bits under clipped probabilities."""
    def term(x, q):
        q = F.least(F.greatest(q.cast("double"), F.lit(low)), F.lit(high))
        return F.when(x == 1, F.ln(q)).otherwise(F.ln(1 - q))

    return F.aggregate(F.zip_with(b, p, term), F.lit(0.0), lambda s, x: s + x)


def vote(neighbours: DataFrame, query: str, sim: str, bit_list: str) -> DataFrame:
    """(query, bit, p): weighted mean of the neighbours' bits, weights max(sim, 0) + 1e-6."""
    w = F.greatest(F.col(sim), F.lit(0.0)) + 1e-6
    b = neighbours.select(query, w.alias("w"), F.posexplode(bit_list).alias("bit", "x"))
    return b.groupBy(query, "bit").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("p"))


def propagate(cands: DataFrame, analogs: DataFrame, mid: str, key: str, power: float = 4.0) -> DataFrame:
    """(mid, key, best, total, mean): of Tanimoto * sim^power over the analogs of each candidate's query. Both sides have fp words ``w``."""
    pairs = cands.select(mid, key, F.col("w").alias("wc")).join(analogs.select(mid, F.col("w").alias("wa"), "sim"), mid)
    s = pairs.withColumn("s", tanimoto("wc", "wa") * F.pow(F.col("sim"), power))
    return s.groupBy(mid, key).agg(F.max("s").alias("best"), F.sum("s").alias("total"), F.avg("s").alias("mean"))
