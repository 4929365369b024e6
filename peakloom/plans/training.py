"""Queries of general operators over the spectra, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.skew import tree_aggregate
from peakloom.session import table

FIELDS = ("inchikey14", "instrument_type")


def values_of(df: DataFrame, *more: str) -> DataFrame:
    """One row for each record and field: (field, value, ...)."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("x"), *more).select("x.field", "x.value", *more)


def large_values(df: DataFrame, share: float = 1 / 40) -> DataFrame:
    """(field, value) of the stored values that hold at least ``share`` of the rows; nulls count as rows, not as values.

    The number of rows comes from the files' footers, so the table is read once.
    """
    counts = tree_aggregate(values_of(df), ["field", "value"], {"n": (F.lit(1), "sum")})
    return counts.where((F.col("n") >= df.count() * share) & F.col("value").isNotNull()).select("field", "value")


def list_hash(seed: int, *cols: str) -> Column:
    """A hash of list columns; null elements count too, which a plain hash skips."""
    holes = functools.reduce(lambda a, b: a | b, [F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(True)) for c in cols])
    return F.when(holes, F.xxhash64(F.lit(seed), F.to_json(F.struct(*cols)))).otherwise(F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.size(c), F.col(c))]))


def per_key(df: DataFrame) -> DataFrame:
    """(field, value, n_records, n_spectra, n_peaks, n_adducts) of every value, null included.

    n_spectra counts different peak lists, n_adducts different adducts. Distinct counts go through the same tree: a record
    gives one state for its adduct and one for its peak list (hashes of 128 bits), and equal ones merge on the way. The table
    is read once.
    """
    lists = ("ms2_mzs", "ms2_normalized_intensities")
    items = [
        F.struct(F.lit("adduct").alias("kind"), *[F.when(F.col("adduct").isNotNull(), F.xxhash64(F.lit(s), "adduct")).alias(f"h{s}") for s in (1, 2)], F.lit(1).alias("n"), F.greatest(F.coalesce(F.size("ms2_mzs"), F.lit(0)), F.lit(0)).cast("bigint").alias("p")),
        F.struct(F.lit("spectrum").alias("kind"), *[F.when(F.col("ms2_mzs").isNotNull(), F.col(f"s{s}")).alias(f"h{s}") for s in (1, 2)], F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("p")),
    ]
    rows = df.select(*FIELDS, "adduct", *lists).withColumns({f"s{s}": list_hash(s, *lists) for s in (1, 2)})
    rows = rows.select(*FIELDS, F.explode(F.array(*items)).alias("x")).select(*FIELDS, "x.*")
    states = tree_aggregate(values_of(rows, "kind", "h1", "h2", "n", "p"), ["field", "value", "kind", "h1", "h2"], {"n_": (F.col("n"), "sum"), "p_": (F.col("p"), "sum")})
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("h1").isNotNull())
    return states.groupBy("field", "value").agg(F.sum("n_").alias("n_records"), of("spectrum").alias("n_spectra"), F.sum("p_").alias("n_peaks"), of("adduct").alias("n_adducts"))


def queries():
    t = lambda s, d: table(s, d, "train_spectra")
    return {"p5_found": lambda s, d: large_values(t(s, d)), "p5_per_key": lambda s, d: per_key(t(s, d))}


def oracle_sql() -> dict[str, str]:
    union = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, adduct, ms2_mzs, ms2_normalized_intensities FROM train_spectra" for f in FIELDS)
    return {
        "p5_found": f"WITH v AS ({union}) SELECT field, value FROM v WHERE value IS NOT NULL GROUP BY field, value HAVING count(*) * 40 >= (SELECT count(*) FROM train_spectra)",
        "p5_per_key": f"""WITH v AS ({union}) SELECT field, value, count(*) AS n_records,
            count(DISTINCT hash(ms2_mzs, ms2_normalized_intensities)) FILTER (WHERE ms2_mzs IS NOT NULL) AS n_spectra, CAST(sum(coalesce(len(ms2_mzs), 0)) AS BIGINT) AS n_peaks, count(DISTINCT adduct) AS n_adducts FROM v GROUP BY field, value""",
    }


__all__ = ["SparkSession", "large_values", "oracle_sql", "per_key", "queries"]
