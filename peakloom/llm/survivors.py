"""Best representative of each duplicate group: rank records by trust and recency, keep the first of each need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.keys import SPACE, structure_key

#: Words for "nothing known" (fixed values).
NOTHING = ("", "*", "n/a", "na", "null", "none", "nan", "unknown", "-", "?")
MASS_MAX = 5000.0


def usable_text(c: str) -> Column:
    bare = F.lower(F.regexp_replace(F.col(c), rf"^{SPACE}|{SPACE}$", ""))
    return F.coalesce(~bare.isin(*NOTHING), F.lit(False))


def usable_mass(c: str) -> Column:
    return F.coalesce((F.col(c) > 0) & (F.col(c) < MASS_MAX), F.lit(False))


def survivors(rows: DataFrame, key: Column | None = None, salts: int = 16) -> DataFrame:
    """One row per key with two or more different cids: (ik, cid, smiles_cid, mass_cid, smiles, mass, n_rows).

    Order within a key: trust from high to low (null last), updated_at from late to early (null last), smaller cid (null
    last), then text, so that repeated rows and ties give the same result in any run. Of each key, four rows matter: the
    first, the first with a usable smiles, with a usable mass, with both. They are found by windows over (key, salt), then
    over the few rows that are left of a key, so that a key with a third of all rows is spread over ``salts`` tasks.
    Rows without a key are left out; an empty table gives an empty result; no usable value gives null.
    """
    base = rows.select(
        (structure_key("ik") if key is None else key).alias("ik"),
        F.col("cid").alias("cid"), F.col("smiles").alias("smiles"), F.col("mass").alias("mass"), F.col("trust").alias("trust"), F.col("updated_at").alias("updated_at"),
        usable_text("smiles").alias("ok_s"), usable_mass("mass").alias("ok_m"),
    ).where(F.col("ik").isNotNull())
    order = [F.col("trust").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("cid").asc_nulls_last(), F.col("smiles").asc_nulls_last(), F.col("mass").asc_nulls_last()]

    def firsts(df: DataFrame, part: list[str]) -> DataFrame:
        """The rows that are first of their part for any need, with the counts and cid range of the part."""
        whole = Window.partitionBy(*part)
        ranked = df
        for name, need in (("r_any", None), ("r_s", "ok_s"), ("r_m", "ok_m"), ("r_both", "ok_b")):
            w = (whole if need is None else Window.partitionBy(*part, need)).orderBy(*order)
            ranked = ranked.withColumn(name, F.row_number().over(w))
        ranked = ranked.withColumn("n", F.sum("n").over(whole)).withColumn("lo", F.min("lo").over(whole)).withColumn("hi", F.max("hi").over(whole))
        best = (F.col("r_any") == 1) | (F.col("ok_s") & (F.col("r_s") == 1)) | (F.col("ok_m") & (F.col("r_m") == 1)) | (F.col("ok_b") & (F.col("r_both") == 1))
        return ranked.where(best)

    # equal rows become one with a count before any window, so copies can't fill a salt
    once = base.groupBy(*base.columns).agg(F.count("*").alias("n"))
    start = once.withColumns({"ok_b": F.col("ok_s") & F.col("ok_m"), "lo": F.col("cid"), "hi": F.col("cid"), "salt": F.pmod(F.xxhash64("cid", "updated_at", "smiles", "mass", "trust"), F.lit(salts)).cast("int")})
    local = firsts(start, ["ik", "salt"]).drop("salt")
    # the counts of a salt stand on each of its kept rows; only its first row may carry them on
    local = local.withColumn("n", F.when(F.col("r_any") == 1, F.col("n")).otherwise(0)).drop("r_any", "r_s", "r_m", "r_both")
    top = firsts(local, ["ik"])
    pick = lambda c, r, ok=None: F.max(F.when((F.col(r) == 1) & (F.col(ok) if ok else F.lit(True)), F.col(c)))
    return (
        top.groupBy("ik")
        .agg(
            F.coalesce(pick("cid", "r_both", "ok_b"), pick("cid", "r_any")).alias("cid"),
            pick("cid", "r_s", "ok_s").alias("smiles_cid"), pick("cid", "r_m", "ok_m").alias("mass_cid"),
            pick("smiles", "r_s", "ok_s").alias("smiles"), pick("mass", "r_m", "ok_m").alias("mass"),
            F.max("n").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        .where(F.col("lo") < F.col("hi")).drop("lo", "hi")
    )
