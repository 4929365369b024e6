"""Replacement rules between fragments: mining, application and budgeted expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.joins import range_join


def mine_rules(cuts: DataFrame, least: int = 3) -> DataFrame:
    """(v1, v2, env, delta, pairs, consts): replacements of a part by another one, v1 < v2, that at least ``least`` pairs of structures support.

    ``cuts`` has (id, const, var, env, mass). A pair are two structures with the same constant part that differ in the variable
    one. Structures are counted for each (constant, variable) first, and pairs are products of these counts; so no pair of
    structures is ever formed, and a constant of any number of structures counts in full.
    """
    n = cuts.groupBy("const", "env", "var").agg(F.count_distinct("id").alias("n"), F.min("mass").alias("mass"))
    a = n.select("const", "env", F.col("var").alias("v1"), F.col("n").alias("n1"), F.col("mass").alias("m1"))
    b = n.select("const", "env", F.col("var").alias("v2"), F.col("n").alias("n2"), F.col("mass").alias("m2"))
    met = a.join(b, ["const", "env"]).where("v1 < v2")
    found = met.groupBy("v1", "v2", "env").agg(F.round(F.min(F.col("m2") - F.col("m1")), 5).alias("delta"), F.sum(F.col("n1") * F.col("n2")).alias("pairs"), F.count("*").alias("consts"))
    return found.where(F.col("pairs") >= least)


def both_ways(rules: DataFrame) -> DataFrame:
    """(old, new, env, delta, pairs, prior): each rule forwards and backwards; prior is its share of the pairs that replace the same part."""
    back = rules.select(F.col("v2").alias("old"), F.col("v1").alias("new"), "env", (-F.col("delta")).alias("delta"), "pairs")
    all_ = rules.select(F.col("v1").alias("old"), F.col("v2").alias("new"), "env", "delta", "pairs").union(back)
    return all_.withColumn("prior", F.col("pairs") / F.sum("pairs").over(Window.partitionBy("old", "env")))


def apply_rules(cuts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, const, new, env, delta, prior): the products of every rule that fits a cut of a structure."""
    r = both_ways(rules)
    return cuts.select("id", "const", F.col("var").alias("old"), "env").join(r, ["old", "env"]).groupBy("id", "const", "new", "env").agg(F.max("delta").alias("delta"), F.max("prior").alias("prior"))


def expand(products: DataFrame, masses: DataFrame, targets: DataFrame, budget: int = 32, da: float = 0.005, top: int = 5) -> DataFrame:
    """(id, target, steps, prior, rank): targets whose mass one or two replacements reach from a structure's, the likeliest first.

    ``products`` as of ``apply_rules``; masses (id, mass); targets (target, mass). Of a structure's first steps the ``budget``
    likeliest mass differences are expanded (a bounded search is the operator), two steps being two of them at the product of
    their priors. Mass comes first: only differences that reach a target's mass go on. The best ``top`` of each structure come out.
    """
    step = products.groupBy("id", F.round("delta", 4).alias("delta")).agg(F.max("prior").alias("prior"))
    likely = Window.partitionBy("id").orderBy(F.desc("prior"), "delta")
    first = step.withColumn("r", F.row_number().over(likely)).where(F.col("r") <= budget)
    two = first.alias("a").join(first.alias("b"), "id").where("a.r <= b.r").select("id", (F.col("a.delta") + F.col("b.delta")).alias("delta"), (F.col("a.prior") * F.col("b.prior")).alias("prior"), F.lit(2).alias("steps"))
    paths = first.select("id", "delta", "prior", F.lit(1).alias("steps")).union(two).groupBy("id", F.round("delta", 4).alias("delta")).agg(F.max(F.struct("prior", (-F.col("steps")).alias("less"))).alias("p"))
    wanted = paths.join(masses, "id").select("id", F.col("p.prior").alias("prior"), (-F.col("p.less")).alias("steps"), (F.col("mass") + F.col("delta") - da).alias("lo"), (F.col("mass") + F.col("delta") + da).alias("hi"))
    hit = range_join(wanted, targets.select("target", F.col("mass").alias("reached")), "lo", "hi", "reached", 4 * da).where("id <> target")
    best = hit.groupBy("id", "target").agg(F.max(F.struct("prior", (-F.col("steps")).alias("less"))).alias("p")).select("id", "target", (-F.col("p.less")).alias("steps"), F.col("p.prior").alias("prior"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("prior", 9)), "target")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
