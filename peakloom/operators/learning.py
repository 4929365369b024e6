"""Boundaries to models: learned rankers, vector views, padding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ranker_scores(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, kind: str = "logistic", weight: str | None = None) -> DataFrame:
    """``df`` with ``score``: the probability of the label by a model fitted on the other folds. kind: logistic or trees."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(df)
    out = None
    for k in range(folds):
        if kind == "trees":
            m = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=10, maxDepth=3, seed=1)
        else:
            m = LogisticRegression(featuresCol="__x", labelCol=label, maxIter=30)
        m = (m.setWeightCol(weight) if weight else m).fit(rows.where(F.col(fold) != k))
        part = m.transform(rows.where(F.col(fold) == k)).select(*df.columns, F.element_at(vector_to_array("probability"), 2).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def class_weights(df: DataFrame, label: str, name: str = "w") -> DataFrame:
    """A weight that makes both classes count alike."""
    w = Window.partitionBy(F.lit(1))
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    n = n.withColumn(name, F.sum("__n").over(w) / (F.count("*").over(w) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(n), label)  # one row a class


def with_model(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]], name: str = "logits") -> DataFrame:
    """``df`` with a vector for each value, by a model that each Python worker loads once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches):
        model = load()
        for s in batches:
            yield pd.Series([[float(x) for x in v] for v in model(list(s))])

    return df.withColumn(name, run(column))


def mean_views(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the mean of a group's vectors, element by element."""
    long = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))


def blend(df: DataFrame, a: str, b: str, wa: float, name: str) -> DataFrame:
    return df.withColumn(name, F.zip_with(a, b, lambda x, y: wa * x + (1 - wa) * y))


def pad_lists(df: DataFrame, column: str, n: int, fill: float = 0.0) -> DataFrame:
    """Lists of exactly n values, and ``mask`` with 1 where a value is real."""
    size = F.least(F.size(column), F.lit(n))
    zeros = lambda v: F.transform(F.sequence(F.lit(1), F.lit(n)), v)
    return df.withColumn("mask", zeros(lambda i: (i <= size).cast("int"))).withColumn(column, zeros(lambda i: F.coalesce(F.get(F.col(column), i - 1), F.lit(fill))))
