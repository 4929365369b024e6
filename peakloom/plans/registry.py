"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakloom.session import table


class Tables:
    """Tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.plans: dict[str, Callable[[Tables], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            if name in self.plans:
                raise ValueError(f"two queries named {name}")
            self.plans[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {k: (lambda s, d, f=f: f(Tables(s, d))) for k, f in self.plans.items()}

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
