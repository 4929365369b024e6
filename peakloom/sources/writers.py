"""Sinks. All commit through Spark's protocol: readers see a finished result or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, by: Sequence[str], files: int | None = None, compression: str = "zstd", row_group: int = 64 << 20) -> None:
    """Range-partitioned and sorted Parquet: files don't overlap in the sort key, so filters on it skip files and row groups."""
    cols = [F.col(c) for c in by]
    out = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    out.sortWithinPartitions(*cols).write.mode("overwrite").option("compression", compression).option("parquet.block.size", row_group).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), max_rows: int = 5_000_000) -> None:
    """Hive-style folders; a hot value is split into files of ``max_rows``, rows sorted within."""
    df.sortWithinPartitions(*by, *sort).write.mode("overwrite").partitionBy(*by).option("maxRecordsPerFile", max_rows).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A lookup table bucketed and sorted by its key: joins on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_submission(df: DataFrame, path: str, ident: str = "mid", entries: str = "entries") -> None:
    """CSV of (id, joined entries), in order of the id, for each part."""
    df.select(ident, entries).repartitionByRange(ident).sortWithinPartitions(ident).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; mode append adds records."""
    df.write.mode(mode).json(path)


def filtered_copy(df: DataFrame, drop: DataFrame, key: str, path: str, order: Sequence[str]) -> None:
    """The rows whose key isn't in ``drop``, in their order."""
    write_sorted(df.join(drop.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns), path, order)


def write_lookup(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A key-to-values table in folders by a hash of the key, sorted by it: ``lookup`` reads only the folders and row groups of its keys."""
    out = df.where(F.col(key).isNotNull()).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", key).write.mode("overwrite").partitionBy("__bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, wanted: Sequence, buckets: int = 64) -> DataFrame:
    """The rows of ``write_lookup``'s table whose key is one of a few ``wanted``."""
    keys = spark.createDataFrame([(k,) for k in wanted], spark.read.parquet(path).select(key).schema)
    places = [r[0] for r in keys.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("__bucket").isin(places) & F.col(key).isin(list(wanted))).drop("__bucket")
