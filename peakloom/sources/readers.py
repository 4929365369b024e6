"""Readers of tables, delimited text, line text and record files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None, limit: int | None = None, row_index: bool = False) -> DataFrame:
    """Parquet files, folders or globs, with columns and filter pushed down; ``row_index`` adds each row's number in its file."""
    df = spark.read.parquet(path)
    if row_index:
        df = df.select("*", F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_name").alias("file_name"))
    if where:
        df = df.where(where)
    if columns:
        df = df.select(*columns, *(["row_index", "file_name"] if row_index else []))
    return df.limit(limit) if limit is not None else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", header: bool = True, quote: str | None = '"') -> DataFrame:
    """Delimited text, plain or compressed; the schema is given or inferred."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", quote or "")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_dirty(spark: SparkSession, path: str, columns: Sequence[str], casts: dict[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """Delimited text with short, long and unreadable lines: missing fields are null, surplus ones dropped, bad numbers null."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    parts = lines.select(F.split("value", sep.replace("|", r"\|")).alias("p"))
    out = parts.select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])
    for c, kind in (casts or {}).items():
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` as {kind})"))
    return out


def read_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(key, value) of each line, split at the first separator; lines without one are left out."""
    v = F.col("value")
    return spark.read.text(path).where(v.contains(sep)).select(F.substring_index(v, sep, 1).alias("key"), F.expr(f"substring(value, instr(value, '{sep}') + 1)").alias("value"))


def read_sdf(spark: SparkSession, path: str, tags: Sequence[str]) -> DataFrame:
    """Records of a structure-data file: (title, block, one column for each tag). Records end with a line of four dollars."""
    text = spark.read.option("lineSep", "$$$$\n").text(path).where(F.length(F.trim("value")) > 0)
    v = F.col("value")
    cols = [F.nullif(F.regexp_extract(v, rf"(?m)^> *<{t}>[^\n]*\n([^\n]*)", 1), F.lit("")).alias(t) for t in tags]
    return text.select(F.substring_index(v, "\n", 1).alias("title"), F.regexp_extract(v, r"(?s)^(.*?M  END)", 1).alias("block"), *cols)


def read_archive_records(spark: SparkSession, path: str, sep: bytes = b"$$$$\n", chunk: int = 1 << 20) -> DataFrame:
    """(file, position, record) of gz files and zip members, read in bounded chunks; a file is one task's work."""

    def run(batches):
        import gzip
        import io
        import zipfile

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                streams = []
                if name.endswith(".zip"):
                    z = zipfile.ZipFile(io.BytesIO(content))
                    streams = [z.open(n) for n in z.namelist()]
                else:
                    streams = [gzip.open(io.BytesIO(content)) if name.endswith(".gz") else io.BytesIO(content)]
                n, out = 0, []
                for s in streams:
                    rest = b""
                    while block := s.read(chunk):
                        *done, rest = (rest + block).split(sep)
                        for r in done:
                            out.append((name, n, r.decode("utf-8", "replace")))
                            n += 1
                        if out:
                            yield pd.DataFrame(out, columns=["file", "position", "record"])
                            out = []
                    if rest.strip():
                        out.append((name, n, rest.decode("utf-8", "replace")))
                        n += 1
                if out:
                    yield pd.DataFrame(out, columns=["file", "position", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, position bigint, record string")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL text over frames registered under the given names; named parameters as :name."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, view: str | None = None) -> DataFrame:
    df = spark.createDataFrame(pdf)
    if view:
        df.createOrReplaceTempView(view)
    return df


def locate(spark: SparkSession, pattern: str, unique: bool = False) -> str:
    """The path that a glob finds: the shortest one (then the first in order), or with ``unique`` the only one; an error otherwise."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted((f.getPath().toString() for f in found), key=lambda p: (len(p), p))
    if not paths or unique and len(paths) > 1:
        raise FileNotFoundError(f"{len(paths)} paths match {pattern}")
    return paths[0]
