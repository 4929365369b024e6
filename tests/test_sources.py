import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from peakloom.sources import readers as S
from peakloom.sources import writers as W
from peakloom.streaming import events as E


def test_delimited_text(spark, tmp_path):
    p = tmp_path / "a.tsv.gz"
    p.write_bytes(gzip.compress(b'1\tC"C\t3.5\n2\tO\t4\n'))
    rows = S.read_csv(spark, str(p), "cid int, smiles string, mass double", "\t", False, None).orderBy("cid").collect()
    assert [tuple(r) for r in rows] == [(1, 'C"C', 3.5), (2, "O", 4.0)]
    (tmp_path / "b.csv").write_text("id,x\n1,2.5\n2,3.5\n")
    assert dict(S.read_csv(spark, str(tmp_path / "b.csv")).dtypes)["x"] == "double"


def test_dirty_text(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("1\ta\t5\n2\n3\tb\tnot a number\textra\n\n")
    got = [tuple(r) for r in S.read_dirty(spark, str(tmp_path / "d.tsv"), ["id", "name", "n"], {"id": "int", "n": "int"}).orderBy("id").collect()]
    assert got == [(1, "a", 5), (2, None, None), (3, "b", None)]
    (tmp_path / "k.txt").write_text("a\tb\tc\nnone\n")
    assert [tuple(r) for r in S.read_pairs(spark, str(tmp_path / "k.txt")).collect()] == [("a", "b\tc")]


SDF = "one\n x\n\n  0  0\nM  END\n> <ID>\n7\n\n> <NAME>\nfoo\n\n$$$$\ntwo\n\n\nM  END\n> <ID>\n8\n\n$$$$\n"


def test_record_files(spark, tmp_path):
    (tmp_path / "r.sdf").write_text(SDF)
    got = [(r.title, r.ID, r.NAME) for r in S.read_sdf(spark, str(tmp_path / "r.sdf"), ["ID", "NAME"]).orderBy("ID").collect()]
    assert got == [("one", "7", "foo"), ("two", "8", None)]
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.gz").write_bytes(gzip.compress(SDF.encode()))
    with zipfile.ZipFile(box / "b.zip", "w") as z:
        z.writestr("m.sdf", SDF)
    assert S.read_archive_records(spark, str(box), chunk=10).count() == 4


def test_parquet_round_trips(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("b"), F.rand(1).alias("mass"))
    W.write_sorted(df, str(tmp_path / "s"), ["mass", "id"], 3)
    back = S.read_parquet(spark, str(tmp_path / "s"), ["id"], "mass < 0.5", row_index=True)
    assert back.count() == df.where("mass < 0.5").count() and "row_index" in back.columns
    W.write_partitioned(df, str(tmp_path / "p"), ["b"], ["mass"])
    assert len(list((tmp_path / "p").glob("b=*"))) == 7 and S.read_parquet(spark, str(tmp_path / "p" / "b=*")).count() == 1000
    W.filtered_copy(df, spark.createDataFrame([(1,), (None,), (5,)], "id bigint"), "id", str(tmp_path / "f"), ["id"])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 998
    W.write_json(df.limit(3), str(tmp_path / "j"))
    W.write_json(df.limit(2), str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    W.write_submission(spark.createDataFrame([("m1", "a;b")], "mid string, entries string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().entries == "a;b"


def test_query_with_arguments(spark):
    import pandas as pd

    df = S.from_pandas(spark, pd.DataFrame({"a": [1, 2, 3]}))
    assert S.query(spark, "select count(*) n from t where a >= :least", {"t": df}, least=2).first().n == 2


def test_streams_equal_batches(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    s = E.windowed_counts(E.read_events(spark, str(tmp_path / "in"), src.schema, 2), "1 day", "10000 days")
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, E.windowed_counts(src).collect()))
    assert sorted(map(tuple, spark.table("daily").collect())) == want
    b = E.running_best(E.read_events(spark, str(tmp_path / "in"), src.schema, 2).withColumn("user_id", F.col("user_id").cast("bigint")).select("user_id", "value"))
    q = b.writeStream.format("memory").queryName("best").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("best").groupBy("user_id").agg(F.max("best").alias("best"), F.max("seen").alias("seen"))
    want = src.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.max("value").alias("best"), F.count("*").alias("seen"))
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def test_cut_tables_can_be_released(spark):
    import glob

    from peakloom.session import cut, few, release

    df = cut(spark.range(5), "gone")
    assert df.count() == 5 and glob.glob(df.cut_path.removeprefix("file://"))
    release(df)
    assert not glob.glob(df.cut_path.removeprefix("file://"))
    assert len(few(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError):
        few(spark.range(4), 3, "rows")


def test_lookups_read_only_their_buckets(spark, tmp_path):
    df = spark.range(500).selectExpr("cast(id as string) as k", "id * 2 as n").union(spark.createDataFrame([(None, 1)], "k string, n bigint"))
    W.write_lookup(df, f"{tmp_path}/t", "k", 8)
    got = W.lookup(spark, f"{tmp_path}/t", "k", ["7", "123", "none"], 8)
    assert sorted(map(tuple, got.collect())) == [("123", 246), ("7", 14)]
    assert "PartitionFilters: [__bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_locating_inputs(spark, tmp_path):
    for name in ("a/long/x.csv", "b/x.csv", "c/y.csv"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("1")
    assert S.locate(spark, f"{tmp_path}/*/x.csv").endswith("/b/x.csv") and S.locate(spark, f"{tmp_path}/{{a/long,b}}/x.csv").endswith("/b/x.csv")
    with pytest.raises(FileNotFoundError):
        S.locate(spark, f"{tmp_path}/*/*.csv", unique=True)
    with pytest.raises(FileNotFoundError):
        S.locate(spark, f"{tmp_path}/*.none")
