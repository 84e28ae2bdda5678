"""File order, ranks, length grouping and the text loader on odd files and rows."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.sources import datasets as S
from seqloom.sources.readers import READERS


def test_file_order_does_not_move_with_splits(spark, tmp_path):
    """Large files come first in Spark's own order; the number of a row stays its place through the files."""
    for k, (low, high) in enumerate([(0, 10), (10, 5000), (5000, 5001), (5001, 5001)]):
        spark.range(low, high).coalesce(1).write.parquet(f"{tmp_path}/d/part={k}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = S.in_file_order(spark.read.parquet(f"{tmp_path}/d"))
            assert rows.where("ord <> id").count() == 0 and rows.count() == 5001
            assert sorted(r["id"] for r in S.head(rows, 5).collect()) == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_order_of_lines(spark, tmp_path):
    """Formats without a row index are counted block by block."""
    spark.range(3000).select(F.concat(F.lit("line "), "id").alias("value")).coalesce(1).write.text(f"{tmp_path}/t.txt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = S.in_file_order(S.read_auto(spark, f"{tmp_path}/t.txt"))
            assert sorted((r["ord"], r["value"]) for r in rows.collect()) == [(k, f"line {k}") for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_schemas_are_declared_or_those_of_the_first_file(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x long, y string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/c.csv")
    assert S.read_auto(spark, f"{tmp_path}/c.csv").dtypes == [("x", "int"), ("y", "string")]
    assert S.read_auto(spark, f"{tmp_path}/c.csv", schema="x string, y string").first() == ("1", "a")


def test_ranks_with_a_hot_value(spark):
    rng = random.Random(4)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(20), k) for k in range(600)] + [(None, 1), (7, 5), (7, 5), (None, None)]
    df = spark.createDataFrame(rows, "x long, k long").repartition(5)
    got = S.ranked(df, ["x", "k"]).collect()
    assert sorted(r["place"] for r in got) == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    assert [(r["x"], r["k"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert S.ranked(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 50, 300])
def test_length_grouping(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([5, 5, 9, 30, rng.randrange(100)])) for k in range(n)]
    got = S.length_grouped(spark.createDataFrame(rows, "k long, n long"), "n", "k", 4, 1).collect()
    assert sorted(r["place"] for r in got) == list(range(n))
    size = 4 * max(1, min(50, n // 16))
    by = [r["n"] for r in sorted(got, key=lambda r: r["place"])]
    if n:
        assert by[0] == max(x for _, x in rows)
        for k in range(size, n, size):
            assert by[k + 1 : k + size] == sorted(by[k + 1 : k + size], reverse=True)


def test_a_large_cut_of_a_stream_is_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 10)
    rows = S.with_split(spark.range(500).select((F.col("id") * 37 % 500).alias("ord")))
    got = {r["ord"]: r["split"] for r in S.limit_stream_splits(rows, {"train": 200, "test": 90}).collect()}
    assert got == {k: "test" if k < 90 else "train" for k in range(290)}


def test_texts_need_no_reader(spark, tmp_path):
    spark.range(9).select(F.col("id").cast("string").alias("value")).coalesce(1).write.text(f"{tmp_path}/a.txt")
    spark.range(4).select(F.col("id").alias("x")).coalesce(1).write.parquet(f"{tmp_path}/b/own")
    out = S.load_texts(spark, f"{tmp_path}/a.txt[train:3,test:2] | {tmp_path}/b[name:own]", READERS).collect()
    assert sorted((r["value"], r["split"]) for r in out if r["value"]) == [("0", "test"), ("1", "test"), ("2", "train"), ("3", "train"), ("4", "train")]
    assert sorted(r["x"] for r in out if r["x"] is not None) == [0, 1, 2, 3]
