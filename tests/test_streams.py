"""Streams over restarts: endless epochs, shuffle buffers, counted rows and meters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.rng import draw
from seqloom.streaming import epochs as E
from seqloom.streaming import pipelines as R

SCHEMA = "id long, name string, epoch long, ord long, stream_ord long"


@pytest.fixture
def saved(spark, tmp_path):
    """Files of 1, 40, 2 and 7 rows, in order; names may be null."""
    parts, at = [], 0
    for n in (1, 40, 2, 7):
        rows = [(at + k, None if (at + k) % 5 == 0 else f"n{at + k}") for k in range(n)]
        parts.append(spark.createDataFrame(rows, "id long, name string").coalesce(1))
        at += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.parquet(f"{tmp_path}/in")
    return tmp_path


def read(spark, root, schema):
    return [tuple(r) for r in spark.read.schema(schema).parquet(f"{root}/out").orderBy("stream_ord").collect()]


def test_epochs_go_on_after_restarts(spark, saved):
    """Steps that do not divide the table; after a crash between the position and Spark's log nothing is lost or doubled."""
    for run in range(6):
        R.drain(E.repeat(spark, f"{saved}/in", SCHEMA, f"{saved}/pos/at", 37, None, 10), f"{saved}/out", f"{saved}/log")
        if run == 2:
            at = json.load(open(f"{saved}/pos/at"))
            with open(f"{saved}/pos/at", "w") as file:  # told, but never logged by Spark
                json.dump(E.EpochReader({"path": f"{saved}/in", "position": f"{saved}/pos/at", "rows": "11"}, None)._ahead(at, 11), file)
    got = read(spark, saved, SCHEMA)
    n = 6 * 37 + 11
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(k % 50, k // 50, k % 50, k) for k in range(n)]
    assert all(r[1] == (None if r[0] % 5 == 0 else f"n{r[0]}") for r in got)


def test_epochs_may_end(spark, saved):
    for _ in range(4):
        R.drain(E.repeat(spark, f"{saved}/in", SCHEMA, f"{saved}/pos/at", 49, 2), f"{saved}/out", f"{saved}/log")
    assert [r[4] for r in read(spark, saved, SCHEMA)] == list(range(100))
    reader = E.EpochReader({"path": f"{saved}/none", "position": f"{saved}/p", "rows": "5"}, None)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), {"epoch": 3, "file": 0, "row": 0}) == []
    with pytest.raises(ValueError, match="mounted"):
        E.local("hdfs://x/y")
    with pytest.raises(ValueError, match="at least 1"):
        E.EpochReader({"path": "/x", "position": "/y", "rows": "0"}, None)


def plain_buffer(rows, key, size, seed):
    held, out = [], []
    for n, row in enumerate(rows):
        if len(held) < size:
            held.append(row)
            continue
        slot = int(draw(f"{key}/{n}", seed) * size)
        out.append(held[slot])
        held[slot] = row
    return out + [held[i] for i in sorted(range(len(held)), key=lambda i: draw(f"{key}/end/{i}", seed))]


def test_a_shuffle_buffer_puts_out_as_a_plain_one(spark, saved):
    """Over several runs; one key with less than a buffer of rows, null values."""
    schema = "id long, name string, stream_ord long"
    for _ in range(4):
        rows = E.repeat(spark, f"{saved}/in", schema, f"{saved}/pos/at", 31, 2).withColumn("k", F.when(F.col("id") < 2, "few").otherwise("many"))
        R.drain(R.shuffle_buffer(rows, "k", "stream_ord", 8, 3), f"{saved}/out", f"{saved}/log")
    kinds = f"{schema}, k string"
    out = spark.read.schema(f"{kinds}, turn long").parquet(f"{saved}/out").unionByName(R.buffered_rest(spark, f"{saved}/log", kinds, "k", 8, 3)).collect()
    stream = [(k % 50, k) for k in range(100)]
    for key, own in (("few", [r for r in stream if r[0] < 2]), ("many", [r for r in stream if r[0] >= 2])):
        got = sorted((r["turn"], (r["id"], r["stream_ord"])) for r in out if r["k"] == key)
        assert got == [*enumerate(plain_buffer(own, key, 8, 3))]
    assert all(r["name"] == (None if r["id"] % 5 == 0 else f"n{r['id']}") for r in out)


def test_counts_go_on_over_batches_and_keys(spark, saved):
    with R.rocksdb(spark):
        for _ in range(3):
            rows = E.repeat(spark, f"{saved}/in", SCHEMA, f"{saved}/pos/at", 40, 2).withColumn("k", F.col("id") % 2)
            R.drain(R.skip_take_stream(rows, 5, 20, "stream_ord", "k"), f"{saved}/out", f"{saved}/log")
    got = spark.read.schema(f"{SCHEMA}, k long").parquet(f"{saved}/out").collect()
    for k in (0, 1):
        assert sorted(r["stream_ord"] for r in got if r["k"] == k) == [x for x in range(100) if x % 50 % 2 == k][5:25]
    assert spark.conf.get(R.ROCKSDB[0]) != R.ROCKSDB[1]


def test_a_meter_goes_on_and_can_be_reset(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice(["train", "eval"]), rng.random(), float(k % 3)) for k in range(60)] + [(60, "none", 5.0, 0.0)]
    spark.createDataFrame(rows, "id long, split string, value double, weight double").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(3):
        losses = E.repeat(spark, f"{tmp_path}/in", "split string, value double, weight double", f"{tmp_path}/pos/at", 25, 1)
        R.meter(losses, f"{tmp_path}/meter", f"{tmp_path}/log")

    def want(some):
        out = {}
        for split in {r[1] for r in some}:
            total, weight = sum(r[2] * r[3] for r in some if r[1] == split), sum(r[3] for r in some if r[1] == split)
            out[split] = round(total / weight, 9) if weight else 0.0
        return out

    assert {r["split"]: round(r["nll"], 9) for r in R.metered(spark, f"{tmp_path}/meter").collect()} == want(rows)
    assert {r["split"]: round(r["nll"], 9) for r in R.metered(spark, f"{tmp_path}/meter", since=1).collect()} == want(rows[25:])


def test_parts_read_their_row_groups_only(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import types as T

    pq.write_table(pa.table({"id": list(range(100))}), f"{tmp_path}/a.parquet", row_group_size=7)
    reader = E.EpochReader({"path": str(tmp_path), "position": f"{tmp_path}/p/at", "rows": "5"}, T.StructType.fromDDL("id long, ord long"))
    assert reader.rows == [100] and json.load(open(f"{tmp_path}/p/at.rows")) == {f"{tmp_path}/a.parquet": 100}
    for low, high in ((0, 1), (6, 8), (7, 14), (13, 40), (98, 100), (0, 100)):
        got = [r for b in reader.read(E.Part(0, reader.files[0], low, high, 1000, 5000)) for r in b.to_pylist()]
        assert got == [{"id": k, "ord": 1000 + k} for k in range(low, high)]
