"""Streaming twins: lazy scans, row-local maps and filters, and packing with a leftover carried between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.rng import draw

STATE = "ids array<int>, next_chunk long"


def scan(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files; the schema is declared, no row is read to find it."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def pack_stream(rows: DataFrame, length: int, group: str) -> DataFrame:
    """(group, chunk, input_ids) chunks of `length` ids; the ids that are left wait in the group's state for the next batch.

    rows: (group, ord, input_ids). A batch's rows of a group are packed in the order of ord. Groups spread the work:
    a stream with one hot group needs a finer group.
    """
    out = f"{group} long, chunk long, input_ids array<int>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left, chunk = state.get if state.exists else ([], 0)
        rows = pd.concat([f[["ord", "input_ids"]] for f in frames]).sort_values("ord")["input_ids"]
        flat = np.concatenate([np.asarray(left, dtype=np.int32), *[np.asarray(ids, dtype=np.int32) for ids in rows]])
        full = len(flat) // length
        yield pd.DataFrame({group: key[0], "chunk": np.arange(chunk, chunk + full), "input_ids": [*flat[: full * length].reshape(full, length)]})
        state.update((flat[full * length :].tolist(), chunk + full))

    return rows.groupBy(group).applyInPandasWithState(run, out, STATE, "append", "NoTimeout")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Runs work on every micro-batch and appends its rows to path, until no input is left. A batch that is repeated after a failure replaces its own folder."""
    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def union(streams: Sequence[DataFrame | None]) -> DataFrame:
    """One stream of several, columns by name; None is left out, nothing at all raises. `source_ord` is the stream's place."""
    kept = [s for s in streams if s is not None]
    if not kept:
        raise ValueError("nothing to unite")
    marked = [s.withColumn("source_ord", F.lit(k)) for k, s in enumerate(kept)]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def skip_take(stream: DataFrame, skip: int, take: int | None, order: str, path: str, checkpoint: str) -> None:
    """Writes the rows after the first `skip`, at most `take` (None: all), batch after batch and by order within one.

    How many rows a batch had is written beside it; a repeated batch counts only those before it.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, 0
        if number:
            seen = spark.read.schema("n long, batch long").parquet(f"{path}/seen").where(F.col("batch") < number).agg(F.sum("n")).first()[0] or 0
        lo = max(0, skip - seen)
        rows = batch.orderBy(order).offset(lo)
        (rows if take is None else rows.limit(max(0, skip + take - seen - lo))).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


BUFFER = "seen long, rows binary"


def shuffle_buffer(stream: DataFrame, key: str, order: str, size: int, seed: int | str) -> DataFrame:
    """stream's columns and `turn`: per key a buffer of `size` rows is filled, then every arrival puts out a random one and takes its place.

    Arrivals of a batch come by `order`. Which slot gives way to a key's arrival number n is floor(u size), u drawn from
    `key/n`; turn counts what a key has put out. What is in the buffers when the input ends is put out by buffered_rest.
    Keys spread the work; a key's buffer is one state of `size` rows.
    """
    kind, names = stream.schema, stream.columns
    frame = pa.schema(to_arrow_schema(kind))

    def run(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, None)
        rows = pa.ipc.open_stream(held).read_all().to_pylist() if held else []
        out = []
        for row in pa.Table.from_pandas(pd.concat(list(frames)).sort_values(order), frame, preserve_index=False).to_pylist():
            if len(rows) < size:
                rows.append(row)
            else:
                slot = int(draw(f"{own[0]}/{seen}", seed) * size)
                out.append(rows[slot] | {"turn": seen - size})
                rows[slot] = row
            seen += 1
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, frame) as writer:
            writer.write_table(pa.Table.from_pylist(rows, frame))
        state.update((seen, sink.getvalue().to_pybytes()))
        yield pa.Table.from_pylist(out, frame.append(pa.field("turn", pa.int64()))).to_pandas()

    return stream.groupBy(key).applyInPandasWithState(run, T.StructType([*kind.fields, T.StructField("turn", T.LongType())]), BUFFER, "append", "NoTimeout").select(*names, "turn")


def buffered_rest(spark: SparkSession, checkpoint: str, schema: str | T.StructType, key: str, size: int, seed: int | str) -> DataFrame:
    """What the buffers of a shuffle_buffer hold, from the state that its checkpoint keeps: schema's columns and `turn`, in a seeded order after what was put out."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    frame = pa.schema(to_arrow_schema(kind)).append(pa.field("turn", pa.int64()))
    states = spark.read.format("statestore").load(checkpoint).select("value.groupState.seen", "value.groupState.rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = pa.ipc.open_stream(held).read_all().to_pylist()
                order = sorted(range(len(rows)), key=lambda i: draw(f"{rows[0][key]}/end/{i}", seed))
                out = [rows[i] | {"turn": max(seen - size, 0) + n} for n, i in enumerate(order)]
                yield from pa.Table.from_pylist(out, frame).to_batches()

    return states.mapInArrow(run, T.StructType([*kind.fields, T.StructField("turn", T.LongType())]))


class _Counter(StatefulProcessor):
    """Lets rows number skip to skip + take - 1 of a key through."""

    def __init__(self, skip: int, take: int | None, order: str, columns: list[str], by: str | None):
        self.skip, self.end, self.order, self.columns, self.by = skip, None if take is None else skip + take, order, columns, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        self.seen.update((seen + len(frame),))
        frame = frame.assign(**{self.by: key[0]}) if self.by else frame
        yield frame[self.columns].iloc[max(self.skip - seen, 0) : None if self.end is None else max(self.end - seen, 0)]

    def close(self) -> None:
        """Nothing to let go."""


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB."""
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(ROCKSDB[0], before)


def skip_take_stream(stream: DataFrame, skip: int, take: int | None, order: str, by: str | None = None) -> DataFrame:
    """The stream without its first `skip` rows and, with take, without those behind the next `take`; a stream to go on with.

    Rows come batch after batch and by order within one. `by` counts per key; without it one count serves the whole stream, in one
    task, and the state must be kept in RocksDB. A stream with gapless positions (`stream_ord` of an endless source) needs no
    count: order = "stream_ord" is a filter.
    """
    if order == "stream_ord" and by is None:
        return stream.where((F.col(order) >= skip) & (F.lit(True) if take is None else F.col(order) < skip + take))
    keyed = stream if by else stream.withColumn("_one", F.lit(0))
    return keyed.groupBy(by or "_one").transformWithStateInPandas(_Counter(skip, take, order, stream.columns, by), stream.schema, "Append", "None")


def meter(stream: DataFrame, path: str, checkpoint: str, split: str = "split", value: str = "value", weight: str = "weight") -> None:
    """Adds each micro-batch's weighted sums per split to the table at path, one folder a batch: a batch that is repeated replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.col(split).alias("split")).agg(F.sum(F.col(value) * F.col(weight)).alias("total"), F.sum(weight).alias("weight"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def metered(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """(split, nll, ppl, weight) of a meter's batches from number `since` on (a reset is a later `since`); without any weight nll is 0."""
    rows = spark.read.schema("split string, total double, weight double, batch long").parquet(path).where(F.col("batch") >= since)
    sums = rows.groupBy("split").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    nll = F.when(F.col("weight") == 0, 0.0).otherwise(F.col("total") / F.col("weight"))
    return sums.select("split", nll.alias("nll"), F.exp(nll).alias("ppl"), "weight")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all available input and stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shuffled_batch(batch: DataFrame, key: str, seed: int, order: str = "ord", buffer: int = 10_000) -> DataFrame:
    """A micro-batch with `place`: a seeded random order within windows of `buffer` places of `order`, so that no task holds more than a window."""
    from ..functions.rng import uniform

    window = F.floor(F.col(order) / buffer)
    rank = F.row_number().over(Window.partitionBy(window).orderBy(uniform(F.col(key), seed), key))
    return batch.withColumn("place", window * buffer + rank - 1)


def windowed_losses(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Event-time means per window; late rows beyond the watermark are left out by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
