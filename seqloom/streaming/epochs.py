"""A stream that repeats a saved dataset for ever: a Python data source whose offset is (epoch, file, row).

Files are Parquet, in the order of their paths, below a mounted folder. Every trigger goes on by `rows` rows, over the
end of a file and of an epoch; a batch is dealt in parts of at most `rows_per_task`, which read the row groups they lie in. The
files must stay as they are while a stream reads them. Where the stream was sent is written to
the file `position` before Spark is told of it, so it is never behind Spark's own log and a restarted query goes on
where it stopped: nothing is read twice or left out. `epochs` ends the stream, without it there is no end.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from glob import glob
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Columns that a row may carry besides its own: the epoch, the place of the row in the dataset, and in the stream.
PLACES = {"epoch": "long", "ord": "long", "stream_ord": "long"}


def local(path: str) -> str:
    scheme, sep, rest = path.partition(":")
    if sep and scheme != "file":
        raise ValueError(f"needs a mounted folder, not {scheme}:")
    return "/" + rest.lstrip("/") if sep else path


class Part(InputPartition):
    def __init__(self, epoch: int, path: str, low: int, high: int, before: int, total: int):
        self.epoch, self.path, self.low, self.high, self.before, self.total = epoch, path, low, high, before, total


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return EpochReader(self.options, schema)


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.schema, self.step = schema, int(options.get("rows", 100_000))
        self.size, self.position = int(options.get("rows_per_task", self.step)), local(options["position"])
        self.last = int(options["epochs"]) if options.get("epochs") else None
        if self.step < 1 or self.size < 1:
            raise ValueError("rows and rows_per_task must be at least 1")
        folder = local(options["path"])
        self.files = sorted(f for f in glob(f"{folder}/**/*.parquet", recursive=True) if not os.path.basename(f).startswith(("_", ".")))
        self.rows = self._counted()
        self.before = [0, *accumulate(self.rows)]
        self.total = self.before[-1]

    def _counted(self) -> list[int]:
        """Rows of each file: from the footers, many at a time, and kept beside the position for later starts."""
        known, path = {}, f"{self.position}.rows"
        if os.path.exists(path):
            with open(path) as file:
                known = json.load(file)
        new = [f for f in self.files if f not in known]
        if new:
            with ThreadPoolExecutor(32) as pool:
                known = {f: known[f] for f in self.files if f in known} | dict(zip(new, pool.map(lambda f: pq.read_metadata(f).num_rows, new), strict=True))
            self._written(path, known)
        return [known[f] for f in self.files]

    @staticmethod
    def _written(path: str, value: dict) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.new", "w") as file:
            json.dump(value, file)
        os.replace(f"{path}.new", path)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "file": 0, "row": 0}

    def latestOffset(self) -> dict:
        at = self.initialOffset()
        if os.path.exists(self.position):
            with open(self.position) as file:
                at = json.load(file)
        to = self._ahead(at, self.step)
        self._written(self.position, to)
        return to

    def _spans(self, at: dict, n: int | None, end: dict | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(epoch, file, first row, row behind the last) from an offset on, n rows or up to end."""
        epoch, file, row = at["epoch"], at["file"], at["row"]
        while self.total and (self.last is None or epoch < self.last) and (n is None or n > 0):
            if end and (epoch, file, row) >= (end["epoch"], end["file"], end["row"]):
                return
            high = self.rows[file] if n is None else min(self.rows[file], row + n)
            if end and (epoch, file) == (end["epoch"], end["file"]):
                high = min(high, end["row"])
            if high > row:
                yield epoch, file, row, high
                n = None if n is None else n - (high - row)
            if high < self.rows[file]:
                return
            file, row = file + 1, 0
            if file == len(self.files):
                epoch, file = epoch + 1, 0

    def _ahead(self, at: dict, n: int) -> dict:
        out = at
        for epoch, file, _, high in self._spans(at, n):
            out = {"epoch": epoch, "file": file, "row": high}
            if high == self.rows[file]:
                out = {"epoch": epoch, "file": file + 1, "row": 0} if file + 1 < len(self.files) else {"epoch": epoch + 1, "file": 0, "row": 0}
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for epoch, file, low, high in self._spans(start, None, end):
            out += [Part(epoch, self.files[file], a, min(a + self.size, high), self.before[file], self.total) for a in range(low, high, self.size)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The part's rows; row groups that hold none of them are not read."""
        names = self.schema.fieldNames()
        file = pq.ParquetFile(part.path)
        ends = [0, *accumulate(file.metadata.row_group(k).num_rows for k in range(file.metadata.num_row_groups))]
        groups = [k for k in range(len(ends) - 1) if ends[k] < part.high and ends[k + 1] > part.low]
        at = ends[groups[0]] if groups else 0
        for batch in file.iter_batches(row_groups=groups, columns=[f for f in names if f not in PLACES]):
            low, high = max(part.low - at, 0), min(part.high - at, batch.num_rows)
            if low < high:
                rows = batch.slice(low, high - low)
                places = np.arange(part.before + at + low, part.before + at + high, dtype=np.int64)
                extra = {"epoch": np.full(high - low, part.epoch, dtype=np.int64), "ord": places, "stream_ord": part.epoch * part.total + places}
                yield pa.RecordBatch.from_arrays([pa.array(extra[f]) if f in PLACES else rows[f] for f in names], names=names)
            at += batch.num_rows

    def commit(self, end: dict) -> None:
        """Nothing is kept back: the position is written ahead."""


def repeat(spark: SparkSession, path: str, schema: str, position: str, rows: int, epochs: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """The dataset at path, epoch after epoch, as a stream; schema may name PLACES' columns too. position is the stream's own file."""
    spark.dataSource.register(EpochSource)
    options = {"path": path, "position": position, "rows": str(rows), "rows_per_task": str(rows_per_task or rows)}
    if epochs is not None:
        options["epochs"] = str(epochs)
    return spark.readStream.format("epochs").schema(schema).options(**options).load()
