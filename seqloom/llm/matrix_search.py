"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with a scale of their own. Queries and vectors are dealt into blocks, and a task
multiplies the int8 codes of one query block with those of one vector block; only codes are shuffled to the tiles. A
product of codes is exact: float32 holds the sums of EXACT components of 127 x 127, longer vectors are added up in
parts. Times the scales it approximates the inner product, and by Cauchy-Schwarz it is wrong by at most
|q| |x - x'| + |q - q'| |x'|, x' being the quantised vector. A pair leaves its tile if its upper bound reaches the
k-th best lower bound of its query there, and a heap per query over the tiles' lower bounds sorts out the rest.
Survivors alone fetch the original vectors and are computed again in double precision, from the first component to the
last; a heap per query keeps the k best.

Equal vectors of a tile are multiplied once; of their ids only the k + 1 least can be among the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: So many products of two codes add up to less than 2^24, up to which float32 holds all whole numbers.
EXACT = (1 << 24) // (127 * 127)


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors and of what quantising loses (both rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    safe = np.where(scale > 0, scale, 1)
    code = np.rint(x / safe[:, None]).clip(-127, 127).astype(np.int8)
    back = code * safe[:, None]
    up = 1 + 1e-6
    return code, safe, np.linalg.norm(back, axis=1) * up, np.linalg.norm(x - back, axis=1) * up + 1e-300


def code_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows, as doubles."""
    out = np.zeros((len(q), len(x)))
    for at in range(0, q.shape[1], EXACT):
        out += q[:, at : at + EXACT].astype(np.float32) @ x[:, at : at + EXACT].astype(np.float32).T
    return out


def _coded(rows: DataFrame) -> DataFrame:
    """(dim, row, vec_id, asked, same, code, scale, near, lost) of rows; same is a hash of the vector."""
    names = ["dim", "row", "vec_id", "asked", "same", "code", "scale", "near", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = np.asarray(part.column(5).flatten(), dtype=np.float64).reshape(-1, dim)
                code, *others = quantise(flat)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(flat), [None, pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([*part.columns[:5], codes.cast(pa.binary()), *[pa.array(x) for x in others]], names=names)

    return rows.select("dim", "row", "vec_id", "asked", F.xxhash64("embedding").alias("same"), "embedding").mapInArrow(run, "dim int, row long, vec_id long, asked boolean, same long, code binary, scale double, near double, lost double")


class Block:
    """Codes and what goes with them of one side of a tile."""

    def __init__(self, part: pa.Table):
        self.row, self.vec_id, self.same, self.scale, self.near, self.lost = (part.column(c).to_numpy() for c in ("row", "vec_id", "same", "scale", "near", "lost"))
        self.code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(len(part), -1)

    def take(self, at: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.__dict__ = {k: v[at] for k, v in self.__dict__.items()}
        return out


def near_in_tile(q: Block, x: Block, k: int, step: int = 128) -> Iterator[tuple[np.ndarray, ...]]:
    """(query's index, vector's row, lower, upper bound) of the pairs that may be among the k best of a query in the tile, its own row left out."""
    x = x.take(np.lexsort((x.row, x.vec_id)))
    key = np.concatenate([x.code.view(np.uint8), x.same[:, None].view(np.uint8), x.scale[:, None].view(np.uint8)], axis=1)
    _, first, back, count = np.unique(np.ascontiguousarray(key).view(np.dtype((np.void, key.shape[1]))).reshape(-1), return_index=True, return_inverse=True, return_counts=True)
    member, begin = np.argsort(back, kind="stable"), np.cumsum(count) - count
    kinds, keep = x.take(first), np.minimum(count, k + 1)
    rounding = 4 * q.code.shape[1] * np.finfo(np.float64).eps
    for lo in range(0, len(q.row), step):
        some = q.take(np.arange(lo, min(lo + step, len(q.row))))
        tile = code_products(some.code, kinds.code) * some.scale[:, None] * kinds.scale
        size, lost = (some.near + some.lost)[:, None], some.lost[:, None]
        wrong = size * kinds.lost + lost * kinds.near + rounding * size * (kinds.near + kinds.lost)
        floor = tile - wrong
        if len(kinds.row) > k + 1:
            bar = np.partition(floor, len(kinds.row) - k - 1, axis=1)[:, len(kinds.row) - k - 1]
        else:
            bar = np.full(len(some.row), -np.inf)
        one, two = np.nonzero(tile + wrong >= bar[:, None])
        n = keep[two]
        at = member[begin[two].repeat(n) + np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)]
        low, high, one = floor[one, two].repeat(n), (tile + wrong)[one, two].repeat(n), one.repeat(n)
        other = x.row[at] != some.row[one]
        yield lo + one[other], x.row[at[other]], low[other], high[other]


def per_query(rows: DataFrame, schema: str, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """work on the rows of one query after another; they meet in one partition, a query at a time in memory."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done() -> pa.RecordBatch:
            out = work(dict(zip(names, [np.concatenate(x) for x in zip(*held, strict=True)], strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], names=[*out])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            query = columns[0]
            cuts = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and held[-1][0][0] != query[lo]:
                        yield done()
                        held.clear()
                    held.append([c[lo:hi] for c in columns])
        if held:
            yield done()

    return rows.repartition(names[0]).sortWithinPartitions(names[0]).mapInArrow(run, schema)


def search(vectors: DataFrame, queries: Column, k: int = 20, query_rows: int = 8192, vector_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row (`queries` holds) with all other rows.

    Rows with null, empty, zero or non-finite vectors or a null id take no part. Vectors of different lengths do not
    meet. Repeated ids are rows of their own, each with its own result if queried. Ties go to smaller ids.
    Fewer than k other rows are all returned; empty tables give no rows.
    """
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asked"))
    rows = saved(kept.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row")), "search-rows")
    whole = F.col("embedding").cast("array<double>")
    coded = saved(_coded(rows.withColumn("embedding", whole)), "search-codes")
    sizes = coded.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q"))
    sizes = saved(sizes.select("dim", F.ceil(F.col("n") / vector_rows).cast("long").alias("n_x"), F.greatest(F.ceil(F.col("q") / query_rows), F.lit(1)).cast("long").alias("n_q")), "search-sizes")
    dealt = coded.join(sizes, "dim")
    x_block, q_block = F.pmod(F.xxhash64("row"), F.col("n_x")), F.pmod(F.xxhash64("row"), F.col("n_q"))
    zero = F.lit(0).cast("long")
    fields = ["row", "vec_id", "same", "code", "scale", "near", "lost"]
    left = dealt.where("asked").select("dim", q_block.alias("bq"), F.explode(F.sequence(zero, F.col("n_x") - 1)).alias("bx"), *fields)
    right = dealt.select(F.col("dim").alias("dim"), F.explode(F.sequence(zero, F.col("n_q") - 1)).alias("bq"), x_block.alias("bx"), *[F.col(c).alias(c) for c in fields])
    bounds = ["query_row", "row", "low", "high"]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [*near_in_tile(Block(a), Block(b), k)] if len(a) and len(b) else []
        one, row, low, high = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, np.int64, float, float), zip(*found, strict=True) if found else [()] * 4, strict=True))
        return pa.Table.from_arrays([pa.array(c) for c in (a.column("row").to_numpy()[one] if len(a) else row, row, low, high)], names=bounds)

    def survivors(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        bar = heapq.nlargest(k, held["low"].tolist())[-1] if len(held["low"]) >= k else -np.inf
        stay = held["high"] >= bar
        return {c: held[c][stay] for c in bounds[:2]}

    def best(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        top = heapq.nsmallest(k, zip((-held["score"]).tolist(), held["vec_id"].tolist(), held["row"].tolist(), strict=True))
        n = len(top)
        return {"query_id": held["query_id"][:n], "rank": np.arange(1, n + 1, dtype=np.int32), "vec_id": np.array([t[1] for t in top], dtype=np.int64), "score": np.array([-t[0] for t in top])}

    cells = left.groupBy("dim", "bq", "bx").cogroup(right.groupBy("dim", "bq", "bx")).applyInArrow(tile, "query_row long, row long, low double, high double")
    pairs = per_query(cells, "query_row long, row long", survivors)
    asked = rows.where("asked").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    both = pairs.join(rows.select("row", "vec_id", F.col("embedding").alias("other")), "row").join(asked, "query_row")
    products = F.zip_with("query", "other", lambda x, y: x.cast("double") * y.cast("double"))
    product = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    exact = both.select("query_row", "query_id", "vec_id", "row", product.alias("score"))
    return per_query(exact, "query_id long, rank int, vec_id long, score double", best)


def op8_int8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INT AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""
