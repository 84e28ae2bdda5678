"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most e edits shares at least m - q + 1 - q e character
q-grams with it, all of them on e + 1 neighbouring diagonals (text place minus item place). For each item and
band of 2 (e + 1) diagonals, bands overlapping by half, shared q-grams are counted; bands that reach the bound
are verified by an alignment on their diagonals alone that may begin and end anywhere on them. e is `rate` of the item's
length, but never so much that the bound falls below 1.

Texts and items are lower-cased and runs of white space are one space. Items of fewer than q characters match
only as whole words, without edits. Equal items are one text with several ids. The texts are dealt into slices of about
`slice_bytes`, told by their sizes. A single slice goes to the workers with the task; several are tables in the shared
folder, of which a worker reads one at a time for each block of documents, so that the documents are read once and the
driver holds no items (where the folder is not mounted, it passes on one slice after another).

Shared grams are expanded to at most PAIRS (text place, item place) pairs at a time; counts of bands that the text has
not left yet are carried on. A long text that repeats an item's repeated grams takes time in proportion to those pairs,
but no more memory. Once an item is found without edits in a text, it is looked for no further there.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dealt
from .common import saved, shared_dir, table

MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
#: Places of a text that are hashed at once, pairs of text and item places that are counted at once, diagonals that are aligned at once.
PLACES, PAIRS, WIDE = 1 << 18, 1 << 20, 1 << 18


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, built by doubling."""
    n = len(chars) - q + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    power, size, now, done, out = np.array([MIX]), 1, chars.astype(np.uint64) + np.uint64(1), 0, None
    while size <= q:
        if q & size:
            part = now[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        if 2 * size <= q:
            now = now[: len(now) - size] * power + now[size:]
            power = power * power
        size *= 2
    return (out ^ out >> np.uint64(29)) * MIX


class Items:
    """Sorted q-gram index of a slice of items."""

    def __init__(self, items: list[tuple[object, str | None]], q: int, rate: float):
        self.q, texts = q, [(i, normal(t)) for i, t in items]
        self.short = [(i, t) for i, t in texts if 0 < len(t) < q]
        texts = [(i, t) for i, t in texts if len(t) >= q]
        self.ids = [i for i, _ in texts]
        self.texts, self.chars = [t for _, t in texts], [points(t) for _, t in texts]
        sizes = np.array([len(c) for c in self.chars], dtype=np.int64)
        self.sizes = sizes
        self.edits = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q)
        self.least = sizes - q + 1 - q * self.edits
        hashes = np.concatenate([np.empty(0, np.uint64), *[gram_hashes(c, q) for c in self.chars]])
        counts = sizes - q + 1
        item, place = np.arange(len(sizes)).repeat(counts), np.arange(counts.sum()) - (np.cumsum(counts) - counts).repeat(counts)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True

    def pairs(self, chars: np.ndarray, gone: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(item << 40 | band, hits, first text place that is still to come), a bounded part of the text's places at a time."""
        n = len(chars) - self.q + 1
        for low in range(0, n, PLACES):
            hashes = gram_hashes(chars[low : min(low + PLACES, n) + self.q - 1], self.q)
            at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - BITS)])
            row = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            real = self.keys[row] == hashes[at]
            at, row = at[real] + low, row[real]
            upto, begin = np.cumsum(self.count[row]), 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
                alive = np.add.reduceat(~gone[self.item], self.first) > 0 if gone.any() else None
                some, own = at[begin:end], row[begin:end]
                if alive is not None:
                    some, own = some[alive[own]], own[alive[own]]
                k = self.count[own]
                entry = self.first[own].repeat(k) + np.arange(k.sum()) - (np.cumsum(k) - k).repeat(k)
                item = self.item[entry]
                band = (some.repeat(k) - self.place[entry]) // (self.edits[item] + 1)
                pair = item << 40 | band + (1 << 39)
                found, hits = np.unique(np.concatenate([pair, pair - 1]), return_counts=True)
                begin = end
                yield found, hits, int(at[end]) if end < len(at) else min(low + PLACES, n)

    def bands(self, chars: np.ndarray, gone: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, number of diagonals) of the bands that reach an item's bound, neighbouring ones as one.

        All the diagonals of an occurrence within the budget lie in one of them. A band is told once the text has left it.
        """
        if not len(self.keys):
            return
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for found, hits, come in self.pairs(chars, gone):
            held, back = np.unique(np.concatenate([held, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, hits]), len(held)).astype(np.int64)
            item = held >> 40
            over = ((held & (1 << 40) - 1) - (1 << 39) + 2) * (self.edits[item] + 1) + self.sizes[item] < come
            yield from self._wide(held[over & (counts >= self.least[item])])
            held, counts = held[~over], counts[~over]
        yield from self._wide(held[counts >= self.least[held >> 40]])

    def _wide(self, pairs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Sorted (item << 40 | band), runs of neighbours joined up to about WIDE diagonals."""
        if not len(pairs):
            return
        cuts = [0, *(np.flatnonzero(np.diff(pairs) > 1) + 1).tolist(), len(pairs)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            w = int(self.edits[pairs[a] >> 40]) + 1
            for c in range(a, b, max(1, WIDE // w)):
                last = min(c + max(1, WIDE // w), b) - 1
                yield int(pairs[c] >> 40), (int(pairs[c] & (1 << 40) - 1) - (1 << 39)) * w, (last - c + 2) * w

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, edits, start, length) in the normalised text: the best place of every item in it; of equally good ones that of the first band."""
        chars, best, gone = points(text), {}, np.zeros(len(self.texts), dtype=bool)
        for k, first, width in self.bands(chars, gone):
            if gone[k]:
                continue
            size, most = len(self.texts[k]), best[k][0] - 1 if k in best else int(self.edits[k])
            whole = text.find(self.texts[k], max(first, 0), max(first + width - 1 + size, 0))
            one = (0, whole, size) if whole >= 0 else align(self.chars[k], chars, most, first, width) if most else None
            if one:
                best[k], gone[k] = one, one[0] == 0
        out = [(self.ids[k], *one) for k, one in best.items()]
        padded = f" {text} " if self.short else ""
        return out + [(i, 0, padded.find(f" {t} "), len(t)) for i, t in self.short if f" {t} " in padded]


def align(item: np.ndarray, text: np.ndarray, most: int, first: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, length) of the item's best place in text on the diagonals (text place minus item place) from first on, if it takes `most` edits at most; earliest end, then latest start.

    A row per character of the item, a column per diagonal; the start is carried along the best path. Memory and work
    are those of the band, however long the text is.
    """
    n, far = len(text), 1 << 30
    steps = np.arange(width)
    place = first + steps  # in the text, of the row that is being left
    cost, begin = np.where((place >= 0) & (place <= n), 0, far), place.copy()
    scale = n + 2
    padded = text[max(first, 0) : max(first + width + len(item), 0)]
    padded = np.concatenate([np.full(min(max(-first, 0), width + len(item)), far, dtype=np.int64), padded.astype(np.int64)])
    padded = np.concatenate([padded, np.full(width + len(item) - len(padded), far, dtype=np.int64)])
    for i, c in enumerate(item):
        swap = cost + (padded[i : i + width] != c)
        up, left = np.append(cost[1:] + 1, far), np.append(begin[1:], 0)
        take = swap <= up
        cost, begin = np.where(take, swap, up), np.where(take, begin, left)
        place = place + 1
        inside = (place >= 0) & (place <= n)
        packed = np.minimum.accumulate((np.where(inside, cost, far) - steps) * scale + (n + 1 - begin))
        cost, begin = np.where(inside, packed // scale + steps, far), n + 1 - packed % scale
        if cost.min() > most:
            return None
    at = int(cost.argmin())
    return (int(cost[at]), int(begin[at]), int(place[at] - begin[at])) if cost[at] <= most else None


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05, slice_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, edits, start, length): one row for each document row and item found in it, at its best place.

    start and length are code points of the normalised text. Null or empty texts and items match nothing; rows
    with null or repeated ids are judged like others, equal items each give a row; empty tables give no rows; other
    columns are not used.
    """
    items, loads = slices(benchmark, slice_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for last, load in loads:
        part = _searched(rows, load, q, rate)
        part = part if last and out is None else saved(part, "benchmark-hits")
        out = part if out is None else out.unionByName(part)
    few = items.count() <= MANY_ITEMS
    return out.join(F.broadcast(items) if few else items, "key").select("doc_id", "item_id", "edits", "start", "length")


#: Gives a worker the slices of (key, text), one at a time.
Load = Callable[[], Iterator[list[tuple[str, str]]]]
#: Up to so many items their ids go to all tasks.
MANY_ITEMS = 1_000_000


def slices(benchmark: DataFrame, slice_bytes: int) -> tuple[DataFrame, Iterator[tuple[bool, Load]]]:
    """(key, item_id) of the items and (whether it is the last, what gives a worker slices of the distinct texts).

    Normalised texts are dealt by their hash into as many slices as keep them at half of slice_bytes on average. One slice is
    collected; several are read by the workers from the shared folder or, where that is not mounted, collected one after another.
    """

    def normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t.as_py()) for t in batch.column(1)]
            keys = [sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(keys, pa.string())], names=["item_id", "text", "key"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = saved(rows.mapInArrow(normals, "item_id long, text string, key string").where("text <> ''"), "benchmark-items")
    texts = saved(items.groupBy("key").agg(F.first("text").alias("text")), "benchmark-texts")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return items.select("key", "item_id"), _loads(texts, 1 if total <= slice_bytes else -(-2 * total // slice_bytes))


def _loads(texts: DataFrame, n: int) -> Iterator[tuple[bool, Load]]:
    if n == 1:
        held = [tuple(r) for r in texts.collect()]
        yield True, lambda: iter([held])
        return
    path = shared_dir(texts.sparkSession, "benchmark-slices")
    dealt_out = texts.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(n)))
    dealt_out.repartition("slice").write.partitionBy("slice").parquet(path)
    if path.startswith(("file:", "/")):
        folder = "/" + path.removeprefix("file:").lstrip("/")

        def from_folder() -> Iterator[list[tuple[str, str]]]:
            for name in sorted(x for x in os.listdir(folder) if x.startswith("slice=")):
                rows = pq.read_table(f"{folder}/{name}", columns=["key", "text"], partitioning=None)
                yield [*zip(rows["key"].to_pylist(), rows["text"].to_pylist(), strict=True)]

        from_folder.many = True
        yield True, from_folder
        return
    for k in range(n):
        held = [tuple(r) for r in texts.sparkSession.read.parquet(path).where(F.col("slice") == k).select("key", "text").collect()]
        yield k == n - 1, lambda held=held: iter([held])


def uncontaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05, slice_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns and no shuffle."""
    left = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for last, load in slices(benchmark, slice_bytes)[1]:
        left = _without(left, load, q, rate)
        left = left if last else saved(left, "uncontaminated")
    return left.select("row.*")


#: Bytes of documents that meet one slice after the other.
HELD = 64 << 20


def _blocks(batches: Iterator[pa.RecordBatch], load: Load) -> Iterator[pa.RecordBatch]:
    """Batches, joined to about HELD bytes if each meets several slices."""
    if not getattr(load, "many", False):
        yield from batches
        return
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _indexes(load: Load, q: int, rate: float) -> Callable[[], Iterator[Items]]:
    """The slices' indexes, again and again; that of a single slice is made once."""
    kept: list[Items] = []

    def every() -> Iterator[Items]:
        if kept:
            yield kept[0]
            return
        n = 0
        for some in load():
            index, n = Items(some, q, rate), n + 1
            kept[:] = [index] if n == 1 else []
            yield index

    return every


def _without(rows: DataFrame, load: Load, q: int, rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(load, q, rate)
        for batch in _blocks(batches, load):
            left = list(range(batch.num_rows))
            for index in indexes():
                left = [k for k in left if not index.matches(normal(batch.column(0)[k].as_py()))]
            yield batch.take(pa.array(left, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


MATCHES = "doc_id long, key string, edits int, start long, length long"


def _searched(rows: DataFrame, load: Load, q: int, rate: float) -> DataFrame:
    """MATCHES of rows (doc_id, text): the texts of the slices that are found in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(load, q, rate)
        names = [x.split()[0] for x in MATCHES.split(", ")]
        for batch in _blocks(batches, load):
            docs = batch.column(0).to_pylist()
            for index in indexes():
                found = [(doc, *m) for doc, text in zip(docs, batch.column(1), strict=True) for m in index.matches(normal(text.as_py()))]
                cols = [*zip(*found, strict=True)] if found else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, MATCHES)


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with at most 5 % edits, with the items and places."""
    return contaminated(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
