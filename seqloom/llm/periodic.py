"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Level l of a text names the substrings of 2^l words: two places have one name if and only if their substrings are
equal. A level is the ranks of pairs of names of the level below, found by sorting, so nothing is hashed and no suffix is
sorted; naming ends at the first level whose names all differ. How far two places agree, ahead or behind, is read off
the levels from the top, a vector of pairs at a time.

A run of period q and at least 4 q words holds a grid place x = m q with at least 3 q of its words from x on, so x and
x + q agree for 2 q words at least. Grid places of all periods of one octave are compared at once by the name level of at
most 2 q words; the first of neighbouring hits is extended to both sides, which gives the whole run. A run found with
a multiple of its period has the same bounds as with the period itself, and the smallest one stays.

A text of n words takes O(n log n) work and 4 bytes a word and level; texts without long repeats end after a few levels.
A text is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt
from .common import table

#: Pairs of places that are compared at once.
BLOCK = 1 << 20


class Names:
    """Name levels of a sequence of numbers."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids.astype(np.int32)]
        while True:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = len(below) - half
            if n < 2:
                break
            pairs = below[:n].astype(np.int64) * (int(below.max()) + 1) + below[half:]
            found, names = np.unique(pairs, return_inverse=True)
            if len(found) == n:
                break
            self.levels.append(names.astype(np.int32))

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words in common from x and from y > x on."""
        out = np.zeros(len(x), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            fits = np.flatnonzero(y + out < len(names))
            same = fits[names[(x + out)[fits]] == names[(y + out)[fits]]]
            out[same] += 1 << level
        return out

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words in common that end before x and before y > x."""
        out = np.zeros(len(x), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            fits = np.flatnonzero(x - out - size >= 0)
            same = fits[names[(x - out)[fits] - size] == names[(y - out)[fits] - size]]
            out[same] += size
        return out


def grid_hits(names: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, q) of the grid places x = m q of periods low to high whose names at x and x + q are one, the first of neighbours only."""
    q = np.arange(low, high + 1)
    counts = np.maximum(-(-(len(names) - q) // q), 0)
    upto = np.cumsum(counts)
    ends = np.unique(np.searchsorted(upto, np.arange(BLOCK, upto[-1] + BLOCK, BLOCK)).clip(0, len(q) - 1)) + 1
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        n = counts[a:b]
        period = q[a:b].repeat(n)
        x = (np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)) * period
        hit = names[x] == names[x + period]
        first = hit.copy()
        first[1:] &= ~(hit[:-1] & (period[1:] == period[:-1]))
        yield x[first], period[first]


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """All runs (start, length, period) by start and period: maximal stretches with smallest period q and max(least, times q) words or more; times is 4 or more."""
    if times < 4:
        raise ValueError("times must be at least 4")
    names, found = Names(ids), [np.empty((0, 3), dtype=np.int64)]
    for octave in range(len(names.levels) - 1):
        low, high = 1 << octave, min((2 << octave) - 1, len(ids) // times)
        if low > high:
            break
        for x, q in grid_hits(names.levels[octave + 1], low, high):
            back = names.behind(x, x + q)
            length = names.ahead(x, x + q) + back + q
            long = length >= np.maximum(least, times * q)
            found.append(np.column_stack([x - back, length, q])[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Of n words: those that lie in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


RUNS = "array<struct<start:long,length:long,period:long>>"


def with_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs' rows as `row` with n_words, runs (by start and period) and collapsed: the words outside the repetitions, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A null or empty text has no words, no runs and an empty collapsed text.
    Rows are judged alone: repeated or null ids and equal texts do not matter, other columns stay in `row` whatever
    their names, an empty table stays empty. Nothing is shuffled.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, offsets, parts, kept = [], [0], [], []
            for value in batch.column(0):
                words = (value.as_py() or "").encode().split()
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                own = runs_of(ids, least, times)
                if len(own):
                    gone = repeated(own, len(words))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                sizes.append(len(ids))
                parts.append(own)
                offsets.append(offsets[-1] + len(own))
                kept.append(b" ".join(words).decode())
            flat = np.concatenate([np.empty((0, 3), dtype=np.int64), *parts])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[*entry]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.string())], names=["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's rows with a repetition: h is the id's crc32; where h % 10 is 0, words from place a on repeat the p words from a. A null id has no h."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs and what is left without their repetitions, after the contract's repetitions were planted."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = with_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = rows.select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed", best.alias("best"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
