"""Language-model scoring: an interpolated modified Kneser-Ney model, counted in Spark and memory-mapped by workers.

Level 1 holds the words: sorted arrays of XXH64 word hashes, a word's id being its rank. Level k holds the
k-grams as sorted keys (rank of the prefix at level k - 1) << 32 | word id, so n-grams above words are exact.
Each level is cut into ranges of prefixes; a range is one array per file in the shared folder.

Workers count a chunk of texts with sorted arrays and send each range one compressed array, not a row per
n-gram; ranges are merged by their own tasks. Files are written under another name and renamed, so repeated
tasks and lost executors do no harm. Scoring maps the files and looks up the sorted distinct n-grams of a
chunk; neither the model nor the vocabulary is held in a worker's or the driver's memory. The driver sees
only totals per range.

A text is a start mark, its words and one end. The highest level uses counts, lower ones the number of
distinct words before an n-gram (or its count, if it begins with the start mark). Discounts are the usual
ones from the counts of counts of a level. Unknown words share the uniform part of level 1, which is taken
over all training tokens and one unknown.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt
from .common import crc_mod, saved, shared_dir, table
from .words import segments, words

END, START = np.uint64(1), np.uint64(0)
#: Id of the start mark, above all word ids; -1 is unknown.
START_ID = (1 << 32) - 2
CHUNK = 1_000_000
#: Arrays of a level that a task keeps mapped at a time; each holds a file descriptor.
MAPS = 48


def local_path(uri: str) -> str:
    """The folder behind a file: address. Memory-mapping needs shared storage that is mounted."""
    scheme, sep, rest = uri.partition(":")
    if sep and scheme != "file" and "/" not in scheme:
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {scheme}:")
    return "/" + rest.lstrip("/") if sep and scheme == "file" else uri


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, f"{folder}/{name}.npy")


def narrow(values: np.ndarray) -> np.ndarray:
    """As 32 bits where all values fit, else as 64."""
    return values.astype(np.uint32 if not values.size or int(values.max()) < 1 << 32 else np.uint64)


def load_array(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; the first is sorted and stored as differences."""
    planes = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]]
    raw = b"".join(np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for p in planes)
    return np.array([len(arrays[0]), len(arrays)], "<u8").tobytes() + zstandard.compress(raw, 1)


def spread_out(blob: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(blob[:16], "<u8").tolist()
    raw = np.frombuffer(zstandard.decompress(blob[16:], max_output_size=8 * n * k), np.uint8).reshape(k, 8, n)
    planes = [np.ascontiguousarray(raw[i].T).view("<u8").reshape(-1) for i in range(k)]
    return [np.cumsum(planes[0], dtype=np.uint64), *planes[1:]]


def summed(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the sums of their counts and the values that go with a key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    total = np.add.reduceat(counts[order], first) if len(keys) else counts
    return (keys[first], total, *[m[order][first] for m in more])


def token_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(slices of rows, token hashes, places of the start marks) of about CHUNK tokens. Texts are column 0; null is empty."""
    rows: list[pa.RecordBatch] = []
    parts, starts, n = [], [], 0
    for batch in batches:
        for k, text in enumerate(batch.column(0)):
            starts.append(n)
            parts.append(np.array([START]))
            n += 2
            for part in segments(text.as_buffer().to_pybytes() if text.is_valid else b""):
                digests = b"".join([xxhash.xxh64_digest(w) for w in words(part)])
                parts.append(np.frombuffer(digests, ">u8").astype(np.uint64))
                n += len(parts[-1])
            parts.append(np.array([END]))
            rows.append(batch.slice(k, 1))
            if n >= CHUNK:
                yield rows, np.concatenate(parts), np.array(starts)
                rows, parts, starts, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array(starts)


class Shards:
    """Sorted arrays of one level, range after range, with the rank of each range's first key."""

    def __init__(self, folder: str, level: int, n_ranges: int, sizes: list[int], width: int):
        self.folder, self.level, self.n_ranges, self.width = f"{folder}/{level}", level, n_ranges, width
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def array(self, kind: str, r: int) -> np.ndarray:
        """A mapped array. The last MAPS ones stay mapped, and only as long as this object lives; they are not pickled with it."""
        held = self.__dict__.setdefault("held", OrderedDict())
        if (kind, r) in held:
            held.move_to_end((kind, r))
        else:
            held[kind, r] = load_array(self.folder, f"{kind}-{r}")
            if len(held) > MAPS:
                held.popitem(last=False)
        return held[kind, r]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "held"}

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return range_of_hash(keys, self.n_ranges) if self.level == 1 else np.minimum((keys >> np.uint64(32)).astype(np.int64) // self.width, self.n_ranges - 1)

    def find(self, keys: np.ndarray, value: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Ranks of sorted keys (-1: absent), and their `value` array's entries (0: absent)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        got = np.zeros(len(keys), dtype=np.int64) if value else None
        r = self.ranges(keys)
        for lo, hi in runs(r):
            k = int(r[lo])
            held = self.array("keys", k)
            at = np.searchsorted(held, keys[lo:hi])
            hit = np.flatnonzero(at < len(held))
            hit = hit[np.asarray(held[at[hit]]) == keys[lo:hi][hit]]
            out[lo + hit] = at[hit] + self.offsets[k]
            if value:
                got[lo + hit] = self.array(value, k)[at[hit]]
        return out, got

    def contexts(self, prefixes: np.ndarray) -> np.ndarray:
        """Rows total, N1, N2, N3+ of sorted prefixes (zeros: absent)."""
        out = np.zeros((len(prefixes), 4), dtype=np.float64)
        r = np.minimum(prefixes // self.width, self.n_ranges - 1)
        for lo, hi in runs(r):
            held = self.array("contexts", int(r[lo]))
            at = np.searchsorted(held, prefixes[lo:hi].astype(np.uint64))
            hit = np.flatnonzero(at < len(held))
            hit = hit[np.asarray(held[at[hit]]) == prefixes[lo:hi][hit].astype(np.uint64)]
            out[lo + hit] = self.array("totals", int(r[lo]))[at[hit]]
        return out


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def range_of_hash(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def grams(levels: list[Shards], hashes: np.ndarray, starts: np.ndarray, last: str | None = None) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Ranks of the k-gram that ends at each token (-1: none), places in the texts, and with `last` each level's values."""
    begun = np.zeros(len(hashes), dtype=np.int64)
    begun[starts] = starts
    place = np.arange(len(hashes)) - np.maximum.accumulate(begun)
    unique, back = np.unique(hashes, return_inverse=True)
    rank, value = levels[0].find(unique, last)
    ids = rank[back]
    ids[starts] = START_ID
    out, values = [ids], [value[back] if last else ids]
    for k, level in enumerate(levels[1:], 2):
        key, there = gram_keys(out[-1], ids, place, k)
        unique, back = np.unique(key, return_inverse=True)
        rank, value = level.find(unique, last)
        full = np.full(len(ids), -1, dtype=np.int64)
        full[there] = rank[back]
        out.append(full)
        if last:
            got = np.zeros(len(ids), dtype=np.int64)
            got[there] = value[back]
            values.append(got)
    return out, place, values


def gram_keys(prefix: np.ndarray, ids: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k-grams, and the tokens at which they end; tokens without known prefix or word have none."""
    before = np.append([-1], prefix[:-1])
    there = np.flatnonzero((place >= k - 1) & (before >= 0) & (ids >= 0))
    return before[there].astype(np.uint64) << np.uint64(32) | ids[there].astype(np.uint64), there


def _sent(merged: tuple[np.ndarray, ...], ranges: np.ndarray) -> pa.RecordBatch:
    spans = [*runs(ranges)]
    blobs = [squeeze(*[m[lo:hi] for m in merged]) for lo, hi in spans]
    return pa.RecordBatch.from_arrays([pa.array([int(ranges[lo]) for lo, _ in spans], pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])


def _merged(blobs: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    parts = [spread_out(b) for b in blobs.to_pylist() if b]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return summed(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def count_level(texts: DataFrame, levels: list[Shards], k: int, n_ranges: int, width: int) -> DataFrame:
    """(range, blob) of the k-grams' keys, counts and, above level 2, the ranks of their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            merged = summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            if len(merged[0]):
                ranges = range_of_hash(merged[0], n_ranges) if k == 1 else np.minimum((merged[0] >> np.uint64(32)).astype(np.int64) // width, n_ranges - 1)
                yield _sent(merged, ranges)

        for _, hashes, starts in token_chunks(batches):
            if k == 1:
                keep = np.ones(len(hashes), dtype=bool)
                keep[starts] = False
                key, count = np.unique(hashes[keep], return_counts=True)
                held.append((key, count.astype(np.uint64)))
            else:
                ranks, place, _ = grams(levels, hashes, starts)
                key, there = gram_keys(ranks[-1], ranks[0], place, k)
                if k == 2:
                    key, count = np.unique(key, return_counts=True)
                    held.append((key, count.astype(np.uint64)))
                else:
                    key, first, count = np.unique(key, return_index=True, return_counts=True)
                    held.append((key, count.astype(np.uint64), ranks[-1][there][first].astype(np.uint64)))
            if sum(len(x[0]) for x in held) >= 4 * CHUNK:
                yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(run, "range int, blob binary")


def _write_stats(folder: str, r: int, keys: np.ndarray, adjusted: np.ndarray, level: int) -> np.ndarray:
    """Saves the adjusted counts and, above level 1, the totals of each prefix. n1 to n4, N1, N2, N3+ and the sum."""
    save_array(folder, f"adjusted-{r}", narrow(adjusted))
    classes = np.stack([adjusted == 1, adjusted == 2, adjusted >= 3], axis=1).astype(np.int64)
    if level > 1:
        prefix = keys >> np.uint64(32)
        first = np.flatnonzero(np.append([True], prefix[1:] != prefix[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
        totals = np.concatenate([np.add.reduceat(adjusted[:, None], first), np.add.reduceat(classes, first)], axis=1) if len(keys) else np.empty((0, 4), dtype=np.int64)
        save_array(folder, f"contexts-{r}", prefix[first])
        save_array(folder, f"totals-{r}", narrow(totals))
    return np.array([*[(adjusted == n).sum() for n in (1, 2, 3, 4)], *classes.sum(axis=0), adjusted.sum()], dtype=np.int64)


STATS = "range int, n long, tokens long, n1 long, n2 long, n3 long, n4 long, c1 long, c2 long, c3 long, total long, target int, blob binary"


def merge_level(sent: DataFrame, folder: str, levels: list[Shards], k: int, order: int, n_ranges: int) -> DataFrame:
    """Writes the ranges of level k. A row per range with its totals, and rows (target, blob) with what it tells of level k - 1."""
    below = levels[-1] if levels else None

    def run(group: pa.Table) -> pa.Table:
        r = group.column("range")[0].as_py()
        merged = _merged(group.column("blob"))
        keys, counts = merged[0], merged[1].astype(np.int64)
        here = f"{folder}/{k}"
        save_array(here, f"keys-{r}", keys)
        if k < order or k == 1:  # the highest level's counts are its adjusted ones
            save_array(here, f"raw-{r}", narrow(counts))
        stats = _write_stats(here, r, keys, counts, k) if k == order else np.zeros(8, dtype=np.int64)
        targets, blobs = [None], [None]
        if k > 1:
            suffix = merged[2] if k > 2 else keys & np.uint64(0xFFFFFFFF)
            unique, types = np.unique(suffix, return_counts=True)
            owner = np.searchsorted(below.offsets, unique.astype(np.int64), side="right") - 1
            for lo, hi in runs(owner):
                targets.append(int(owner[lo]))
                blobs.append(squeeze(unique[lo:hi], types[lo:hi].astype(np.uint64)))
        n = len(targets)
        first = [r, len(keys), int(counts.sum()), *map(int, stats)]
        cols = [pa.array([v] + [None] * (n - 1), pa.int64()) for v in first]
        names = [x.split()[0] for x in STATS.split(", ")]
        return pa.Table.from_arrays([cols[0].cast(pa.int32()), *cols[1:], pa.array(targets, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    every = sent.sparkSession.range(n_ranges).select(F.col("id").cast("int").alias("range"), F.lit(b"").alias("blob"))
    return sent.unionByName(every).groupBy("range").applyInArrow(run, STATS)


def adjust_level(told: DataFrame, folder: str, shards: Shards) -> DataFrame:
    """Writes a lower level's adjusted counts from what the level above tells of it; totals per range."""

    def run(group: pa.Table) -> pa.Table:
        r = group.column("target")[0].as_py()
        keys, raw = load_array(shards.folder, f"keys-{r}"), np.asarray(load_array(shards.folder, f"raw-{r}")).astype(np.int64)
        ranks, types = _merged(group.column("blob"))[:2]
        adjusted = np.zeros(len(raw), dtype=np.int64)
        adjusted[ranks.astype(np.int64) - shards.offsets[r]] = types.astype(np.int64)
        stats = _write_stats(shards.folder, r, np.asarray(keys), np.where(adjusted > 0, adjusted, raw), shards.level)
        names = [x.split()[0] for x in STATS.split(", ")][3:11]
        return pa.Table.from_arrays([pa.array([int(v)]) for v in stats], names=names)

    every = told.sparkSession.range(shards.n_ranges).select(F.col("id").cast("int").alias("target"), F.lit(b"").alias("blob"))
    return told.where("target IS NOT NULL").select("target", "blob").unionByName(every).groupBy("target").applyInArrow(run, ", ".join(STATS.split(", ")[3:11]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+; where counts of counts are missing, half of what the usual range allows."""
    if not (n1 and n2):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(d, 0.0), k) for k, d in enumerate(raw, 1)]


class Model:
    """What scoring needs besides the mapped files: levels, discounts and totals. Small, whatever the corpus."""

    def __init__(self, levels: list[Shards], drops: list[list[float]], vocabulary: int, tokens: int, unigrams: dict):
        self.levels, self.drops, self.vocabulary, self.tokens, self.unigrams = levels, drops, vocabulary, tokens, unigrams

    def score(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, log10 probability."""
        ranks, place, values = grams(self.levels, hashes, starts, "adjusted")
        ids = ranks[0]
        uniform = 1 / (self.vocabulary + 1)
        prob = np.full(len(ids), uniform)
        if self.unigrams["total"]:
            d = np.array([0.0, *self.drops[0]])
            free = sum(x * self.unigrams[f"c{k}"] for k, x in enumerate(self.drops[0], 1)) / self.unigrams["total"]
            prob = np.maximum(values[0] - d[np.minimum(values[0], 3)], 0) / self.unigrams["total"] + free * uniform
        for k, level in enumerate(self.levels[1:], 2):
            before = np.append([-1], ranks[k - 2][:-1])
            there = np.flatnonzero((place >= k - 1) & (before >= 0))
            unique, back = np.unique(before[there], return_inverse=True)
            total, n1, n2, n3 = level.contexts(unique)[back].T
            d, count = np.array([0.0, *self.drops[k - 1]]), values[k - 1][there]
            known = total > 0
            kept = np.maximum(count - d[np.minimum(count, 3)], 0)
            free = d[1] * n1 + d[2] * n2 + d[3] * n3
            safe = np.where(known, total, 1)
            prob[there] = np.where(known, kept / safe + free / safe * prob[there], prob[there])
        unique, back = np.unique(hashes, return_inverse=True)
        count = self.levels[0].find(unique, "raw")[1][back]
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        logs, known = np.log10(prob), (count > 0).astype(np.int64)
        for x in (base, logs, known):
            x[starts] = 0
        sizes = np.diff(np.append(starts, len(hashes))) - 1
        return sizes, np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)


def train(texts: DataFrame, order: int = 2, tokens_per_range: int = 2_000_000) -> Model:
    """Counts `order` levels over the column `text` of all rows. The files stay in the shared folder for as long as the model is used."""
    if order < 1:
        raise ValueError("order must be at least 1")
    texts = texts.select("text")
    folder = local_path(shared_dir(texts.sparkSession, "kneser-ney"))
    chars = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_ranges = max(4, chars // 6 // tokens_per_range)
    levels: list[Shards] = []
    drops, unigrams, vocabulary, tokens = [], {}, 0, 0
    for k in range(1, order + 1):
        if levels and int(levels[-1].offsets[-1]) >= START_ID:
            raise OverflowError(f"level {k - 1} has {int(levels[-1].offsets[-1])} entries; keys have room for ranks below 2^32 - 2")
        width = -(-int(levels[-1].offsets[-1]) // n_ranges) or 1 if levels else 0
        told = saved(merge_level(count_level(texts, levels, k, n_ranges, width), folder, levels, k, order, n_ranges), "kneser-ney-level")
        rows = {r["range"]: r for r in told.drop("blob").where("range IS NOT NULL").collect()}
        if k == 1:
            vocabulary, tokens = sum(r["n"] for r in rows.values()), sum(r["tokens"] for r in rows.values())
        totals = [*rows.values()]
        if k > 1:
            lower = adjust_level(told, folder, levels[-1]).collect()
            drops.append(discounts(*[sum(r[n] for r in lower) for n in ("n1", "n2", "n3", "n4")]))
            if k == 2:
                unigrams = {n: sum(r[n] for r in lower) for n in ("c1", "c2", "c3", "total")}
        levels.append(Shards(folder, k, n_ranges, [rows[r]["n"] for r in range(n_ranges)], width))
        if k == order:
            drops.append(discounts(*[sum(r[n] for r in totals) for n in ("n1", "n2", "n3", "n4")]))
            if k == 1:
                unigrams = {n: sum(r[n] for r in totals) for n in ("c1", "c2", "c3", "total")}
    return Model(levels, drops, vocabulary, tokens, unigrams)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of all rows, null texts being empty. A text's perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, starts in token_chunks(batches):
            found = model.score(hashes, starts)
            ids = pa.concat_arrays([r.column(1) for r in rows])
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.asarray(x)) for x in found]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_with_folds(docs: DataFrame, order: int = 2, folds: int = 7, held: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod folds is not held, scores all.

    Null doc_ids count as the empty text in the fold rule; repeated rows count as often as they occur; with
    nothing to learn from, every token has the uniform probability. Other columns are not used.
    """
    model = train(docs.where(crc_mod("doc_id", folds) != held), order)
    out = score_documents(docs, model)
    return out.withColumns({"held_out": crc_mod("doc_id", folds) == held, "train_tokens": F.lit(model.tokens).cast("long")})


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of order 2, beside an add-one unigram base."""
    out = score_with_folds(dealt(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (10 ** (-F.col("score") / F.col("n_tokens"))).alias("perplexity"))
