"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks; of two fingerprints that differ in at most `distance` bits, some block
differs in at most t = distance // blocks bits. Each block has a covering code: a Hamming [15, 11] code on
its first 15 bits times all values of the others, with covering radius R = 1. Every fingerprint lives at its
nearest anchor (its home) and is replicated to all anchors within R + t, so two fingerprints that are near in
a block meet at the home of either: d(y, home(x)) <= d(x, home(x)) + d(x, y) <= R + t. Fingerprints are
compared per anchor on all 64 bits, so the links are exact.

Exact copies share a fingerprint and are one row before replication. Fingerprints are linked in rounds, each of
which knows the components of those before it as labels: rows of one label are not compared again and only links
between labels are sent on, so a large group's links do not multiply by its anchors. An anchor with more than
`most` rows is dealt out as pairs of blocks, each compared in its own task. Components are found by alternating star
steps over written tables, in which hubs are salted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt
from .common import saved, table
from .words import segments, words

HAMMING = 15
#: Sets of at most so many shingles are candidates by their shingles too: majorities over few hashes are too coarse.
FEW = 40


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, in bounded parts; fewer words than width are one shingle, no words none."""
    carry: list[bytes] = []
    hashed = False
    for part in segments(text):
        run = carry + words(part)
        if len(run) >= width:
            joined = b" ".join(run)
            sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: len(run) - width + 1].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
            hashed = True
        carry = run[len(run) - width + 1 :] if len(run) >= width else run
        if width == 1:
            carry = []
    if not hashed and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), 42)], dtype=np.uint64)


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes themselves for n = 0, else other hashes made of them by a finaliser."""
    if n == 0:
        return hashes
    x = hashes + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint(parts: Iterable[np.ndarray], longs: int) -> np.ndarray:
    """A bit is 1 if set in over half of the hashes; no hashes give zeros. Unsigned longs; the first is that of the hashes themselves."""
    total, ones = 0, np.zeros(64 * longs, dtype=np.int64)
    for hashes in parts:
        for at in range(0, len(hashes), 20_000):
            some = hashes[at : at + 20_000]
            every = np.stack([mixed(some, n) for n in range(longs)], axis=1).astype("<u8")
            ones += np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return np.packbits(2 * ones > total, bitorder="little").view("<u8") if total else np.zeros(longs, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    return int(wide_fingerprint(shingle_hashes(text, width), 1)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint, signed. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t, width) for t in _texts(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    parts = [*shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """So many of the least hashes of a set that two sets of similarity 0.8 or more have one in common: n - ceil(0.8 n) + 1 of n."""
    return hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1] if len(hashes) else hashes


def set_fingerprints(rows: DataFrame, width: int, longs: int) -> DataFrame:
    """(key, n, fp, more, prefix, row) of rows (text, row): of the set of n shingles its XXH64, its fingerprint (more are the longs after fp) and, if n is at most FEW, its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in _texts(batch.column(0))]
            out = np.array([wide_fingerprint([s], longs) for s in sets], dtype=np.uint64).reshape(-1, longs).view(np.int64)
            key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * (longs - 1), pa.int32()), pa.array(out[:, 1:].reshape(-1)))
            heads = pa.array([prefix(s).view(np.int64) if len(s) <= FEW else [] for s in sets], pa.list_(pa.int64()))
            columns = [pa.array(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(out[:, 0])), more, heads, batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "fp", "more", "prefix", "row"])

    return rows.select("text", "row").mapInArrow(run, f"key long, n long, fp long, more array<long>, prefix array<long>, row {rows.schema['row'].dataType.simpleString()}")


def _syndromes() -> np.ndarray:
    """Of every 15-bit word: xor of the positions (1 to 15) of its bits; 0 for codewords."""
    out = np.zeros(1 << HAMMING, dtype=np.int64)
    words15 = np.arange(1 << HAMMING)
    for k in range(HAMMING):
        out ^= np.where(words15 >> k & 1, k + 1, 0)
    return out


def block_anchors(values: np.ndarray, free: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all anchors within 1 + t of block values: 15 bits of a Hamming code below `free` free bits."""
    syndrome = _syndromes()
    low = values & ((1 << HAMMING) - 1)
    s = syndrome[low]
    rows = np.arange(len(values))
    home = values ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
    out = [(rows, home, np.ones(len(values), dtype=bool))]

    def add(flip: tuple[int, ...], base: np.ndarray, spent: int) -> None:
        """Anchors at the code words reached from rows by flipping `flip` bits below and the free bits of base."""
        moved = 0
        for k in flip:
            moved |= 1 << k
        fits = syndrome[low ^ moved] == 0
        anchor = (values ^ base ^ moved)[fits]
        out.append((rows[fits], anchor, np.zeros(int(fits.sum()), dtype=bool)))

    for high in range(0, t + 2):  # none for t = -1: the homes alone
        for frees in combinations(range(HAMMING, HAMMING + free), high):
            base = np.full(len(values), sum(1 << k for k in frees), dtype=np.int64)
            for n in range(0, t + 2 - high):
                for flip in combinations(range(HAMMING), n):
                    add(flip, base, high + n)
    row, anchor, is_home = (np.concatenate(x) for x in zip(*out, strict=True))
    again = ~is_home & (anchor == home[row])
    return row[~again], anchor[~again], is_home[~again]


def replicate(fps: DataFrame, widths: list[int], t: int, blocks: Sequence[int] | None = None, homes_only: bool = False) -> DataFrame:
    """(anchor, fp, second, label, home) of all anchors near each fingerprint, or of its homes only, in the blocks asked for (all).

    Blocks follow each other over the bits of fp and more. An anchor's number holds its block too; second is the
    first long of more (0 if there is none). label is passed on; null stands for fp itself.
    """
    if min(widths) < HAMMING or max(widths) > 40:
        raise ValueError("a block has 15 to 40 bits")
    n_blocks, chosen = len(widths), set(range(len(widths)) if blocks is None else blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.asarray(batch.column(0)).reshape(-1, 1)
            rest = np.asarray(batch.column(1).flatten()).reshape(len(first), -1)
            whole = np.concatenate([first, rest], axis=1).view(np.uint64)
            second = rest[:, 0] if rest.shape[1] else np.zeros(len(first), dtype=np.int64)
            for at in range(0, len(whole), 5000):
                fp, shift = whole[at : at + 5000], 0
                labels = batch.column(2).slice(at, len(fp))
                for k, w in enumerate(widths):
                    if k in chosen:
                        long, bit = divmod(shift, 64)
                        values = fp[:, long] >> np.uint64(bit)
                        if bit + w > 64:
                            values = values | fp[:, long + 1] << np.uint64(64 - bit)
                        row, anchor, home = block_anchors((values & np.uint64((1 << w) - 1)).astype(np.int64), w - HAMMING, -1 if homes_only else t)
                        columns = [pa.array(anchor * n_blocks + k), pa.array(first[at : at + 5000, 0][row]), pa.array(second[at : at + 5000][row]), labels.take(pa.array(row)), pa.array(home)]
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fp", "second", "label", "home"])
                    shift += w

    return fps.select("fp", "more", "label").mapInArrow(run, "anchor long, fp long, second long, label long, home boolean")


def near_pairs(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Rows of one or two longs that differ in at most `distance` bits."""
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= distance


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of the components of links a - b: one link for each node but the least of its component."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[one], root[two])
        before = root.copy()
        for end in (one, two):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(names))
    return names[root[moved]], names[moved]


def forest(fps: np.ndarray, labels: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, label) that join all labels of near fps (rows of longs), by breadth-first search in blocks.

    Rows of one label are joined already and not compared with each other: the search goes from label to label.
    """
    kinds, own = np.unique(labels, return_inverse=True)
    order = np.argsort(own, kind="stable")
    first = np.searchsorted(own[order], np.arange(len(kinds) + 1))
    members = lambda k: order[first[k] : first[k + 1]]
    open_, a, b = np.ones(len(kinds), dtype=bool), [], []
    rest = np.arange(len(fps))
    for root in range(len(kinds)):
        if not open_[root]:
            continue
        open_[root] = False
        front = members(root)
        rest = rest[open_[own[rest]]]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for x in fps[front[:64]]:
                near |= near_pairs(fps[rest], x, distance)
            found = np.unique(own[rest[near]])
            open_[found] = False
            front = np.concatenate([front[64:], *[members(k) for k in found]])
            rest = rest[open_[own[rest]]]
            a.append(np.full(len(found), kinds[root]))
            b.append(kinds[found])
    empty = np.empty(0, dtype=labels.dtype)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def compare_groups(starts: np.ndarray, fps: np.ndarray, labels: np.ndarray, homes: np.ndarray, distance: int, dense: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between labels of the groups that begin at starts, homes first in each: every home against every row of its group that has another label."""
    ends = np.append(starts[1:], len(fps))
    sizes, n_homes = ends - starts, np.add.reduceat(homes.astype(np.int64), starts)
    large = sizes * n_homes > dense
    for g in np.flatnonzero(large):
        yield forest(fps[starts[g] : ends[g]], labels[starts[g] : ends[g]], distance)
    small = np.flatnonzero(~large & (n_homes > 0))
    if not len(small):
        return
    n_of = n_homes[small]
    left = starts[small].repeat(n_of) + _counted(n_of)
    width, first = sizes[small].repeat(n_of), starts[small].repeat(n_of)
    upto = np.cumsum(width)
    cuts = [*np.searchsorted(upto, np.arange(dense, upto[-1], dense)).tolist(), len(width)]
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        w = width[lo:hi]
        other = first[lo:hi].repeat(w) + _counted(w)
        one, two = left[lo:hi].repeat(w), other
        apart = np.bitwise_count(fps[one, 0] ^ fps[two, 0]) <= distance
        one, two = one[apart], two[apart]
        fresh = labels[one] != labels[two]
        one, two = one[fresh], two[fresh]
        near = near_pairs(fps[one], fps[two], distance)
        yield labels[one[near]], labels[two[near]]


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of sizes, one after the other."""
    return np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes).repeat(sizes)


def compare(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) links between labels from rows (anchor, part, fp, second, label, home) that are dealt and sorted by anchor, part and home, homes first.

    What a stretch of rows tells is sent on as a spanning forest of its labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fps: np.ndarray, labels: np.ndarray, homes: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            found = [*compare_groups(np.append([0], change), fps, labels, homes, distance)]
            if sum(len(a) for a, _ in found):
                both = stars(*[np.concatenate(x) for x in zip(*found, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            key = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            fps = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))], axis=1).view(np.uint64)
            held.append((key, fps, np.asarray(batch.column(4)), np.asarray(batch.column(5).cast(pa.int8())).astype(bool)))
            if sum(len(x[0]) for x in held) < 200_000:
                continue
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = joined[0]
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                yield from links(*[x[:last] for x in joined])
            held = [tuple(x[last:] for x in joined)]
        if held and len(held[0][0]):
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("anchor", "part", "fp", "second", F.coalesce("label", "fp").alias("label"), "home").mapInArrow(run, "a long, b long")


def spread_hot(rows: DataFrame, most: int, whole: bool) -> DataFrame:
    """Adds part: 0 for anchors with at most `most` rows; larger ones are dealt out.

    If not whole, each row of a hot anchor goes to one part, which is enough where a later round looks at all pairs.
    Else two rows of different labels meet in some part: the rows of the anchor's most common label are dealt
    into blocks and so are the others; every block of others meets every block, but blocks of the common label do
    not meet each other. So a large group that is one label already is not copied.
    """
    hot = saved(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "hot-anchors")
    zero = F.lit(0).cast("long")
    if hot.isEmpty():
        return rows.withColumn("part", zero)
    spread = lambda n: F.pmod(F.xxhash64("fp", "second"), n)
    if not whole:
        joined = rows.join(hot, "anchor", "left")
        part = spread(F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("long"))
        return joined.select("anchor", part.alias("part"), "fp", "second", "label", "home")
    label = F.coalesce("label", "fp")
    counts = rows.join(hot, "anchor", "left_semi").groupBy("anchor", label.alias("kind")).agg(F.count(F.lit(1)).alias("m"))
    common = counts.groupBy("anchor").agg(F.max(F.struct("m", "kind")).alias("top"), F.sum("m").alias("n"))
    blocks = lambda n: F.greatest(F.ceil(n * 2 / most), F.lit(1)).cast("long")
    common = saved(common.select("anchor", F.col("top.kind").alias("kind"), blocks(F.col("top.m")).alias("same"), blocks(F.col("n") - F.col("top.m")).alias("others")), "hot-labels")
    joined = rows.join(common, "anchor", "left")
    own = spread(F.col("others"))
    among = F.transform(F.sequence(zero, F.col("others") - 1), lambda k: F.least(k, own) * F.col("others") + F.greatest(k, own))
    square = F.col("others") * F.col("others")
    down = F.transform(F.sequence(zero, F.col("same") - 1), lambda j: square + own * F.col("same") + j)
    across = F.transform(F.sequence(zero, F.col("others") - 1), lambda k: square + k * F.col("same") + spread(F.col("same")))
    parts = F.when(F.col("others").isNull(), F.array(zero)).when(label == F.col("kind"), across).otherwise(F.concat(among, down))
    return joined.select("anchor", F.explode(parts).alias("part"), "fp", "second", "label", "home")


def salted(edges: DataFrame, low: DataFrame, hub: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Edges and rows of low (u, n, m), n being u's edges, with the columns to join on: nodes of over `hub` edges are dealt out under a salt.

    Such nodes are at most 2 edges / hub, so their list is small and sent to all.
    """
    hot = saved(low.where(F.col("n") > hub).select("u", F.ceil(F.col("n") / hub).alias("salts")), "hubs")
    if hot.isEmpty():
        return edges, low, ["u"]
    zero = F.lit(0).cast("long")
    few = F.broadcast(hot)
    dealt = edges.join(few, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)).cast("long"))).drop("salts")
    copies = low.join(few, "u", "left").withColumn("salt", F.explode(F.sequence(zero, F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    return dealt, copies, ["u", "salt"]


def components(links: DataFrame, hub: int = 200_000) -> DataFrame:
    """(node, root) of all nodes of links (a, b) but the roots; root is the least node. Alternating large and small star steps; hubs are salted."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m"))
        dealt, copies, on = both.where(F.col("v") > F.col("u")), low, ["u"]
        if before[0] > hub:  # else no node can have more
            dealt, copies, on = salted(dealt, saved(low, "star-low"), hub)
        large = saved(dealt.join(copies, on).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct(), "star")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def prefix_links(sets: DataFrame) -> DataFrame:
    """(a, b): every fingerprint of sets (fp, prefix) with the least one that has the same hash in its prefix."""
    heads = sets.select("fp", F.explode("prefix").alias("h")).distinct()
    least = heads.groupBy("h").agg(F.min("fp").alias("b"))
    return heads.join(least, "h").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def linked(fps: DataFrame, distance: int, widths: list[int], t: int, most: int = 20_000, also: DataFrame | None = None) -> DataFrame:
    """(node, root) of all distinct fingerprints (fp, more), root being the least of the component over near pairs and links (a, b) given besides. Distances are over fp and the first of more.

    Three rounds, each with what those before have joined as labels: homes in the first block, homes in the
    others, all anchors. The last one looks at every pair, the first two only make it cheap: a large group is
    (nearly) one label by then, and only links between different labels are sent on. So the first two take one
    step towards the least label, keep the links that this leaves, and components are found once.
    """
    now = saved(fps.select("fp", "more", F.lit(None).cast("long").alias("label")), "labels")
    label = F.coalesce("label", "fp")
    kept = also
    for blocks in [b for b in ((0,), range(1, len(widths))) if len(b)]:
        links = _round(now, distance, widths, t, most, kept, blocks)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = saved(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("to")).where("to < u"), "down")
        now = saved(now.join(down, label == F.col("u"), "left").select("fp", "more", F.coalesce("to", "label").alias("label")), "labels")
        kept = links
        for end in ("a", "b"):
            kept = kept.join(down, F.col(end) == F.col("u"), "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        kept = kept.where("a <> b")
    roots = components(_round(now, distance, widths, t, most, kept))
    return now.join(roots, label == F.col("node"), "left").select(F.col("fp").alias("node"), F.coalesce("root", "label", "fp").alias("root")).distinct()


def _round(now: DataFrame, distance: int, widths: list[int], t: int, most: int, kept: DataFrame | None, homes_of: Sequence[int] | None = None) -> DataFrame:
    """Links between labels, with those kept: from the homes in some blocks or, without them, from all anchors."""
    whole = homes_of is None
    rows = spread_hot(replicate(now, widths, t, homes_of, not whole), most, whole)
    dealt = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    found = compare(dealt, distance)
    return saved(found.unionByName(kept) if kept is not None else found, "links")


def block_widths(bits: int, blocks: int) -> list[int]:
    return [bits // blocks + (k < bits % blocks) for k in range(blocks)]


#: What a replica costs (made, shuffled, sorted) in comparisons of two fingerprints.
REPLICA = 150


def cost(n: int, blocks: int, bits: int, t: int) -> float:
    """Of linking n fingerprints, per fingerprint: replicas in all blocks of `bits` bits, and comparisons at its homes if anchors are used evenly."""
    replicas = blocks * sum(comb(bits, k) for k in range(t + 2)) / (HAMMING + 1)
    return replicas * (REPLICA + n * (HAMMING + 1) / (1 << bits))


def cheapest_blocks(n: int, bits: int, distance: int) -> int:
    """Number of blocks for an exact search among n fingerprints: fewer and wider ones for more."""
    fits = [b for b in range(1, bits + 1) if bits // b >= HAMMING and -(-bits // b) <= 40]
    return min(fits, key=lambda b: cost(n, b, bits // b, distance // b))


def cheapest_cover(n: int, apart: float = 0.15, missed: float = 0.02) -> tuple[int, int]:
    """(blocks, bits of each) for n fingerprints: at most `missed` of the pairs whose bits differ with probability `apart` have no block with one differing bit at most."""
    some = {w: ceil(log(missed) / log(1 - (1 - apart) ** w - w * apart * (1 - apart) ** (w - 1))) for w in range(18, 41, 4)}
    w = min(some, key=lambda w: cost(n, some[w], w, 1))
    return some[w], w


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int | None = None, most: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of at most `distance` of 64 bits.

    Any number of blocks gives the same links; without one the cheapest for the number of fingerprints is taken.

    Null and empty texts have fingerprint 0 and are linked like others. Rows with a null doc_id take part but
    name no component; a component of such rows only has a null id. Repeated doc_ids are rows of their own.
    An empty table gives no rows; columns other than doc_id and text are not used.
    """
    if not 0 <= distance < 16 or blocks is not None and blocks < 1:
        raise ValueError("distance or blocks out of range")
    marked = saved(fingerprints(docs, width).select("doc_id", "fp"), "fingerprints")
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    blocks = blocks or cheapest_blocks(fps.count(), 64, distance)
    roots = linked(fps.withColumn("more", F.array().cast("array<long>")), distance, block_widths(64, blocks), distance // blocks, most)
    grouped = saved(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


class Postings:
    """Sets of hashes by hash: which sets have one in common with a given set, and how many."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n_codes: int):
        self.codes, self.sizes, self.starts = codes, sizes, np.cumsum(sizes) - sizes
        self.owner = np.arange(len(sizes)).repeat(sizes)[np.argsort(codes, kind="stable")]
        self.ends = np.cumsum(np.bincount(codes, minlength=n_codes))

    def similar(self, codes: np.ndarray) -> np.ndarray:
        """The sets of Jaccard similarity 0.8 or more with a set of codes, in whole numbers: 9 times the intersection is at least 4 times both sizes."""
        first = np.where(codes > 0, self.ends[codes - 1], 0)
        n = self.ends[codes] - first
        common = np.bincount(self.owner[first.repeat(n) + _counted(n)], minlength=len(self.sizes))
        return np.flatnonzero((9 * common >= 4 * (self.sizes + len(codes))) & (common > 0))

    def without(self, gone: np.ndarray) -> Postings:
        stay = ~gone
        return Postings(self.codes[stay.repeat(self.sizes)], self.sizes[stay], len(self.ends))


def similar_forest(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of a spanning forest over all pairs of sets of similarity 0.8 or more, as places among sizes; breadth-first search."""
    unique, codes = np.unique(hashes, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    left, names, gone = Postings(codes, sizes, len(unique)), np.arange(len(sizes)), np.zeros(len(sizes), dtype=bool)
    seen, a, b = np.zeros(len(sizes), dtype=bool), [], []
    for root in range(len(sizes)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            x = front.pop()
            if seen.all():
                break
            found = left.similar(codes[starts[x] : starts[x] + sizes[x]])
            found = found[~seen[names[found]]]
            members = names[found]
            seen[members] = True
            front += members.tolist()
            a.append(np.full(len(members), root))
            b.append(members)
            gone = seen[names]
            if 2 * gone.sum() > len(gone):
                left, names = left.without(gone), names[~gone]
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def verified(texts: DataFrame, width: int, most: int) -> DataFrame:
    """(a, b): keys of sets of one group (root) whose similarity is 0.8 or more, a spanning forest of all such pairs. texts: (root, key, n, text), a row per key.

    A group of over `most` shingles is dealt out as pairs of blocks, each compared in its own task.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in _texts(batch.column(3))]
            flat = np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["root", "part", "key", "hashes"])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys = np.asarray(group.column("key"))
        lists = group.column("hashes")
        flat, sizes = (np.concatenate([np.asarray(f(c)) for c in lists.chunks]) for f in (lambda c: c.flatten(), lambda c: c.value_lengths()))
        a, b = similar_forest(flat.view(np.uint64), sizes.astype(np.int64))
        return pa.table({"a": keys[a], "b": keys[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    large = saved(texts.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > most), "hot-groups")
    rows = texts.withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        dealt = texts.join(large, "root", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("total") * 2 / most), F.lit(1)).cast("long"))
        own = F.pmod(F.xxhash64("key"), F.col("blocks"))
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
        rows = dealt.withColumn("part", F.explode(parts))
    sets = rows.select("root", "part", "key", "text").mapInArrow(hashed, "root long, part long, key long, hashes array<long>")
    return sets.groupBy("root", "part").applyInArrow(run, "a long, b long")


def one_of_similar(docs: DataFrame, width: int = 5, distance: int = 27, most: int = 5_000_000) -> DataFrame:
    """The rows of docs that stay when one row of each group of similar texts is kept: the one of least doc_id (nulls last).

    Texts are similar at a Jaccard similarity of 0.8 or more of their sets of `width`-word shingles, and groups are
    the components of such pairs. Fingerprints of the sets only name candidates: two texts of that similarity differ
    in 15 % of the bits, far more than 64 bits and a whole covering could find. The fingerprint has blocks of 18
    bits or more here, and texts meet at the anchors of any block in which they differ in at most one bit: at a
    similarity of 0.8 in 98 % of the cases, at 0.83 in 99 %, since more documents take more and wider blocks
    (cheapest_cover). Of those that meet, texts are candidates that differ in
    at most `distance` of the first 128 bits (97 % at 0.8, 99.8 % at 0.85, 1 in 10 at 0.55). Within a component of
    candidates all pairs are compared on their whole sets. Sets of at most FEW shingles are also candidates if they have
    a hash of their prefixes in common, which names all their pairs; texts without words are candidates of none.
    Texts without words are similar to each other only; null ids and
    repeated rows are judged like others, columns pass through whatever their names, and an empty table stays empty.
    """
    blocks, bits = cheapest_cover(docs.count())
    longs = -(-max(128, blocks * bits) // 64)
    whole = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = saved(set_fingerprints(whole, width, longs).withColumn("at", F.monotonically_increasing_id()), "marked-documents")
    least = F.min(F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id").alias("doc_id"), "at")).alias("least")
    sets = saved(marked.groupBy("key", "n").agg(F.min("fp").alias("fp"), F.min("more").alias("more"), F.min("prefix").alias("prefix"), least), "distinct-sets")
    roots = linked(sets.where("n > 0").select("fp", "more").distinct(), distance, [bits] * blocks, 1, also=prefix_links(sets))
    rooted = saved(sets.join(roots, F.col("fp") == F.col("node"), "left").select("key", "n", "least", F.coalesce("root", "fp").alias("root")), "candidates")
    several = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") > 1).select("root")
    members = rooted.join(several, "root", "left_semi").select("root", "key", "n", F.col("least.at").alias("at"))
    texts = marked.select("at", F.col("row.text").alias("text")).join(members, "at").select("root", "key", "n", "text")
    same = components(saved(verified(texts, width, most), "links"))
    grouped = rooted.join(same.withColumnRenamed("root", "group"), F.col("key") == F.col("node"), "left").select("least", F.coalesce("group", "key").alias("group"))
    stay = saved(grouped.groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.at").alias("at")), "stay")
    return marked.join(stay, "at", "left_semi").select("row.*")


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 4-word shingles, links at 4 or fewer differing bits."""
    out = near_duplicates(dealt(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
