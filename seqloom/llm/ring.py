"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 places. Every shard owns `vnodes` of them; a key belongs to the first virtual node
clockwise of its place. A shard takes its own keys up to its bound; keys that overflow continue
clockwise to the next virtual node whose shard has room. Bounds are floor(n / k) or one more and add
up to n, so every shard is full in the end and row counts differ by one at most (law `rows`), while
only overflowing keys leave the shard that plain consistent hashing gives them.

Only row counts per place (65,536 numbers, whatever the data) come to the driver, and the routes that
it makes of them (at most 65,536 + 16 x vnodes + shards rows) go back as a broadcast: both are bounded
by the ring, not by the data. DataFrame expressions only.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_ranks, saved, table

PLACES_BITS = 16
PLACES = 1 << PLACES_BITS


def virtual_nodes(n_shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in ring order, and their shards; a shared place goes to the lower shard."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            taken.setdefault(xxhash.xxh64_intdigest(f"{shard}/{v}".encode(), 42) >> (64 - PLACES_BITS), shard)
    places = sorted(taken)
    return places, [taken[p] for p in places]


def route(counts: dict[int, int], n_shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, slot of the first rank) that send every rank of every place to a shard.

    First all shards take their own keys in ring order, then the overflow walks clockwise in ring order.
    """
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot = [0] * n_shards
    nodes, owner = virtual_nodes(n_shards, vnodes)
    out, over = [], []

    def put(place: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            out.append((place, lo, lo + n, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return lo + n

    for place in sorted(counts):
        at = bisect_left(nodes, place) % len(nodes)
        lo = put(place, 0, counts[place], owner[at])
        if lo < counts[place]:
            over.append((place, lo, at))
    for place, lo, at in over:
        while lo < counts[place]:
            at = (at + 1) % len(nodes)
            if room[owner[at]]:
                lo = put(place, lo, counts[place], owner[at])
    return out


def shard_rows(df: DataFrame, key: str, others: list[str], n_shards: int = 16, vnodes: int = 128) -> DataFrame:
    """Columns key, *others, shard and slot: one row for each row of df.

    others are the columns to carry besides the key, of any names; carried columns named shard or slot are left out for
    the result's own. Equal rows are interchangeable. The place is the hash of the key alone: null keys share one place,
    null values in others are carried, and texts, however long, matter only if they are carried. Empty tables give
    empty results. Hot places and repeated rows are spread over tasks while ranks are counted.
    """
    if n_shards < 1 or vnodes < 1:
        raise ValueError("n_shards and vnodes must be positive")
    spark = df.sparkSession
    names = [key, *[c for c in others if c not in ("shard", "slot")]]
    plain = [f"k{i}" for i in range(len(names))]
    own = df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)])
    thin = saved(own.withColumn("_place", F.shiftrightunsigned(F.xxhash64("k0"), 64 - PLACES_BITS)), "ring-rows")
    counts = {r["_place"]: r["n"] for r in thin.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect()}
    routes = spark.createDataFrame(route(counts, n_shards, vnodes), "_at long, _lo long, _hi long, shard int, _slot long")
    ranked = gapless_ranks(thin, "_place", plain, spread=8)
    joined = ranked.join(F.broadcast(routes), (F.col("_place") == F.col("_at")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    back = [F.col(p).alias(c) for c, p in zip(names, plain, strict=True)]
    return joined.select(*back, "shard", (F.col("_slot") + F.col("rank") - F.col("_lo")).alias("slot"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`: counts at most one apart. Null texts count as empty: size 1 and the crc32 of nothing."""
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    out = shard_rows(docs, "doc_id", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
