"""Alignments of token sequences, edit scripts and edit-flow steps. -1 is the blank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform

BLANK = -1
PAIR, DELETION, INSERTION = 0, 1, 2


#: Cells of the way that are held at once.
CELLS = 1 << 26


def _rows(a: np.ndarray, b: np.ndarray, cost: np.ndarray, sub: int, gap: int, way: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Cost rows below the row `cost`, one per element of a; with way also how each cell is reached best."""
    ramp = np.arange(len(b) + 1, dtype=np.int64) * gap
    for i, x in enumerate(a):
        up, pair = cost + gap, cost[:-1] + np.where(b == x, 0, sub)
        row = up.copy()
        row[1:] = np.minimum(row[1:], pair)
        cost = np.minimum.accumulate(row - ramp) + ramp
        if way is not None:
            way[i] = np.where(cost == up, DELETION, INSERTION)
            way[i, 1:][cost[1:] == pair] = PAIR
        yield cost


def aligned(x0: list[int], x1: list[int], sub: int = 1, gap: int = 1, cells: int = CELLS) -> tuple[list[int], list[int], int]:
    """Global alignment (z0, z1, cost); at equal cost a pair is preferred to a deletion, that to an insertion.

    Costs are filled row by row: what depends on the row above is one array step, and insertions along the row are a
    running minimum. Only every so many rows are kept; going back, the rows between two of them are filled again with the way of
    each cell, at most about `cells` bytes at a time. So memory is that of some rows and one block, and work twice the table.
    """
    a, b = np.asarray(x0, dtype=np.int64), np.asarray(x1, dtype=np.int64)
    width = len(b) + 1
    block = max(1, cells // width, int((8 * len(a)) ** 0.5) if width > cells // 64 else 1)
    cost, kept = np.arange(width, dtype=np.int64) * gap, {}
    kept[0] = cost
    for i, cost in enumerate(_rows(a, b, cost, sub, gap), 1):
        if i % block == 0:
            kept[i] = cost
    z0, z1, i, j, top, way = [], [], len(a), len(b), len(a) + 1, None
    total = int(cost[-1])
    while i or j:
        if i and i <= top:
            top = (i - 1) // block * block
            way = np.empty((min(block, len(a) - top), width), dtype=np.uint8)
            for _ in _rows(a[top : top + len(way)], b, kept.pop(top), sub, gap, way):
                pass
        step = way[i - 1 - top, j] if i else INSERTION
        pair, up = step == PAIR, step == DELETION
        i, j = i - bool(pair or up), j - bool(pair or not up)
        z0.append(int(a[i]) if pair or up else BLANK)
        z1.append(int(b[j]) if pair or not up else BLANK)
    return z0[::-1], z1[::-1], total


def align(df: DataFrame, key: str, x0: str = "x0", x1: str = "x1", sub: int = 1, gap: int = 1) -> DataFrame:
    """(key, z0, z1, cost); Arrow batches, a row at a time inside. Null sequences are empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [aligned([] if a is None else a, [] if b is None else b, sub, gap) for a, b in zip(pdf[x0], pdf[x1], strict=True)]
            yield pd.DataFrame({key: pdf[key], "z0": [o[0] for o in out], "z1": [o[1] for o in out], "cost": [o[2] for o in out]})

    return df.select(key, x0, x1).mapInPandas(run, f"{key} {kind}, z0 array<int>, z1 array<int>, cost long")


def strip_blanks(z: Column) -> Column:
    return F.array_remove(z, BLANK)


def remaining_edits(zt: Column, z1: Column) -> Column:
    """Edits (kind, pos, token) that take zt to z1: INS after the previous token, DEL and SUB at the token's place.

    How many tokens stand before a place is found from the tokens' own places: token k is that of the places after token k - 1 up
    to its own, so the whole is linear in the length.
    """

    def edit(kind: str, pos: Column, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), token.cast("int").alias("token"))

    def counted(z: Column) -> Column:
        """Tokens before each place of z; a lambda over one element binds the tokens' places once."""
        places = F.filter(F.transform(z, lambda x, i: F.when(x != BLANK, i)), lambda i: i.isNotNull())
        ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(z) - 1))
        spread = lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.array_repeat(k, (F.get(e, k + 1) - F.get(e, k)).cast("int"))))
        return F.element_at(F.transform(F.array(ends), spread), 1)

    def made(z: Column) -> Column:
        a, b, n = z["a"], z["b"], z["n"]
        out = F.when(a == b, F.lit(None)).when(a == BLANK, edit("INS", F.greatest(n - 1, F.lit(0)), b))
        return out.when(b == BLANK, edit("DEL", n, F.lit(None))).otherwise(edit("SUB", n, b))

    rows = F.arrays_zip(zt.alias("a"), z1.alias("b"), counted(zt).alias("n"))
    return F.when(F.size(zt) > 0, F.filter(F.transform(rows, made), lambda e: e.isNotNull())).otherwise(F.array().cast("array<struct<kind:string,pos:int,token:int>>"))


def out_of_range(edits: Column, size: Column) -> Column:
    """Number of edits whose place is not in the sequence."""
    return F.size(F.filter(edits, lambda e: (e["pos"] < 0) | (e["pos"] >= size)))


def fire_prob(rate: Column, tau: float) -> Column:
    """rate tau, kept in [0, 1 - 1e-6]."""
    return F.least(F.greatest(rate * tau, F.lit(0.0)), F.lit(1 - 1e-6))


def pick_token(logits: Column, temperature: float, u: Column) -> Column:
    """Of an array of logits: the first best at temperature 0 and below, else the first at which the running probability reaches u."""
    if temperature <= 0:
        return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    seen = F.aggregate(e, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when(a["s"] + x < u * total, 1).otherwise(0)).alias("n")))["n"]
    return F.least(seen, F.size(logits) - 1)


def tau_leap(rows: DataFrame, tau: float, weight: Column | float = 1.0, temperature: float = 0.0, edit_prompt: bool = False, seed: int | str = 0) -> DataFrame:
    """One step of (seq, pos, tok, prompt_len, del_rate, sub_rate, ins_rate, sub_logits, ins_logits), adding op, ins and out.

    Deletions and substitutions fire together with their summed rate and are told apart by its shares; insertions
    fire on their own. The prompt is kept, but something may be inserted after its last token. out are the ids
    that take the place of the token; op is DEL, SUB or KEEP.
    """
    w = weight if isinstance(weight, Column) else F.lit(weight)
    n = F.greatest(F.lit(1), F.col("prompt_len"))
    open_ = F.lit(True) if edit_prompt else F.col("pos") >= n
    gap = F.lit(True) if edit_prompt else F.col("pos") >= n - 1
    rate = lambda c, free: F.when(free, F.col(c) * w).otherwise(0.0)
    d, s, i = rate("del_rate", open_), rate("sub_rate", open_), rate("ins_rate", gap)
    u = lambda what: uniform(F.concat_ws("/", "seq", "pos"), f"{seed}{what}")
    fires = u("fire") < fire_prob(d + s, tau)
    deletes = u("which") < F.least(F.greatest(d / (d + s + 1e-8), F.lit(0.0)), F.lit(1.0))
    op = F.when(fires & deletes, "DEL").when(fires, "SUB").otherwise("KEEP")
    ins = F.when(u("ins") < fire_prob(i, tau), pick_token(F.col("ins_logits"), temperature, u("ins_token")))
    out = rows.withColumns({"op": op, "ins": ins})
    new = F.when(F.col("op") == "SUB", pick_token(F.col("sub_logits"), temperature, u("sub_token"))).when(F.col("op") == "KEEP", F.col("tok"))
    return out.withColumn("out", F.array_compact(F.array(new, F.col("ins"))))


def labelled(stepped: DataFrame) -> DataFrame:
    """Adds after_ops to tau_leap's rows: of each id in out, whether it was kept, substituted or inserted."""
    return stepped.withColumn("after_ops", F.array_compact(F.array(F.when(F.col("op") != "DEL", F.col("op")), F.when(F.col("ins").isNotNull(), "INS"))))


def rebuilt(stepped: DataFrame) -> DataFrame:
    """(seq, ids, edited) of tau_leap's rows."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "out")))
    return stepped.groupBy("seq").agg(F.flatten(F.transform(parts, lambda x: x["out"])).alias("ids"), F.bool_or((F.col("op") != "KEEP") | F.col("ins").isNotNull()).alias("edited"))
