"""Reproducible corruption of token sequences and the losses on it. Long form is (seq, pos, tok, ...)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import uniform
from ..storage import saved
from . import align as E

IGNORE = -100


def draw_time(key: Column, seed: int | str, eps: float = 1e-3) -> Column:
    """t = eps + (1 - eps) u per sequence."""
    return eps + (1 - eps) * uniform(key, seed)


def masked_at(key: Column, pos: Column, prob: Column, labels: Column, seed: int | str) -> Column:
    """Whether a token is masked: u < prob and its label counts."""
    return (uniform(F.concat_ws("/", key.cast("string"), pos.cast("string")), seed) < prob) & (labels != IGNORE)


def mask_tokens(df: DataFrame, key: str, prob: Column, mask: int, seed: int | str) -> DataFrame:
    """Adds noised (input_ids with masks) and masked (booleans) to rows with input_ids and labels."""
    flags = F.transform(F.arrays_zip("input_ids", "labels"), lambda z, i: masked_at(F.col(key), i, prob, z["labels"], seed))
    rows = df.withColumn("masked", flags)
    return rows.withColumn("noised", F.zip_with("input_ids", "masked", lambda x, m: F.when(m, mask).otherwise(x)))


def loss_weight(kind: str, t: Column, schedule=None) -> Column:
    """`scheduler` weights by the schedule at t, `uniform` is 1."""
    if kind == "scheduler":
        return schedule.weight(t)
    if kind == "uniform":
        return F.lit(1.0)
    raise ValueError(f"unknown loss weight {kind!r}")


def _decayed(x: np.ndarray, q: float) -> np.ndarray:
    """s with s[0] = 0 and s[j + 1] = q s[j] + x[j], without the last: scaled prefix sums over pieces short enough for the scale."""
    out = np.zeros(len(x))
    size = 1 if q <= 0 else int(min(4096, max(1.0, 280 / max(-math.log10(q), 1e-9))))
    scale, carry = q ** np.arange(size, dtype=np.float64), 0.0
    for low in range(0, len(x), size):
        part = x[low : low + size]
        own = scale[: len(part)]
        before = np.concatenate([[0.0], np.cumsum(part[:-1] / own[1:] if len(part) > 1 else part[:0])]) * own
        out[low : low + size] = own * carry + before
        carry = q * out[low + len(part) - 1] + part[-1]
    return out


def context_weights(masked: Column, p: float = 0.3) -> Column:
    """Of each masked place: the sum over unmasked places i of 0.5 p (1 - p)^max(|i - j| - 1, 0); 0 elsewhere.

    A geometric sum runs from each side instead of a sum per pair; Arrow batches, linear in the places. A null row stays null.
    """
    q = 1 - p

    @F.pandas_udf("array<double>")
    def weights(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            flags = np.asarray(row, dtype=bool)
            free = 1.0 - flags
            out.append(np.where(flags, 0.5 * p * (_decayed(free, q) + _decayed(free[::-1], q)[::-1]), 0.0))
        return pd.Series(out, dtype=object)

    return weights(masked)


def geometric_p(kind: str) -> float:
    """p of `cart[geo_p:0.3]`, 0.3 if none is named."""
    import re

    found = re.search(r"geo_p:([0-9.]+)", kind)
    return float(found[1]) if found else 0.3


def cross_entropy(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """(seq, pos, ce): -log softmax at the target of logits (seq, pos, tok, logit), the maximum taken off first.

    The maximum per position is one small aggregate; the sum and the target's logit come from one more pass, and neither
    holds a vocabulary in memory.
    """
    top = logits.groupBy("seq", "pos").agg(F.max("logit").alias("top"))
    wanted = targets.select("seq", "pos", F.col("tok").alias("want"))
    rows = logits.join(top.join(wanted, ["seq", "pos"]), ["seq", "pos"])
    sums = rows.groupBy("seq", "pos").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("logit") - F.col("top"))).alias("total"), F.max(F.when(F.col("tok") == F.col("want"), F.col("logit"))).alias("own"))
    return sums.where("own IS NOT NULL").select("seq", "pos", (F.col("top") + F.log("total") - F.col("own")).alias("ce"))


def loss_norms(rows: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """loss per `by` of rows (seq, ce, weight, masked, counts): counts marks maskable tokens.

    token: over all maskable tokens; sequence: over each sequence's, then their mean; batch: over sequences.
    """
    value = F.when(F.col("masked"), F.col("ce") * F.col("weight")).otherwise(0.0)
    per = rows.groupBy(*by, "seq").agg(F.sum(value).alias("v"), F.count_if("counts").alias("n"))
    if kind == "token":
        loss = F.sum("v") / F.greatest(F.sum("n"), F.lit(1))
    elif kind == "sequence":
        loss = F.avg(F.col("v") / F.greatest(F.col("n"), F.lit(1)))
    elif kind == "batch":
        loss = F.sum("v") / F.greatest(F.count(F.lit(1)), F.lit(1))
    else:
        raise ValueError(f"unknown loss norm {kind!r}")
    return per.groupBy(*by).agg(loss.alias("loss"))


def eval_step(rows: DataFrame, logits: DataFrame, kind: str, by: list[str], loss_only: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(loss per `by`, logits, labels (seq, pos, tok)) of rows (*by, seq, pos, tok, weight, masked, counts); without the last two if only the loss is asked for."""
    scored = rows.join(cross_entropy(logits, rows.select("seq", "pos", "tok")), ["seq", "pos"])
    loss = loss_norms(scored, kind, by)
    return (loss, None, None) if loss_only else (loss, logits, rows.select("seq", "pos", "tok"))


def label_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose counted labels differ from their ids.

    Both columns pass a generator, through which no filter is pushed down: there their expressions would stand in for them and
    be evaluated again, token ids in an element's condition once an element.
    """
    own = F.inline(F.array(F.struct("input_ids", "labels"))).alias("_ids", "_labels")
    rows = df.select(*[c for c in df.columns if c not in ("input_ids", "labels")], own).withColumnsRenamed({"_ids": "input_ids", "_labels": "labels"}).select(df.columns)
    return rows.where(F.exists(F.arrays_zip("input_ids", "labels"), lambda z: (z["labels"] != IGNORE) & (z["labels"] != z["input_ids"])))


def bos_if_needed(df: DataFrame, batch: str, bos: int) -> DataFrame:
    """For shifted logits: BOS in front of a batch's rows, unless all of them begin with an ignored label."""
    begun = F.bool_and(F.coalesce(F.get("labels", F.lit(0)) == IGNORE, F.lit(False))).over(Window.partitionBy(batch))
    rows = df.withColumn("_begun", begun)
    front = lambda c, v: F.when(F.col("_begun"), F.col(c)).otherwise(F.concat(F.array(F.lit(v)), F.col(c)))
    return rows.withColumns({"input_ids": front("input_ids", bos), "labels": front("labels", IGNORE)}).drop("_begun")


def doubled(df: DataFrame) -> DataFrame:
    """Block diffusion rows: noised ids before clean ones, positions twice."""
    at = F.transform("input_ids", lambda _, i: i)
    return df.withColumns({"pair_ids": F.concat("noised", "input_ids"), "positions": F.concat(at, at)})


def block_mask(q: Column, k: Column, block: int, n: int | Column) -> Column:
    """Attention of block diffusion training over 2 n places, the noised half first."""
    clean_q, clean_k = q >= n, k >= n
    block_of = lambda x, clean: F.floor(F.when(clean, x - n).otherwise(x) / block)
    bq, bk = block_of(q, clean_q), block_of(k, clean_k)
    own = (bq == bk) & (clean_q == clean_k)
    context = (bq > bk) & clean_k & ~clean_q
    causal = (bq >= bk) & clean_k & clean_q
    return own | context | causal


def edit_time(key: Column, seed: int | str, eps: float = 1e-3) -> Column:
    return (1 - eps) * uniform(key, seed)


def clamped_weight(schedule, t: Column, most: float = 20.0) -> Column:
    return F.least(schedule.weight(t), F.lit(most))


def mix(z0: Column, z1: Column, kappa: Column, key: Column, seed: int | str) -> Column:
    """Per aligned place: z1 with probability kappa, else z0."""
    return F.transform(F.arrays_zip(z0.alias("a"), z1.alias("b")), lambda z, i: F.when(uniform(F.concat_ws("/", key.cast("string"), i.cast("string")), seed) < kappa, z["b"]).otherwise(z["a"]))


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def edit_flow_loss(edits: DataFrame, rates: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq, loss): survival (rates summed, weighted) less the weighted log-rates of the remaining edits, over the target's length.

    edits: (seq, kind, pos, token); rates: (seq, pos, kind, rate, log_prob, token) with log_prob of the token named
    (null for DEL); weights: (seq, weight, target_len).
    """
    survival = rates.groupBy("seq", "pos", "kind").agg(F.first("rate").alias("rate")).groupBy("seq").agg(F.sum("rate").alias("survival"))
    held = edits.alias("e").join(rates.alias("r"), (F.col("e.seq") == F.col("r.seq")) & (F.col("e.pos") == F.col("r.pos")) & (F.col("e.kind") == F.col("r.kind")) & F.col("e.token").eqNullSafe(F.col("r.token")))
    gain = held.select(F.col("e.seq").alias("seq"), (safe_log(F.col("r.rate")) + F.coalesce("r.log_prob", F.lit(0.0))).alias("g")).groupBy("seq").agg(F.sum("g").alias("gain"))
    rows = weights.join(survival, "seq", "left").join(gain, "seq", "left")
    value = F.col("weight") * (F.coalesce("survival", F.lit(0.0)) - F.coalesce("gain", F.lit(0.0)))
    return rows.select("seq", (value / F.greatest(F.col("target_len"), F.lit(1))).alias("loss"))


#: From (seq, pos, tok, t) to (rates, tokens): (seq, pos, del_rate, sub_rate, ins_rate) and the full vocabulary's (seq, pos, kind, token, logit) for SUB and INS.
EditRates = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def edit_flow_pairs(pairs: DataFrame, kappa, seed: int | str, most: float = 20.0, eps: float = 1e-3, fixed_t: Column | None = None) -> DataFrame:
    """(seq, t, weight, z0, z1, zt, xt, edits, target_len) of pairs (seq, x0, x1): aligned, mixed at a drawn time, with the edits that are left.

    x0 and x1 begin with the same token, which no edit touches.
    """
    rows = E.align(pairs, "seq").join(pairs.select("seq", F.size("x1").alias("target_len")), "seq")
    t = fixed_t if fixed_t is not None else edit_time(F.col("seq"), f"{seed}/t", eps)
    timed = rows.withColumn("t", t).withColumn("weight", clamped_weight(kappa, F.col("t"), most))
    mixed = timed.withColumn("zt", mix(F.col("z0"), F.col("z1"), kappa(F.col("t")), F.col("seq"), f"{seed}/mix"))
    return mixed.withColumns({"xt": E.strip_blanks(F.col("zt")), "edits": E.remaining_edits(F.col("zt"), F.col("z1"))}).drop("cost")


def edit_flow_step(pairs: DataFrame, rates: EditRates, kappa, seed: int | str, per_position: bool = True, most: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """One training step on pairs (seq, x0, x1): ((seq, loss), the stored rows of edit_flow_pairs).

    An edit outside x_t raises. Without per_position losses are not divided by the target's length.
    """
    rows = saved(edit_flow_pairs(pairs, kappa, seed, most), "edit-pairs")
    canvas = rows.select("seq", "t", F.posexplode("xt").alias("pos", "tok"))
    by_place, tokens = rates(canvas)
    held = by_place.join(canvas.select("seq", "pos"), ["seq", "pos"])
    survival = held.groupBy("seq").agg(F.sum(F.col("del_rate") + F.col("sub_rate") + F.col("ins_rate")).alias("survival"))
    edits = rows.select("seq", F.size("xt").alias("n"), F.explode("edits").alias("e")).select("seq", "n", "e.kind", "e.pos", "e.token")
    inside = F.when((F.col("pos") >= 0) & (F.col("pos") < F.col("n")), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("edit outside the sequence: "), F.col("pos").cast("string"))).cast("int"))
    edits = edits.withColumn("pos", inside).drop("n")
    rate = F.when(F.col("kind") == "DEL", F.col("del_rate")).when(F.col("kind") == "SUB", F.col("sub_rate")).otherwise(F.col("ins_rate"))
    priced = edits.join(held, ["seq", "pos"]).groupBy("seq").agg(F.sum(safe_log(rate)).alias("rate_gain"))
    wanted = edits.where("kind <> 'DEL'")
    places = wanted.select("seq", "pos", "kind").distinct()
    top = tokens.join(places, ["seq", "pos", "kind"], "left_semi").groupBy("seq", "pos", "kind").agg(F.max("logit").alias("top"))
    norms = tokens.join(top, ["seq", "pos", "kind"]).groupBy("seq", "pos", "kind").agg((F.max("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))).alias("norm"))
    named = wanted.join(tokens, ["seq", "pos", "kind", "token"]).join(norms, ["seq", "pos", "kind"]).groupBy("seq").agg(F.sum(F.col("logit") - F.col("norm")).alias("token_gain"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = rows.select("seq", "weight", "target_len").join(survival, "seq", "left").join(priced, "seq", "left").join(named, "seq", "left")
    value = F.col("weight") * (zero("survival") - zero("rate_gain") - zero("token_gain"))
    size = F.greatest(F.col("target_len"), F.lit(1)) if per_position else F.lit(1)
    return joined.select("seq", (value / size).alias("loss")), rows
