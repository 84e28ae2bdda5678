"""Token rows: labels, clips, packing, padding and what collators do. Arrays of ints throughout; -100 is the ignored label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import uniform

IGNORE = -100
COLUMNS = ("input_ids", "labels", "attention_mask")


def _int(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def empty_ids() -> Column:
    return F.array().cast("array<int>")


def filled(value: int | Column, n: int | Column) -> Column:
    """n times value, none for n <= 0."""
    return F.array_repeat(_int(value), F.greatest(_int(n), F.lit(0)).cast("int"))


def sft_labels(ids: Column, prompt_len: Column) -> Column:
    """The ids with the prompt's ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_len, IGNORE).otherwise(x))


def append_eos(ids: Column, eos: int) -> Column:
    """EOS at the end unless it is there; an empty row becomes the EOS alone."""
    there = F.coalesce(F.get(ids, F.size(ids) - 1) == eos, F.lit(False))
    return F.when(there, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def ensure_bos(ids: Column, bos: int) -> Column:
    return F.when(F.coalesce(F.get(ids, F.lit(0)) == bos, F.lit(False)), ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def prepend_bos(df: DataFrame, bos: int | None) -> DataFrame:
    """BOS on ids, an ignored label, 1 on the mask, on the columns that there are."""
    if not bos:
        raise ValueError("a BOS id is needed")
    front = {"input_ids": bos, "labels": IGNORE, "attention_mask": 1}
    return df.withColumns({c: F.concat(F.array(F.lit(v)), F.col(c)) for c, v in front.items() if c in df.columns})


def clip(ids: Column, n: int, side: str = "right") -> Column:
    """right keeps the first n, left the last n."""
    if side not in ("right", "left"):
        raise ValueError(f"unknown truncation {side!r}")
    return F.slice(ids, 1, n) if side == "right" else F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, n)


def clip_rows(df: DataFrame, n: int, side: str = "right", keep_prompt: bool = False) -> DataFrame:
    """Clips all token columns. keep_prompt: rows with prompt_len >= 0 keep the prompt whole and clip the response to what is left."""
    def cut(c: str) -> Column:
        plain = clip(F.col(c), n, side)
        if not keep_prompt or "prompt_len" not in df.columns:
            return plain
        p, size = F.col("prompt_len"), F.size(c)
        budget, rest = F.greatest(F.lit(n) - p, F.lit(0)), F.greatest(size - p, F.lit(0))
        response = F.slice(F.col(c), p + 1, rest)
        kept = F.slice(response, 1, budget) if side == "right" else F.slice(response, F.greatest(rest - budget, F.lit(0)) + 1, budget)
        return F.when(p >= 0, F.concat(F.slice(F.col(c), 1, p), kept)).otherwise(plain)

    return df.withColumns({c: cut(c) for c in COLUMNS if c in df.columns})


def post_process(df: DataFrame, max_length: int, truncation: str) -> DataFrame:
    """filter drops longer rows; right clips, after dropping rows whose prompt alone is longer."""
    if truncation == "filter":
        return df.where(F.size("input_ids") <= max_length)
    if truncation == "right":
        fits = df.where(F.col("prompt_len") <= max_length) if "prompt_len" in df.columns else df
        return clip_rows(fits, max_length)
    raise ValueError(f"unknown truncation {truncation!r}")


def pack(df: DataFrame, length: int, group: str, order: str, drop_tail: bool = True, ids: str = "input_ids") -> DataFrame:
    """(group, chunk, input_ids, labels): a group's ids in order, cut every `length` ids; the shorter last chunk stays if asked for.

    Documents find the chunks they touch from their running offset. Ids are shuffled once, by group: a group's chunks are
    put together where its offsets are counted. Groups spread the work, so they should be bounded.
    """
    n = F.size(ids).cast("long")
    w = Window.partitionBy(group).orderBy(order)
    placed = df.select(group, F.col(order).alias("_order"), F.col(ids).alias("_ids"), n.alias("_n"), (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("_at")).where("_n > 0")
    first, last = F.expr(f"_at div {length}"), F.expr(f"(_at + _n - 1) div {length}")
    parts = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("chunk") * length - F.col("_at"), F.lit(0))
    hi = F.least((F.col("chunk") + 1) * length - F.col("_at"), F.col("_n"))
    cut = parts.select(group, "chunk", "_order", F.slice("_ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_part"))
    joined = cut.groupBy(group, "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_part"))), lambda x: x["_part"])).alias("input_ids"))
    out = joined.withColumn("labels", F.col("input_ids"))
    return out.where(F.size("input_ids") == length) if drop_tail else out


def pad_batch(df: DataFrame, batch: str, pad: int, label_pad: int = IGNORE) -> DataFrame:
    """Token columns padded on the right to the batch's longest; adds or pads attention_mask with 0."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    have = df if "attention_mask" in df.columns else df.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    wide = have.withColumn("_width", width)
    values = {"input_ids": pad, "labels": label_pad, "attention_mask": 0}
    out = wide.withColumns({c: F.concat(F.col(c), filled(v, F.col("_width") - F.size(c))) for c, v in values.items() if c in wide.columns})
    return out.drop("_width")


def block_pad(ids: Column, eos: int, block: int) -> Column:
    """EOS up to a multiple of block."""
    return F.concat(ids, filled(eos, F.pmod(-F.size(ids), F.lit(block))))


def random_truncate(df: DataFrame, batch: str, prob: float, seed: int) -> DataFrame:
    """With probability prob a batch gets a length L from 1 to its rows' length: beyond it mask 0 and labels ignored, ids unchanged."""
    size = F.size("input_ids")
    widest = F.max(size).over(Window.partitionBy(batch))
    hit = uniform(F.col(batch), f"{seed}a") < prob
    length = F.floor(uniform(F.col(batch), f"{seed}b") * widest) + 1
    mask = F.col("attention_mask") if "attention_mask" in df.columns else F.transform("input_ids", lambda _: F.lit(1))
    cut = df.withColumn("_cut", F.when(hit, length).otherwise(widest)).withColumn("attention_mask", mask)
    out = cut.withColumn("attention_mask", F.transform("attention_mask", lambda x, i: F.when(i >= F.col("_cut"), 0).otherwise(x)))
    if "labels" in df.columns:
        out = out.withColumn("labels", F.transform("labels", lambda x, i: F.when(i >= F.col("_cut"), IGNORE).otherwise(x)))
    return out.drop("_cut")


def cut_responses(df: DataFrame, batch: str, key: str, seed: int) -> DataFrame:
    """One response length of the batch is chosen; longer responses are cut to it."""
    length = F.size("input_ids") - F.col("prompt_len")
    chosen = F.min_by(length, uniform(F.col(key), seed)).over(Window.partitionBy(batch))
    wide = df.withColumn("_cut", F.greatest(length - chosen, F.lit(0)))
    return wide.withColumns({c: F.slice(F.col(c), 1, F.size(c) - F.col("_cut")) for c in COLUMNS if c in df.columns}).drop("_cut")


def cut_padded(df: DataFrame, batch: str, seed: int, ratio: float = 1.0) -> DataFrame:
    """In a batch with probability ratio, cuts the same number of places, from 1 to the shortest response less 1, off all padded rows; nothing if that response has 1 or less."""
    w = Window.partitionBy(batch)
    shortest = F.min(F.col("n_ids") - F.col("prompt_len")).over(w)
    cut = F.floor(uniform(F.col(batch), seed) * (shortest - 1)) + 1
    wide = df.withColumn("_n", F.max("n_ids").over(w) - F.when((shortest > 1) & (uniform(F.col(batch), f"{seed}/hit") < ratio), cut).otherwise(0))
    return wide.withColumns({c: F.slice(F.col(c), F.lit(1), F.col("_n").cast("int")) for c in COLUMNS if c in df.columns}).drop("_n")


def cutting_collator(batch: str, key: str, pad: int, seed: int, per_batch: bool = False, ratio: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Pads batches after cutting their responses to a chosen length (per_batch), or cuts padded ones with probability ratio. Keeps key and batch and what a model reads."""

    def cut(df: DataFrame) -> DataFrame:
        if per_batch:
            return pad_batch(cut_responses(df, batch, key, seed), batch, pad)
        padded = pad_batch(df.withColumn("n_ids", F.size("input_ids")), batch, pad)
        return cut_padded(padded, batch, seed, ratio) if ratio > 0 else padded

    return collate(cut, lambda df: df.select(*dict.fromkeys((key, batch)), *COLUMNS))


def collate(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stacks before, base and after steps to one."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def drop_mask(df: DataFrame) -> DataFrame:
    return df.drop("attention_mask")


def start_sampler(spec: str, mask: int = 0) -> Column:
    """`empty` or `masks[length:n]`."""
    from ..sources.specs import parse_spec

    name, options = parse_spec(spec)
    if name == "empty":
        return empty_ids()
    if name == "masks":
        return filled(mask, int(options.get("length", 128)))
    raise ValueError(f"unknown start {spec!r}")


def edit_pairs(ids: Column, prompt_len: Column | None, start: Column, bos: int) -> tuple[Column, Column]:
    """(x0, x1): x1 the ids (BOS ensured if there is no prompt), x0 the prompt or BOS and then the start."""
    if prompt_len is None:
        x1 = ensure_bos(ids, bos)
        return F.concat(F.slice(x1, 1, 1), start), x1
    return F.concat(F.slice(ids, F.lit(1), prompt_len), start), ids


def _until(ids: Column, stops: list[int]) -> Column:
    """The ids before the first stop."""
    at = F.array_position(F.transform(ids, lambda x: x.isin(*stops)), True)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def without_left(ids: Column, pad: int) -> Column:
    """Leading pads off."""
    first = F.array_position(F.transform(ids, lambda x: x != pad), True)
    return F.when(first > 0, F.slice(ids, first.cast("int"), F.size(ids))).otherwise(empty_ids())


def trim_sample(ids: Column, prompt: Column, pad: int, stops: list[int]) -> Column:
    """Generated ids: pads off the left, the prompt's length cut, up to the first stop."""
    body = without_left(ids, pad)
    return _until(F.slice(body, F.size(prompt) + 1, F.greatest(F.size(body) - F.size(prompt), F.lit(0))), stops)


def trim_infill(ids: Column, prompt: Column, mask: int, pad: int, stops: list[int]) -> Column:
    """The ids at the prompt's masks, up to the first stop."""
    body = without_left(ids, pad)
    pairs = F.filter(F.arrays_zip(prompt.alias("p"), body.alias("x")), lambda z: z["p"] == mask)
    return _until(F.transform(pairs, lambda z: z["x"]), stops)


def bounded_pair(context: Column, continuation: Column, bos: Column, eos: Column, max_length: int) -> tuple[Column, Column]:
    """(ids, number of context ids left): start, context, continuation, end; where they are too long the left is cut."""
    ids = F.concat(F.array(bos), context, continuation, F.array(eos))
    return clip(ids, max_length, "left"), F.greatest(F.size(context) + 1 - F.greatest(F.size(ids) - max_length, F.lit(0)), F.lit(0))


def cut_at_stops(text: Column, until: Column) -> Column:
    """The text cut before each stop string in turn; empty stops do nothing."""
    return F.aggregate(until, text, lambda acc, s: F.when(F.length(s) > 0, F.split_part(acc, s, F.lit(1))).otherwise(acc))


def encode_pair(context: Column, continuation: Column, ids: Callable[[Column], Column] | None = None) -> tuple[Column, Column]:
    """Trailing white space of the context goes to the continuation.

    With ids, a tokenizer's Column function, token ids come back: the whole is encoded once, and its ids beyond as many as the context
    alone has are the continuation's, so a token that spans the border goes by that count.
    """
    tail = F.regexp_extract(context, r"(\s*)$", 1)
    left, right = F.substring(context, F.lit(1), F.length(context) - F.length(tail)), F.concat(tail, continuation)
    if ids is None:
        return left, right
    own, whole = ids(left), ids(F.concat(left, right))
    return own, F.slice(whole, F.size(own) + 1, F.greatest(F.size(whole) - F.size(own), F.lit(0)))
