"""Weighted losses, perplexities and Monte-Carlo likelihoods as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import uniform


def nll(value: str = "value", weight: str = "weight") -> Column:
    """Weighted mean, 0 without weight; partial sums combine over any grouping."""
    w = F.sum(weight)
    return F.when(w == 0, 0.0).otherwise(F.sum(F.col(value) * F.col(weight)) / w)


def perplexity(value: str = "value", weight: str = "weight") -> Column:
    return F.exp(nll(value, weight))


METRICS = {"nll": nll, "ppl": perplexity}


def meter(df: DataFrame, split: str = "split", metrics: dict | None = None) -> DataFrame:
    """One row a split, one column a metric. Own metrics are functions of nothing that give an aggregate Column."""
    return df.groupBy(split).agg(*[m().alias(k) for k, m in (metrics or METRICS).items()])


def named(df: DataFrame, split: str = "split") -> DataFrame:
    """(name, metric value) rows, prefixed by the split unless it is train; what a log line holds."""
    names = [c for c in df.columns if c != split]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]))
    return df.select(split, pairs.alias("p")).select(F.when(F.col(split) == "train", F.col("p.metric")).otherwise(F.concat_ws("_", split, "p.metric")).alias("name"), F.col("p.value").alias("value"))


def mask_counts(batch: Column, k: Column, size: int, target: Column) -> Column:
    """Of draw `batch` (from 0) of `size`: round-half-even of k + batch target / size, wrapped into 1 .. target."""
    x = F.bround(k.cast("double") + batch * (target.cast("double") / size)).cast("long")
    return F.pmod(x - 1, target) + 1


def stratified_masks(places: DataFrame, draw: str, count: str, seed: int | str) -> DataFrame:
    """Adds masked to (seq, draw, pos, count): `count` of a draw's places, in a random order of their own."""
    w = Window.partitionBy("seq", draw).orderBy(uniform(F.concat_ws("/", "seq", draw, "pos"), seed), "pos")
    return places.withColumn("masked", F.row_number().over(w) <= F.col(count))


def spread_times(index: Column, n: int, start: Column) -> Column:
    """(start + i / n) mod 1."""
    return F.pmod(start + index / n, F.lit(1.0))


def edge_safe(masked: Column, pos: Column, length: Column) -> Column:
    """First and last token are never masked."""
    return masked & (pos > 0) & (pos < length - 1)


def mc_loglikelihood(rows: DataFrame) -> DataFrame:
    """(seq, loglik) of (seq, draw, ce, p_mask, masked): minus the mean over draws of sum ce / p_mask."""
    per = rows.groupBy("seq", "draw").agg(F.sum(F.when(F.col("masked"), F.col("ce") / F.col("p_mask")).otherwise(0.0)).alias("v"))
    return per.groupBy("seq").agg((-F.avg("v")).alias("loglik"))


def direction(kind: str, pos: Column, prompt_len: Column) -> Column:
    """Places that may be masked: ftb the continuation, btf the context, union all."""
    if kind == "ftb":
        return pos >= prompt_len
    if kind == "btf":
        return pos < prompt_len
    if kind == "union":
        return F.lit(True)
    raise ValueError(f"unknown direction {kind!r}")


def triangular(places: DataFrame) -> DataFrame:
    """(seq, step, pos, masked): row `step` hides itself and all later places of the continuation; its own place is scored."""
    steps = places.select("seq", F.col("pos").alias("step"), F.col("prompt_len").alias("_p")).where(F.col("step") >= F.col("_p"))
    return steps.join(places, "seq").select("seq", "step", "pos", (F.col("pos") >= F.col("step")).alias("masked"))


def ar_nll(scored: DataFrame) -> DataFrame:
    """(seq, nll): the diagonal of (seq, step, pos, ce)."""
    return scored.where("step = pos").groupBy("seq").agg(F.sum("ce").alias("nll"))


def greedy_match(proposals: DataFrame, targets: DataFrame) -> DataFrame:
    """(seq, greedy): whether all proposed tokens are the targets'."""
    both = targets.select("seq", "pos", F.col("tok").alias("want")).join(proposals, ["seq", "pos"], "left")
    return both.groupBy("seq").agg(F.bool_and(F.coalesce(F.col("tok") == F.col("want"), F.lit(False))).alias("greedy"))


def greedy_decoded(canvas: DataFrame, score: Callable[[DataFrame], DataFrame], mask: int, targets: DataFrame) -> DataFrame:
    """(seq, greedy, equal): whether the masks of a canvas (seq, pos, tok, is_valid) become the targets (seq, pos, tok) if, step after step, the one most confident place is written.

    The scorer sees the canvas of each step. equal counts the places that do. All sequences go on together, each with a quota
    of one, so there are as many steps as the longest continuation has places.
    """
    from .samplers import Options, run

    rows = canvas.where((F.col("tok") == mask) & F.col("is_valid")).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    most = rows.agg(F.max("n")).first()[0] or 1
    width = (canvas.agg(F.max("pos")).first()[0] or 0) + 1
    final = run(canvas.drop("start"), score, mask, Options(steps=most, block_size=width))[0]
    both = targets.select("seq", "pos", F.col("tok").alias("want")).join(final, ["seq", "pos"], "left")
    same = F.coalesce(F.col("tok") == F.col("want"), F.lit(False))
    return both.groupBy("seq").agg(F.bool_and(same).alias("greedy"), F.count_if(same).alias("equal"))


def loglikelihood(draws: DataFrame, proposals: DataFrame, targets: DataFrame, lengths: DataFrame | None = None, max_length: int | None = None) -> DataFrame:
    """(seq, loglik, greedy) per request: the Monte-Carlo score of draws (mc_loglikelihood's rows) and whether the proposals are the targets.

    With lengths (seq, n), a request longer than max_length raises.
    """
    out = mc_loglikelihood(draws).join(greedy_match(proposals, targets), "seq", "left")
    if lengths is None or max_length is None:
        return out
    fits = F.when(F.col("n") <= max_length, F.col("loglik")).otherwise(F.raise_error(F.concat(F.lit("request too long: "), F.col("n").cast("string"))).cast("double"))
    return out.join(lengths, "seq").withColumn("loglik", fits).drop("n")


def answers(final: DataFrame, prompts: DataFrame, vocabulary: DataFrame, pad: int, stops: list[int], until: Column) -> DataFrame:
    """(seq, answer) of a decoded canvas (seq, pos, tok): prompt (seq, prompt array) and pads off, up to the first stop id, as text, cut at each stop string in turn."""
    from . import pack as P
    from . import text as X

    ids = final.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("ids"))
    body = ids.join(prompts, "seq").select("seq", P.trim_sample(F.col("ids"), F.col("prompt"), pad, stops).alias("ids"))
    return X.decode(body, "seq", "ids", vocabulary).select("seq", P.cut_at_stops(F.col("text"), until).alias("answer"))


@dataclass(frozen=True)
class EvalConfig:
    batch_size: int = 32
    mc_num: int = 128
    max_length: int = 4096
    steps: int = 128
    block_size: int = 128
    temperature: float = 0.0
    suppress_tokens: list[int] = field(default_factory=list)


#: Evaluation settings by the program's name; register(name, ...) adds own ones.
EVALUATIONS: dict[str, EvalConfig] = {
    "masked": EvalConfig(),
    "block": EvalConfig(block_size=32),
    "prefix_cached": EvalConfig(block_size=32),
    "both_cached": EvalConfig(block_size=32),
    "carry": EvalConfig(block_size=32),
    "shifted": EvalConfig(steps=512),
}


def register(name: str, config: EvalConfig) -> None:
    EVALUATIONS[name] = config


def program(name: str, source: object = None, **given: object):
    """(evaluation settings, options of the sampler) of a registered name: what is given wins over source, that over the name's own.

    Token lists may be text such as `[1;2]`. An own name needs a program of the same name.
    """
    from dataclasses import replace

    from ..sources.specs import merge_options, token_list
    from .samplers import PROGRAMS

    if name not in EVALUATIONS or name not in PROGRAMS:
        raise ValueError(f"unknown evaluation {name!r}; known: {', '.join(sorted(EVALUATIONS.keys() & PROGRAMS.keys()))}")
    own = EVALUATIONS[name] if source is None else merge_options(EvalConfig, source)
    if given.get("suppress_tokens") is not None:
        given = given | {"suppress_tokens": token_list(given["suppress_tokens"])}
    config = merge_options(EvalConfig, own, **given)
    return config, replace(PROGRAMS[name], steps=config.steps, block_size=config.block_size, temperature=config.temperature, suppress=tuple(config.suppress_tokens))
