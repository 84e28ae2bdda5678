"""Decoding programs: a driver loop over steps, each step one DataFrame plan over the canvas (seq, pos, tok, is_valid).

The scorer is injected: a function from the canvas to logits (seq, pos, tok, logit). A step is written once, as a table
in the shared folder, from which the next canvas is read; that cuts the lineage and survives lost executors. How
many masks are left is observed while it is written. Without a history a step's table is dropped once the next one
is there; with one, the steps are partitions of one table. Hooks take and give DataFrames.

Every sequence has its own quotas, by its own masks, in a relation (seq, quotas) that each step joins; what a sequence
becomes does not depend on its neighbours, but for the end of a program with a stop token, which waits for all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schedules as S
from ..storage import dropped, shared_folder
from ..storage import saved as _saved
from . import decode as L

#: Gets (seq, pos, tok, is_valid, asked): logits are wanted of the places that are asked for; others may be left out.
Score = Callable[[DataFrame], DataFrame]
Hook = Callable[[DataFrame], DataFrame]
#: Adds columns to a step's rows (seq, pos, tok, conf, now, masked, commit), given the logits that the step saw.
Measure = Callable[[DataFrame, DataFrame], DataFrame]
#: A quota that takes all that is left.
ALL = (1 << 31) - 1


@dataclass(frozen=True)
class Options:
    steps: int = 128
    block_size: int = 128
    temperature: float = 0.0
    confidence: str = "top"
    schedule: str = "linear"
    commit: str = "quota"  # quota, threshold, factor, hybrid, carry, soft, timed or random
    threshold: float = 0.9
    factor: float = 1.0
    soft_temperature: float = 0.1
    suppress: tuple[int, ...] = ()
    guidance: float = 0.0
    shift: bool = False
    stop_token: int | None = None
    top_p: float | None = None
    top_k: int | None = None
    filters: str = "p_then_k"  # or k_then_p
    even: bool = False  # quotas in equal parts of the block instead of the schedule's
    stochastic: bool = False  # quotas drawn from the binomial law instead of rounded
    first_from_full: bool = False  # a block's first place is written before its steps
    cache: str | None = None  # prefix or both: after a block's first step only its places (prefix: and those behind) are scored
    infills: bool = True
    remask: bool = False
    extra_steps: int = 0
    seed: int = 0
    eps: float = 1e-3
    token_hooks: tuple[Hook, ...] = field(default=())
    logit_hooks: tuple[Hook, ...] = field(default=())


#: Named settings of the programs.
PROGRAMS: dict[str, Options] = {
    "masked": Options(),
    "block": Options(block_size=32, infills=False),
    "shifted": Options(steps=512, temperature=1.0, top_k=50, confidence="neg_entropy", shift=True),
    "origin": Options(commit="random", shift=True),
    "parallel_threshold": Options(commit="threshold", infills=False),
    "parallel_factor": Options(commit="factor", infills=False),
    "prefix_cached": Options(block_size=32, cache="prefix", infills=False),
    "both_cached": Options(block_size=32, cache="both", infills=False),
    "carry": Options(commit="carry", block_size=32, shift=True, first_from_full=True, infills=False),
    "carry_cached": Options(commit="threshold", block_size=32, shift=True, first_from_full=True, cache="both", infills=False),
    "timed_cached": Options(commit="timed", block_size=32, shift=True, first_from_full=True, cache="both", infills=False),
    "hybrid": Options(commit="hybrid", threshold=0.95, block_size=32, even=True, infills=False),
    "remasking": Options(remask=True),
}


def scored(canvas: DataFrame, score: Score, options: Options, asked: Column | None = None) -> DataFrame:
    """The scorer's logits, shifted (a region's first place keeps its own), hooked and with tokens suppressed; of the places asked for, None for all."""
    logits = score(canvas.select("seq", "pos", "tok", "is_valid", (F.lit(True) if asked is None else asked).alias("asked")))
    if asked is not None:
        logits = logits.join(canvas.where(asked).select("seq", "pos"), ["seq", "pos"], "left_semi")
    if options.shift:
        logits = L.shift_right(logits)
    for hook in options.logit_hooks:
        logits = hook(logits)
    return L.suppress(logits, [*options.suppress])


def proposed(logits: DataFrame, options: Options, seed: str) -> DataFrame:
    """(seq, pos, tok, conf): a token and a confidence for each scored place."""
    if options.top_p is not None or options.top_k:
        rows = logits.withColumn("logit", F.col("logit") / options.temperature) if options.temperature > 0 else logits
        kept = L.filtered(rows, options.top_p, options.top_k, options.filters)
        drawn = L.categorical(kept, seed) if options.temperature > 0 else L.confidence(kept).withColumnRenamed("conf", "p")
        if options.confidence == "top":
            return drawn.withColumnRenamed("p", "conf")
        return drawn.select("seq", "pos", "tok").join(L.confidence(kept, options.confidence, seed=seed).select("seq", "pos", "conf"), ["seq", "pos"])
    if options.temperature > 0:
        best = L.argmax(L.gumbel(logits, options.temperature, seed))
        return L.softmax(logits).join(best, ["seq", "pos", "tok"]).select("seq", "pos", "tok", F.col("p").alias("conf"))
    return L.confidence(logits, options.confidence, seed=seed)


@dataclass(frozen=True)
class Moment:
    """Where a program is: the step of all, the step k of its block, how many steps the block has, the block's bounds behind start, its quotas' relation and first index there."""

    at: int
    k: int
    steps: int
    low: int
    high: int
    plan: DataFrame | None
    first: int = 0
    last: bool = False
    bounded: bool = False

    def inside(self) -> Column:
        return (F.col("pos") >= F.col("start") + self.low) & (F.col("pos") < F.col("start") + self.high)


def committed(rows: DataFrame, options: Options, now: Moment, seed: str) -> DataFrame:
    """Adds commit to rows (seq, pos, tok, conf, masked, quota, later)."""
    s, t = max(0.0, 1 - (now.k + 1) / now.steps), max(1 / now.steps, 1 - now.k / now.steps)
    times = lambda k: 1 + (options.eps - 1) * min(k, now.steps) / now.steps
    kinds = {
        "quota": lambda c: L.commit_quota(c, F.col("quota")),
        "threshold": lambda c: L.commit_threshold(c, options.threshold),
        "factor": lambda c: L.commit_factor(c, options.factor),
        "hybrid": lambda c: L.commit_hybrid(c, options.threshold, F.col("quota")),
        "carry": lambda c: L.commit_carry(c, options.threshold, F.col("later")),
        "soft": lambda c: L.commit_soft(c, F.col("quota"), options.soft_temperature, seed),
        "timed": lambda c: L.commit_timed(c, F.lit(times(now.k + 2)), F.lit(times(now.k + 1)), now.k >= now.steps - 2),
        "random": lambda c: L.commit_random(c, 0.0 if now.k >= now.steps - 1 else s, t, seed),
    }
    if options.commit not in kinds:
        raise ValueError(f"unknown commit {options.commit!r}")
    return kinds[options.commit](rows)


def step(canvas: DataFrame, logits: DataFrame, options: Options, mask: int, now: Moment, measure: Measure | None = None) -> DataFrame:
    """One step's rows: the canvas (seq, pos, is_valid, start, now) with tok, conf, masked, commit and after, and what measure adds."""
    seed = f"{options.seed}/{now.at}"
    here = canvas.select("seq", "pos", "is_valid", "start", F.col("tok").alias("now"))
    rows = here.join(proposed(logits, options, seed), ["seq", "pos"], "left")
    open_ = now.inside() & F.col("conf").isNotNull()
    if now.plan is not None:
        rows = rows.join(now.plan, "seq", "left")
        k = F.lit(now.first + now.k)
        size = F.size("quotas")
        rest = F.slice("quotas", F.least(k + 2, size + 1), F.greatest(size - k - 1, F.lit(0)))
        over = F.lit(now.last) if options.remask else k >= size - 1
        open_ = open_ & (k < size) if now.bounded else open_
        rows = rows.withColumns({"quota": F.when(over, ALL).otherwise(F.coalesce(F.get("quotas", k), F.lit(0))), "later": F.coalesce(F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))})
    if options.remask:
        rows = _remasked(rows, logits, options, mask, now)
        open_ = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + now.high) & F.col("conf").isNotNull()
        hidden = ((F.col("now") == mask) | F.col("remasked")) & F.col("is_valid")
    else:
        hidden = (F.col("now") == mask) & F.col("is_valid")
    out = committed(rows.withColumn("masked", hidden & open_), options, now, seed).drop("quota", "later", "quotas")
    after = F.when(F.col("commit"), F.col("tok"))
    out = out.withColumn("after", (after.when(F.col("remasked"), mask) if options.remask else after).otherwise(F.col("now")))
    return measure(out, logits) if measure else out


def _remasked(rows: DataFrame, logits: DataFrame, options: Options, mask: int, now: Moment) -> DataFrame:
    """Adds h and remasked: written places are masked again with probability h, but in a block's last step, and may be written anew at once."""
    p = L.softmax(logits).select("seq", "pos", F.col("tok").alias("now"), "p")
    shown = F.col("now") != mask
    out = rows.join(p, ["seq", "pos", "now"], "left").withColumn("h", F.when(shown, F.col("conf") - F.coalesce("p", F.lit(0.0))).otherwise(0.0)).drop("p")
    flags = L.remask(out.withColumn("masked", ~shown), F.col("start"), F.col("end"), now.k >= now.steps - 1, f"{options.seed}/remask/{now.at}")
    return flags.withColumn("remasked", F.coalesce("remask", F.lit(False))).drop("remask", "masked")


def run(canvas: DataFrame, score: Score, mask: int, options: Options = PROGRAMS["masked"], start: int = 0, history: bool = False, measure: Measure | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Fills the masks block after block. (final canvas, facts (step, seq, pos, before, tok, conf, masked, commit, after) or None).

    start is the first place of the first block, or the canvas has a column `start` with each sequence's own; a block gets its
    share of the steps. A sequence's quotas follow the schedule and its own masks, zeros left out, and it has as many
    steps as quotas; in a block's last step it writes what is left (but where caching scores both sides: there a block ends with
    its quotas). Tokens that are no masks are never changed, except by remasking. Columns that measure adds to a step's
    rows are in the facts too, and with remasking `h` and `remasked`.
    """
    if options.cache not in (None, "prefix", "both"):
        raise ValueError(f"unknown cache {options.cache!r}")
    begin = F.col("start") if "start" in canvas.columns else F.lit(start)
    canvas = _saved(canvas.select("seq", "pos", "tok", "is_valid", begin.cast("long").alias("start")), "canvas")
    far = canvas.agg(F.max(F.col("pos") - F.col("start") + 1)).first()[0]
    if far is None:
        return canvas.drop("start"), None
    log = _Log(canvas, history, mask)
    blocks = max(1, -(-far // options.block_size))
    per_block = max(1, -(-options.steps // blocks))
    if options.remask:
        _refill(log, score, mask, options, blocks, per_block, measure)
    else:
        for b in range(blocks):
            low = b * options.block_size
            _fill(log, score, mask, options, low, min(low + options.block_size, far), per_block, measure)
            if options.stop_token is not None and _all_stopped(log.canvas, options.stop_token):
                break
    return log.canvas.drop("start"), log.facts()


class _Log:
    """The steps' tables of one run and the canvas after the last of them."""

    def __init__(self, canvas: DataFrame, history: bool, mask: int):
        self.canvas, self.history, self.mask = canvas, history, mask
        self.spark, self.root = canvas.sparkSession, shared_folder(canvas.sparkSession, "program")
        self.at, self.schema, self.before = 0, None, None

    def write(self, rows: DataFrame, inside: Column, hooks: tuple[Hook, ...] = ()) -> int:
        """Writes a step; the masks that are left where inside holds."""
        for hook in hooks:
            new = hook(rows.select("seq", "pos", F.col("after").alias("tok"), "is_valid"))
            rows = rows.drop("after").join(new.select("seq", "pos", F.col("tok").alias("after")), ["seq", "pos"])
        path, seen = f"{self.root}/step={self.at}", Observation()
        left = F.count_if((F.col("after") == self.mask) & F.col("is_valid") & inside)
        rows.observe(seen, left.alias("left")).write.parquet(path)
        self.canvas = self.spark.read.schema(rows.schema).parquet(path).select("seq", "pos", F.col("after").alias("tok"), "is_valid", "start")
        if self.before and not self.history:
            dropped(self.spark, self.before)
        self.at, self.schema, self.before = self.at + 1, rows.schema, path
        return seen.get["left"]

    def facts(self) -> DataFrame | None:
        """Of every step and place what stood there, the proposal, whether it was open, whether it was written, and what stands there then."""
        if not self.history or self.schema is None:
            return None
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("step", T.IntegerType())])).parquet(self.root)
        more = [c for c in self.schema.names if c not in _OWN]
        return rows.where("conf IS NOT NULL").select("step", "seq", "pos", F.col("now").alias("before"), "tok", "conf", "masked", "commit", "after", *more)


_OWN = ("seq", "pos", "is_valid", "start", "end", "now", "tok", "conf", "masked", "commit", "after")


def _fill(log: _Log, score: Score, mask: int, options: Options, low: int, high: int, per_block: int, measure: Measure | None) -> None:
    """One block, until it holds no mask.

    With a cache the first pass over the whole canvas is stored; later ones ask for the block's places, or for those from the
    block on, and the stored logits stand for the others.
    """
    inside, hooks, full = Moment(log.at, 0, per_block, low, high, None).inside(), options.token_hooks, None
    region = F.col("pos") >= F.col("start") + low if options.cache == "prefix" else inside
    hidden = log.canvas.where((F.col("tok") == mask) & F.col("is_valid") & inside)
    if options.first_from_full and not hidden.isEmpty():
        full = scored(log.canvas, score, options)
        full = _saved(full, "logits") if options.cache else full
        one = Moment(log.at, 0, per_block, low, low + 1, hidden.select("seq", F.array(F.lit(1).cast("long")).alias("quotas")).distinct())
        log.write(step(log.canvas, full, replace(options, commit="quota"), mask, one, measure), inside, hooks)
        hidden = log.canvas.where((F.col("tok") == mask) & F.col("is_valid") & inside)
    counts = _saved(hidden.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "masks")
    found = [r["n"] for r in counts.groupBy("n").count().collect()]  # one row a number of masks: at most the block's size
    if not found:
        return
    plan, bounded = _saved(planned(counts, found, per_block, options), "plan"), options.cache == "both" and not options.first_from_full
    most = plan.agg(F.max(F.size("quotas"))).first()[0]
    left, k = 1, 0
    while left and not (bounded and k >= most):
        if options.cache is None:
            logits = scored(log.canvas, score, options)
        elif full is None:
            logits = full = _saved(scored(log.canvas, score, options), "logits")
        else:
            logits = scored(log.canvas, score, options, region)
            if log.history:
                logits = logits.unionByName(full.select(*logits.columns).join(log.canvas.where(~region).select("seq", "pos"), ["seq", "pos"], "left_semi"))
        left = log.write(step(log.canvas, logits, options, mask, Moment(log.at, k, per_block, low, high, plan, bounded=bounded), measure), inside, hooks)
        k += 1
        if k > 4 * (max(most, per_block) + 1):
            raise RuntimeError("a block does not get filled")


def _refill(log: _Log, score: Score, mask: int, options: Options, blocks: int, per_block: int, measure: Measure | None) -> None:
    """All blocks of the remasking program: each has its steps and the additional ones, and a sequence's quotas run over all blocks.

    What a step masks again is spread over all steps to come of that sequence, the smallest quotas first; the very last step
    writes everything that is left.
    """
    steps = per_block + -(-options.extra_steps // blocks)
    own = log.canvas.where(F.col("pos") >= F.col("start")).groupBy("seq", F.floor((F.col("pos") - F.col("start")) / options.block_size).alias("block")).agg(F.count_if((F.col("tok") == mask) & F.col("is_valid")).alias("n"), F.max("pos").alias("end"))
    found = [r["n"] for r in own.groupBy("n").count().collect()]
    lists = planned(own, found, per_block, options, steps)
    whole = lists.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "quotas"))), lambda x: x["quotas"])).alias("quotas"), (F.max("end") + 1).alias("end"))
    plan, older = _saved(whole, "plan"), None
    for b in range(blocks):
        for k in range(steps):
            low = b * options.block_size
            now = Moment(log.at, k, steps, low, low + options.block_size, plan, b * steps, b == blocks - 1 and k == steps - 1)
            rows = step(log.canvas, scored(log.canvas, score, options), options, mask, now, measure)
            log.write(rows, F.lit(True), options.token_hooks)
            again = log.spark.read.schema(log.schema).parquet(log.before).where("remasked").groupBy("seq").agg(F.count(F.lit(1)).alias("extra"))
            first = b * steps + k + 1
            more = plan.join(again, "seq", "left").select("seq", F.when(F.col("extra") > 0, L.spread_quota(F.col("quotas"), F.col("extra"), first)).otherwise(F.col("quotas")).alias("quotas"), "end")
            plan = _saved(more, "plan")


def planned(counts: DataFrame, found: list[int], steps: int, options: Options, pad: int = 0) -> DataFrame:
    """counts (seq, n, ...) with quotas, the numbers of places to write per step, each sequence by its own n, filled up with zeros to pad.

    found are the numbers that n takes.
    """
    if options.stochastic:
        quotas = S.transfer_quota(F.col("n"), steps, S.alpha(options.schedule), draw=S.binomial_draw(F.col("seq"), f"{options.seed}/quota"))
        out = counts.withColumn("quotas", quotas)
    else:
        lists = [(n, plan_quota(options.block_size if options.even else n, steps, options) if n else []) for n in found]
        out = counts.join(F.broadcast(counts.sparkSession.createDataFrame(lists, "n long, quotas array<long>")), "n")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(pad) - F.size("quotas"), F.lit(0)))
    return out.withColumn("quotas", F.concat("quotas", zeros)).drop("n")


def measures(mask: int, clusters: DataFrame | None = None, vectors: DataFrame | None = None) -> Measure:
    """Adds entropy (1e-8), best_prob (of the proposal) and own_prob (of a token that is no mask, else 0).

    With clusters (tok, cluster) also cluster, cluster_prob and cluster_entropy, with vectors (tok, e) dispersion.
    """

    def add(rows: DataFrame, logits: DataFrame) -> DataFrame:
        p = F.col("p")
        seen = L.softmax(logits).join(rows.select("seq", "pos", "now", F.col("tok").alias("best")), ["seq", "pos"])
        at = lambda hit: F.coalesce(F.max(F.when(hit, p)), F.lit(0.0))
        sums = seen.groupBy("seq", "pos").agg((-F.sum(p * F.log(p + 1e-8))).alias("entropy"), at(F.col("tok") == F.col("best")).alias("best_prob"), at((F.col("tok") == F.col("now")) & (F.col("now") != mask)).alias("own_prob"))
        out = rows.join(sums, ["seq", "pos"])
        if clusters is not None:
            groups = L.clusters(logits, clusters).select("seq", "pos", F.col("label").alias("cluster"), F.col("prob").alias("cluster_prob"), F.col("entropy").alias("cluster_entropy"))
            out = out.join(groups, ["seq", "pos"])
        return out if vectors is None else out.join(L.dispersion(logits, vectors), ["seq", "pos"])

    return add


def series(facts: DataFrame, mask: int, kept: bool = False) -> DataFrame:
    """What a complete history holds of measured facts: x, x0, logprob, own_prob, is_mask, entropy, h and the measures of meaning, if there are any.

    As it stands, x0 is the proposal of every place, logprob its confidence and is_mask the canvas after the step; with kept,
    revealed places propose their own token, logprob is that token's probability and is_mask is as before the step. h is
    logprob less own_prob.
    """
    hidden = F.col("before") == mask
    x0 = F.when(hidden, F.col("tok")).otherwise(F.col("before")) if kept else F.col("tok")
    logprob = F.when(hidden, F.col("best_prob")).otherwise(F.col("own_prob")) if kept else F.col("conf")
    more = [c for c in ("cluster", "cluster_prob", "cluster_entropy", "dispersion") if c in facts.columns]
    return facts.select("step", "seq", "pos", F.col("after").alias("x"), x0.alias("x0"), logprob.alias("logprob"), "own_prob", (hidden if kept else F.col("after") == mask).alias("is_mask"), "entropy", (logprob - F.col("own_prob")).alias("h"), *more)


def plan_quota(masked: int, steps: int, options: Options) -> list[int]:
    """Quotas of one block, zeros left out, at least one step: equal parts, or the schedule's. Only own schedules need Spark for that."""
    if options.even:
        each, more = divmod(masked, steps)
        got = [n for n in (each + (k < more) for k in range(steps)) if n]
    elif (name := options.schedule.lower()) in S.NUMBERS:
        got = S.planned_quota(masked, steps, S.NUMBERS[name])
    else:
        spark = SparkSession.active()
        got = spark.range(1).select(S.transfer_quota(F.lit(masked), steps, S.alpha(options.schedule)).alias("q")).first()["q"]
    return [*got] or [masked]


def _all_stopped(canvas: DataFrame, stop: int) -> bool:
    """Whether every sequence that goes on behind its start has the stop token there."""
    return bool(canvas.where("pos >= start").groupBy("seq").agg(F.count_if(F.col("tok") == stop).alias("n")).agg(F.coalesce(F.bool_and(F.col("n") > 0), F.lit(True))).first()[0])


def infill(canvas: DataFrame, score: Score, mask: int, options: Options = PROGRAMS["masked"], history: bool = False, measure: Measure | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Blocks are windows over the whole sequence, prompt included. Programs without infilling raise."""
    if not options.infills:
        raise NotImplementedError("this program does not infill")
    return run(canvas.drop("start"), score, mask, options, 0, history, measure)


def edit_flow(canvas: DataFrame, rates: Score, tau: float, kappa: S.Kappa = S.KAPPAS["linear"], temperature: float = 0.0, seed: int = 0, prompt_len: int = 1, time_independent: bool = False, time_epsilon: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """ceil(1 / tau) steps of deletions, substitutions and insertions on (seq, pos, tok), none from time 1 - time_epsilon on. (canvas, facts).

    rates gives (seq, pos, del_rate, sub_rate, ins_rate, sub_logits, ins_logits). Facts are (step, t, seq, pos, before, op, ins,
    after, after_ops, reused): after are the ids that take the place of the token before, after_ops their origins. If
    the rates do not depend on time, a step after one without edits takes that one's rates again.
    """
    from . import align as E

    now = _saved(canvas.select("seq", "pos", "tok"), "edit")
    facts = given = None
    for k in range(-int(-1 / tau // 1)):
        t = min(k * tau, 1.0)
        if k and t >= 1 - time_epsilon:
            break
        reused = given is not None
        if time_independent and not reused:
            given = _saved(rates(now), "edit-rates")
        rows = now.join(given if time_independent else rates(now), ["seq", "pos"]).withColumn("prompt_len", F.lit(prompt_len))
        moved = _saved(E.labelled(E.tau_leap(rows, tau, kappa.weight(t), temperature, seed=f"{seed}/{k}/")).select("seq", "pos", F.col("tok").alias("before"), "op", "ins", "out", "after_ops"), "edit-step")
        trace = moved.select(F.lit(k).alias("step"), F.lit(t).alias("t"), "seq", "pos", "before", "op", "ins", F.col("out").alias("after"), "after_ops", F.lit(reused).alias("reused"))
        facts = trace if facts is None else facts.unionByName(trace)
        if time_independent and moved.where("op <> 'KEEP' OR ins IS NOT NULL").isEmpty():
            continue
        given = None
        now = _saved(E.rebuilt(moved).select("seq", F.posexplode("ids").alias("pos", "tok")), "edit")
    return now, facts


def edit_flow_infill(canvas: DataFrame, rates: Score, **options: object) -> None:
    """Edit flow has no infilling."""
    raise NotImplementedError("this program does not infill")
