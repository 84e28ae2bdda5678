"""One decoding step over logits held as a relation (seq, pos, tok, logit).

Grouped aggregates and windows by (seq, pos) only, so work is spread over positions; ties go to the smaller token
or position. The epsilons differ by operator on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import uniform
from ..functions.schedules import step_quota

KEY = ("seq", "pos")
NEG = float("-inf")


def _w(*order: Column) -> Window:
    w = Window.partitionBy(*KEY)
    return w.orderBy(*order) if order else w


def best_first() -> list[Column]:
    return [F.desc("logit"), F.asc("tok")]


def softmax(logits: DataFrame) -> DataFrame:
    """Adds p. Logits of minus infinity have probability 0."""
    e = F.exp(F.col("logit") - F.max("logit").over(_w()))
    return logits.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(_w())).drop("_e")


def argmax(logits: DataFrame) -> DataFrame:
    """(seq, pos, tok): the best token; a partial aggregate, no window."""
    return logits.groupBy(*KEY).agg(F.max_by("tok", F.struct(F.col("logit"), -F.col("tok"))).alias("tok"))


def gumbel(logits: DataFrame, temperature: float, seed: int | str) -> DataFrame:
    """logit becomes exp(logit) / (-ln u)^temperature; nothing changes at 0."""
    if temperature == 0:
        return logits
    u = uniform(F.concat_ws("/", "seq", "pos", "tok"), seed)
    return logits.withColumn("logit", F.exp("logit") / F.pow(-F.log(u), F.lit(temperature)))


def confidence(logits: DataFrame, kind: str = "top", eps: float | None = None, seed: int | str = 0) -> DataFrame:
    """(seq, pos, tok, conf) of the best token. kind: top (its probability), random, margin (to the second), entropy (sum p ln(p + eps), 1e-8) or neg_entropy (1e-10)."""
    p = softmax(logits)
    best = F.max_by("tok", F.struct(F.col("logit"), -F.col("tok"))).alias("tok")
    if kind == "top":
        return p.groupBy(*KEY).agg(best, F.max("p").alias("conf"))
    if kind == "random":
        return argmax(logits).withColumn("conf", uniform(F.concat_ws("/", *KEY), seed))
    if kind == "margin":
        ranked = p.withColumn("r", F.row_number().over(_w(*best_first())))
        two = ranked.where("r <= 2").groupBy(*KEY)
        return two.agg(F.max(F.when(F.col("r") == 1, F.col("tok"))).alias("tok"), (F.max(F.when(F.col("r") == 1, F.col("p"))) - F.max(F.when(F.col("r") == 2, F.col("p")))).alias("conf"))
    if kind in ("entropy", "neg_entropy"):
        e = eps if eps is not None else 1e-8 if kind == "entropy" else 1e-10
        return p.groupBy(*KEY).agg(best, F.sum(F.col("p") * F.log(F.col("p") + e)).alias("conf"))
    raise ValueError(f"unknown confidence {kind!r}")


def top_p(logits: DataFrame, p: float | None) -> DataFrame:
    """Minus infinity beyond the tokens whose probability reaches p, best first; the one that crosses p stays. None or 1 and more change nothing."""
    if p is None or p >= 1:
        return logits
    before = F.coalesce(F.sum("p").over(_w(*best_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return softmax(logits).withColumn("logit", F.when(before <= p, F.col("logit")).otherwise(NEG)).drop("p")


def top_k(logits: DataFrame, k: int | None) -> DataFrame:
    """Minus infinity below the k-th largest logit, whose ties stay. None or 0 change nothing."""
    if not k:
        return logits
    return logits.withColumn("logit", F.when(F.rank().over(_w(F.desc("logit"))) <= k, F.col("logit")).otherwise(NEG))


def categorical(logits: DataFrame, seed: int | str) -> DataFrame:
    """(seq, pos, tok, p): the first token, in token order, at which the running probability reaches u."""
    run = F.sum("p").over(_w(F.asc("tok")).rowsBetween(Window.unboundedPreceding, 0))
    rows = softmax(logits).withColumn("run", run).withColumn("u", uniform(F.concat_ws("/", *KEY), seed))
    last = F.max(F.when(F.col("p") > 0, F.col("tok"))).over(_w())
    hit = rows.withColumn("last", last).where((F.col("p") > 0) & ((F.col("run") >= F.col("u")) | (F.col("tok") == F.col("last"))))
    return hit.groupBy(*KEY).agg(F.min("tok").alias("tok"), F.min_by("p", "tok").alias("p"))


def filtered(rows: DataFrame, p: float | None, k: int | None, order: str = "p_then_k") -> DataFrame:
    """The two filters in the given order."""
    if order not in ("p_then_k", "k_then_p"):
        raise ValueError(f"unknown order {order!r}")
    return top_k(top_p(rows, p), k) if order == "p_then_k" else top_p(top_k(rows, k), p if p and 0 < p < 1 else None)


def sample(logits: DataFrame, temperature: float = 0.0, p: float | None = None, k: int | None = None, order: str = "p_then_k", seed: int | str = 0) -> DataFrame:
    """(seq, pos, tok, p): temperature, then the filters in the given order, then a draw, or the best at temperature 0."""
    rows = logits.withColumn("logit", F.col("logit") / temperature) if temperature > 0 else logits
    rows = filtered(rows, p, k, order)
    if temperature > 0:
        return categorical(rows, seed)
    return confidence(rows, "top").withColumnRenamed("conf", "p")


def suppress(logits: DataFrame, tokens: list[int]) -> DataFrame:
    return logits.withColumn("logit", F.when(F.col("tok").isin(*tokens), NEG).otherwise(F.col("logit"))) if tokens else logits


def suppressed_confidence(logits: DataFrame, begin_tokens: list[int]) -> DataFrame:
    """(seq, pos, tok, conf): the proposal ignores the suppression, only its probability knows of it."""
    best = argmax(logits)
    return softmax(suppress(logits, begin_tokens)).join(best, [*KEY, "tok"]).select(*KEY, "tok", F.col("p").alias("conf"))


def guided(conditional: DataFrame, unconditional: DataFrame, scale: float) -> DataFrame:
    """un + (scale + 1) (cond - un)."""
    un = unconditional.withColumnRenamed("logit", "un")
    return conditional.join(un, [*KEY, "tok"]).select(*KEY, "tok", (F.col("un") + (scale + 1) * (F.col("logit") - F.col("un"))).alias("logit"))


def shift_right(logits: DataFrame) -> DataFrame:
    """Each position gets its predecessor's logits, the first keeps its own."""
    before = F.lag("logit").over(Window.partitionBy("seq", "tok").orderBy("pos"))
    return logits.withColumn("logit", F.coalesce(before, F.col("logit")))


def given(canvas: DataFrame, mask: int, kept: list[int] | None = None) -> DataFrame:
    """Adds given: a valid token that is no mask and not in kept."""
    flag = (F.col("tok") != mask) & F.col("is_valid")
    return canvas.withColumn("given", flag & ~F.col("tok").isin(*kept) if kept else flag)


def in_block(conf: DataFrame, end: int) -> DataFrame:
    """Positions past the block's end get minus infinity."""
    return conf.withColumn("conf", F.when(F.col("pos") >= end, NEG).otherwise(F.col("conf")))


def _ranked(conf: DataFrame) -> DataFrame:
    """Of rows (seq, pos, conf, masked): r by falling confidence, unmasked places last; n masked places."""
    w = Window.partitionBy("seq")
    order = w.orderBy(F.desc("masked"), F.desc("conf"), F.asc("pos"))
    return conf.withColumns({"r": F.row_number().over(order), "n": F.count_if("masked").over(w)})


def commit_quota(conf: DataFrame, k: int | Column) -> DataFrame:
    """Adds commit: the k most confident masked places."""
    kept = k if isinstance(k, Column) else F.lit(k)
    return _ranked(conf).withColumn("commit", F.col("masked") & (F.col("r") <= kept)).drop("r", "n")


def commit_threshold(conf: DataFrame, threshold: float) -> DataFrame:
    """Masked places with conf >= threshold, and the best one if there is none."""
    rows = _ranked(conf).withColumn("hit", F.col("masked") & (F.col("conf") >= threshold))
    none = F.count_if("hit").over(Window.partitionBy("seq")) == 0
    return rows.withColumn("commit", F.col("hit") | (none & F.col("masked") & (F.col("r") == 1))).drop("r", "n", "hit")


def commit_factor(conf: DataFrame, factor: float) -> DataFrame:
    """Rank r is accepted if conf >= 1 - factor / (r + 1), rank 1 always; as many of the best are taken as ranks were accepted."""
    rows = _ranked(conf).withColumn("ok", F.col("masked") & ((F.col("r") == 1) | (F.col("conf") >= 1 - factor / (F.col("r") + 1))))
    k = F.count_if("ok").over(Window.partitionBy("seq"))
    return rows.withColumn("commit", F.col("masked") & (F.col("r") <= F.least(k, F.col("n")))).drop("r", "n", "ok")


def commit_hybrid(conf: DataFrame, threshold: float, quota: int | Column) -> DataFrame:
    """All masked places with conf > threshold if they reach the quota, else the best `quota`."""
    rows = _ranked(conf).withColumn("hit", F.col("masked") & (F.col("conf") > threshold))
    enough = F.count_if("hit").over(Window.partitionBy("seq")) >= quota
    return rows.withColumn("commit", F.when(enough, F.col("hit")).otherwise(F.col("masked") & (F.col("r") <= quota))).drop("r", "n", "hit")


def commit_carry(conf: DataFrame, threshold: float, future: int | Column) -> DataFrame:
    """k = masked places less later quotas; of the best k, those below the threshold wait, but never the first."""
    k = F.greatest(F.col("n") - future, F.lit(0))
    rows = _ranked(conf)
    return rows.withColumn("commit", F.col("masked") & (F.col("r") <= k) & ((F.col("r") == 1) | (F.col("conf") >= threshold))).drop("r", "n")


def commit_soft(conf: DataFrame, k: int | Column, temperature: float, seed: int | str) -> DataFrame:
    """k masked places drawn without replacement by softmax(conf / temperature), as Gumbel top-k."""
    noise = -F.log(-F.log(uniform(F.concat_ws("/", *KEY), seed)))
    rows = conf.withColumn("_own", F.col("conf")).withColumn("conf", F.col("conf") / temperature + noise)
    return commit_quota(rows, k).withColumn("conf", F.col("_own")).drop("_own")


def commit_timed(conf: DataFrame, s: Column, t: Column, last: bool) -> DataFrame:
    """The int(n (1 - s / t)) most confident of n masked places; all of them at the last step."""
    rows = _ranked(conf)
    return rows.withColumn("commit", F.col("masked") & (F.col("r") <= step_quota(F.col("n"), s, t, F.lit(last)))).drop("r", "n")


def commit_random(conf: DataFrame, s: float, t: float, seed: int | str) -> DataFrame:
    """Each masked place with probability 1 - s / t."""
    return conf.withColumn("commit", F.col("masked") & (uniform(F.concat_ws("/", *KEY), seed) < 1 - s / t))


def write(canvas: DataFrame, proposals: DataFrame) -> DataFrame:
    """(seq, pos, tok): proposals (seq, pos, tok, commit) written into the canvas."""
    new = proposals.where("commit").select(*KEY, F.col("tok").alias("new"))
    return canvas.join(new, [*KEY], "left").withColumn("tok", F.coalesce("new", "tok")).drop("new")


def position_ids(canvas: DataFrame, pad: int) -> DataFrame:
    """Adds position_id: valid tokens counted from 0, pads get `pad`."""
    run = F.sum(F.col("is_valid").cast("int")).over(Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return canvas.withColumn("position_id", F.when(F.col("is_valid"), run - 1).otherwise(pad))


def block_causal(q: Column, k: Column, q_valid: Column, k_valid: Column, block: int) -> Column:
    return (F.floor(k / block) <= F.floor(q / block)) & q_valid & k_valid


def block_triangular(q: Column, k: Column, block: int) -> Column:
    return F.floor(k / block) <= F.floor(q / block)


def clusters(logits: DataFrame, mapping: DataFrame) -> DataFrame:
    """(seq, pos, label, prob, entropy): probabilities summed by token cluster plus 1e-14; the best cluster and -sum p ln(p + 1e-10).

    The mapping (tok, cluster) is as large as the vocabulary; Spark broadcasts it if it is small enough.
    """
    summed = softmax(logits).join(mapping, "tok").groupBy(*KEY, "cluster").agg(F.sum("p").alias("p"))
    p = summed.withColumn("p", F.col("p") + 1e-14)
    return p.groupBy(*KEY).agg(F.max_by("cluster", F.struct("p", -F.col("cluster"))).alias("label"), F.max("p").alias("prob"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("entropy"))


def dispersion(logits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(seq, pos, dispersion): max(0, 1 - |sum p e / |e||^2) for vectors (tok, e)."""
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.select("tok", F.posexplode(F.transform("e", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))).alias("dim", "x"))
    mean = softmax(logits).join(unit, "tok").groupBy(*KEY, "dim").agg(F.sum(F.col("p") * F.col("x")).alias("m"))
    return mean.groupBy(*KEY).agg(F.greatest(F.lit(0.0), 1 - F.sum(F.col("m") * F.col("m"))).alias("dispersion"))


def h_statistic(logits: DataFrame, canvas: DataFrame, mask: int) -> DataFrame:
    """(seq, pos, h): the best probability less that of the revealed token; 0 where masked."""
    p = softmax(logits)
    own = canvas.join(p, [*KEY, "tok"], "left").select(*KEY, "tok", "p")
    return own.join(p.groupBy(*KEY).agg(F.max("p").alias("conf")), [*KEY]).select(*KEY, F.when(F.col("tok") == mask, 0.0).otherwise(F.col("conf") - F.coalesce("p", F.lit(0.0))).alias("h"))


def remask(rows: DataFrame, start: int | Column, end: int | Column, last_step: bool, seed: int | str) -> DataFrame:
    """Adds remask to (seq, pos, masked, h): revealed, h > 0, start <= pos < end, with probability h; never at the last step."""
    hit = ~F.col("masked") & (F.col("h") > 0) & (F.col("pos") >= start) & (F.col("pos") < end) & (uniform(F.concat_ws("/", *KEY), seed) < F.least("h", F.lit(1.0)))
    return rows.withColumn("remask", hit & F.lit(not last_step))


def spread_quota(quota: Column, extra: Column, first: int) -> Column:
    """Quotas from step `first` on share `extra` evenly; the remainder goes to the smallest of them, earlier ones first."""
    head, tail = F.slice(quota, 1, first), F.slice(quota, F.lit(first + 1), F.greatest(F.size(quota) - first, F.lit(0)))
    n = F.size(tail)
    base, rest = F.floor(extra / F.greatest(n, F.lit(1))), extra % F.greatest(n, F.lit(1))
    order = F.array_sort(F.transform(tail, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    places = F.transform(order, lambda z: z["i"])
    more = F.transform(tail, lambda x, i: x + base + F.when(F.array_position(places, i) <= rest, 1).otherwise(0))
    return F.when(n > 0, F.concat(head, more)).otherwise(quota)


def masks_left(history: DataFrame, mask: int) -> DataFrame:
    return history.groupBy("step").agg(F.count_if(F.col("tok") == mask).alias("masks"))


def canvas_row(ids: Column, new: int, mask: int, eos: int, width: Column, layout: str = "right", block: int = 1) -> Column:
    """The canvas's ids. right: ids, masks, EOS pads; left: EOS pads, ids, masks; block: left pads to whole blocks before ids, then masks."""
    body = F.concat(ids, F.array_repeat(F.lit(mask), new))
    if layout == "block":
        target = (F.ceil(F.greatest(width, F.size(ids)) / block) * block).cast("int")
        return F.concat(F.array_repeat(F.lit(eos), target - F.size(ids)), body)
    pads = F.array_repeat(F.lit(eos), F.greatest(width - F.size(body), F.lit(0)))
    return F.concat(body, pads) if layout == "right" else F.concat(pads, body)
