"""Decoding programs against plain loops with a scorer that reads the canvas; splits, heads, quotas and readers on odd rows."""

import hashlib
import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqloom.functions import schedules as S
from seqloom.operators import corrupt as C
from seqloom.operators import decode as L
from seqloom.operators import metrics as M
from seqloom.operators import pack as P
from seqloom.operators import samplers as D
from seqloom.operators import text as X
from seqloom.sources import datasets as S_
from seqloom.sources import readers

MASK, V, N, START = 9, 5, 10, 2


def uniform(key, seed):
    return (int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def weight(seq, pos, tok, left):
    """A logit that depends on the token before."""
    return 3 * math.sin(1.7 * seq + 2.3 * pos + 5.1 * tok + 0.9 * (left if left != MASK else 7))


def scorer(spark):
    toks = spark.range(V).select(F.col("id").cast("int").alias("t"))

    def score(canvas):
        left = canvas.select("seq", (F.col("pos") + 1).alias("pos"), F.when(F.col("tok") == MASK, 7).otherwise(F.col("tok")).alias("left"))
        rows = canvas.select("seq", "pos").join(left, ["seq", "pos"], "left").crossJoin(toks)
        x = 1.7 * F.col("seq") + 2.3 * F.col("pos") + 5.1 * F.col("t") + 0.9 * F.coalesce("left", F.lit(7))
        return rows.select("seq", "pos", F.col("t").alias("tok"), (3 * F.sin(x)).alias("logit"))

    return score


def plain(seq, options, start):
    """One sequence through a program, by lists."""
    row = [p if p < start else MASK for p in range(N)]

    def proposals():
        out = {}
        for p in range(N):
            logits = [weight(seq, p, t, row[p - 1] if p else 7) for t in range(V)]
            e = [math.exp(x) for x in logits]
            best = max(range(V), key=lambda t: (logits[t], -t))
            out[p] = best, e[best] / sum(e), [x / sum(e) for x in e]
        return out

    blocks = -(-(N - START) // options.block_size)  # of the longest
    per, at = max(1, -(-options.steps // blocks)), 0
    if options.remask:
        return plain_remasked(seq, options, row, start, proposals, blocks, per)
    for b in range(blocks):
        lo, hi = start + b * options.block_size, min(start + (b + 1) * options.block_size, N)
        if options.first_from_full and lo < hi:
            row[lo] = proposals()[lo][0]
            at += 1
        masks = sum(row[p] == MASK for p in range(lo, hi))
        quotas, k = D.plan_quota(options.block_size if options.even else masks, per, options), 0
        while left := [p for p in range(lo, hi) if row[p] == MASK]:
            if options.cache == "both" and not options.first_from_full and k >= len(quotas):
                break
            got = proposals()
            order = sorted(left, key=lambda p: (-got[p][1], p))
            quota, later = len(left) if k >= len(quotas) - 1 else quotas[k], sum(quotas[k + 1 :])
            if options.commit == "quota":
                take = order[:quota]
            elif options.commit == "threshold":
                take = [p for p in order if got[p][1] >= options.threshold] or order[:1]
            elif options.commit == "factor":
                n = sum(r == 1 or got[p][1] >= 1 - options.factor / (r + 1) for r, p in enumerate(order, 1))
                take = order[:n]
            elif options.commit == "hybrid":
                hits = [p for p in order if got[p][1] > options.threshold]
                take = hits if len(hits) >= quota else order[:quota]
            elif options.commit == "carry":
                take = [p for r, p in enumerate(order[: max(0, len(left) - later)]) if r == 0 or got[p][1] >= options.threshold]
            elif options.commit == "timed":
                t, s = (1 + (options.eps - 1) * min(k + j, per) / per for j in (1, 2))
                take = order if k >= per - 2 else order[: int(len(left) * (1 - s / t))]
            for p in take:
                row[p] = got[p][0]
            k, at = k + 1, at + 1
    return row


def plain_remasked(seq, options, row, start, proposals, blocks, per):
    """Written places are masked again before the step's writing; what was masked again is spread over all steps to come."""
    steps = per + -(-options.extra_steps // blocks)
    quotas = []
    for b in range(blocks):
        n = sum(row[p] == MASK for p in range(start + b * options.block_size, min(start + (b + 1) * options.block_size, N)))
        own = D.plan_quota(n, per, options) if n else []
        quotas += own + [0] * (steps - len(own))
    for at in range(blocks * steps):
        b, k = divmod(at, steps)
        got, again = proposals(), []
        if k < steps - 1:
            for p in range(start, N):
                h = got[p][1] - got[p][2][row[p]] if row[p] != MASK else 0
                if h > 0 and uniform(f"{seq}/{p}", f"{options.seed}/remask/{at}") < min(h, 1):
                    again.append(p)
        for p in again:
            row[p] = MASK
        tail = list(range(at + 1, len(quotas)))
        if again and tail:
            each, rest = divmod(len(again), len(tail))
            least = sorted(tail, key=lambda i: (quotas[i], i))[:rest]
            for i in tail:
                quotas[i] += each + (i in least)
        left = [p for p in range(start, min(start + (b + 1) * options.block_size, N)) if row[p] == MASK]
        order = sorted(left, key=lambda p: (-got[p][1], p))
        for p in order if at == blocks * steps - 1 else order[: quotas[at]]:
            row[p] = got[p][0]
    return row


def filled(spark, options, starts, history=False):
    canvas = spark.createDataFrame([(s, p, p if p < at else MASK, True, at) for s, at in starts.items() for p in range(N)], "seq long, pos int, tok int, is_valid boolean, start int")
    final, facts = D.run(canvas, scorer(spark), MASK, options, history=history)
    got = {}
    for r in final.collect():
        got.setdefault(r["seq"], {})[r["pos"]] = r["tok"]
    return {s: [x[p] for p in range(N)] for s, x in got.items()}, facts


#: First places of the sequences: masks of 8, 3, 7, 1 and none.
STARTS = {0: START, 1: 7, 2: 3, 3: 9, 4: N}


@pytest.mark.parametrize("key,changes", [
    ("masked", {}), ("block", {"block_size": 4}), ("block", {"block_size": 3, "steps": 7, "schedule": "cosine"}), ("parallel_threshold", {"threshold": 0.55}), ("parallel_factor", {"factor": 1.4}), ("hybrid", {"threshold": 0.55}),
    ("carry", {"threshold": 0.55, "shift": False}), ("carry", {"threshold": 0.55, "shift": False, "first_from_full": False}), ("remasking", {"extra_steps": 2}), ("remasking", {"extra_steps": 3, "block_size": 3, "steps": 5}),
    ("prefix_cached", {"block_size": 3}), ("both_cached", {"block_size": 4, "commit": "threshold", "threshold": 0.6, "steps": 4}), ("carry_cached", {"block_size": 4, "shift": False, "threshold": 0.6}), ("timed_cached", {"block_size": 4, "shift": False, "steps": 8}),
])
def test_programs_follow_their_rules(spark, key, changes):
    """Each sequence as if it were alone, whatever the masks of the others."""
    options = replace(D.PROGRAMS[key], **{"steps": 4, "block_size": 8, **changes})
    assert filled(spark, options, STARTS)[0] == {s: plain(s, options, at) for s, at in STARTS.items()}


def test_a_sequence_does_not_depend_on_its_neighbours(spark):
    for key in ("masked", "hybrid"):
        options = replace(D.PROGRAMS[key], steps=4, block_size=8)
        assert filled(spark, options, {2: 6})[0][2] == filled(spark, options, {0: START, 2: 6, 5: 9})[0][2]


def test_quotas_are_each_sequences_own(spark):
    """Twelve and four masks in four steps: 3, 3, 3, 3 and 1, 1, 1, 1."""
    canvas = spark.createDataFrame([(s, p, MASK if p >= at else p % V, True, at) for s, at in ((0, 0), (1, 8)) for p in range(12)], "seq long, pos int, tok int, is_valid boolean, start int")
    facts = D.run(canvas, scorer(spark), MASK, replace(D.PROGRAMS["masked"], steps=4), history=True)[1]
    got = facts.where("commit").groupBy("seq", "step").count().collect()
    assert {(r["seq"], r["step"]): r["count"] for r in got} == {(s, k): n for s, n in ((0, 3), (1, 1)) for k in range(4)}


def test_quotas_can_be_drawn(spark):
    options = replace(D.PROGRAMS["masked"], steps=4, block_size=8, stochastic=True)
    rows, facts = filled(spark, options, {s: START for s in range(12)}, history=True)
    assert all(MASK not in r for r in rows.values())
    counts = {}
    for r in facts.where("commit").groupBy("seq", "step").count().collect():
        counts.setdefault(r["seq"], {})[r["step"]] = r["count"]
    want = spark.range(12).select("id", S.transfer_quota(F.lit(8), 4, S.alpha("linear"), draw=S.binomial_draw(F.col("id"), "0/quota")).alias("q")).collect()
    assert {s: [c[k] for k in sorted(c)] for s, c in counts.items()} == {r["id"]: [*r["q"]] for r in want} and len({tuple(r["q"]) for r in want}) > 4


def test_a_cache_asks_for_fewer_places(spark):
    """The scorer counts what it is asked for: all places once a block, then the block's (prefix: and those behind it) only."""
    asked = {}

    def run(cache):
        places = asked.setdefault(cache, [])

        def score(canvas):
            places.append(canvas.where("asked").count())
            return scorer(spark)(canvas)

        canvas = spark.createDataFrame([(0, p, p if p < START else MASK, True) for p in range(N)], "seq long, pos int, tok int, is_valid boolean")
        options = replace(D.PROGRAMS["block"], steps=8, block_size=4, cache=cache)
        final, facts = D.run(canvas, score, MASK, options, START, history=True)
        return sorted(final.collect()), sorted(facts.select("step", "seq", "pos", "tok", "masked", "commit").where("masked").collect())

    assert run(None) == run("prefix") == run("both")
    assert asked == {None: [N] * 8, "prefix": [N, 8, 8, 8, N, 4, 4, 4], "both": [N, 4, 4, 4, N, 4, 4, 4]}
    with pytest.raises(ValueError, match="unknown cache"):
        run("other")


def test_steps_without_a_history_leave_one_table(spark, tmp_path):
    import os
    from glob import glob

    before = {*glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/program-*")} if spark.sparkContext.getCheckpointDir() else set()
    filled(spark, replace(D.PROGRAMS["masked"], steps=4, block_size=8), {0: START})
    new = {*glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/program-*")} - before
    assert [os.listdir(p) for p in new] == [["step=3"]]


def test_hooks_and_stop(spark):
    canvas = spark.createDataFrame([(0, p, p if p < START else MASK, True) for p in range(N)], "seq long, pos int, tok int, is_valid boolean")
    no_zero = lambda df: df.withColumn("logit", F.when(F.col("tok") == 0, -50.0).otherwise(F.col("logit")))
    fixed = lambda df: df.withColumn("tok", F.when(F.col("pos") == 5, 4).otherwise(F.col("tok")))
    options = replace(D.PROGRAMS["masked"], steps=4, block_size=8, logit_hooks=(no_zero,), token_hooks=(fixed,))
    row = {r["pos"]: r["tok"] for r in D.run(canvas, scorer(spark), MASK, options, START)[0].collect()}
    assert row[5] == 4 and all(row[p] not in (0, MASK) for p in range(START, N))
    stop = replace(D.PROGRAMS["block"], steps=4, block_size=4, stop_token=4, token_hooks=(fixed,))
    row = {r["pos"]: r["tok"] for r in D.run(canvas, scorer(spark), MASK, stop, START)[0].collect()}
    assert row[5] == 4 and all(row[p] == MASK for p in range(6, N))
    for key in ("block", "hybrid", "carry", "prefix_cached"):
        with pytest.raises(NotImplementedError):
            D.infill(canvas, scorer(spark), MASK, D.PROGRAMS[key])
    with pytest.raises(NotImplementedError):
        D.edit_flow_infill(canvas, scorer(spark))
    with pytest.raises(ValueError, match="unknown evaluation"):
        M.program("nothing")
    assert M.program("shifted")[1].steps == 512 and M.program("block", steps=7)[0].steps == 7


def edit_rates(canvas):
    x = F.col("seq") + 2.0 * F.col("pos") + 3.0 * F.col("tok")
    lean = lambda a: F.array(*[F.sin(x + a * v) for v in range(4)])
    return canvas.select("seq", "pos", *[(0.6 + 0.5 * F.sin(x + a)).alias(f"{n}_rate") for a, n in enumerate(("del", "sub", "ins"))], lean(1.3).alias("sub_logits"), lean(2.1).alias("ins_logits"))


def plain_edits(seq, row, tau, temperature, seed, prompt):
    """One sequence through the edit flow, by lists: (final, [(step, pos, op, after, after_ops)])."""
    def pick(x, a, u):
        w = [math.sin(x + a * v) for v in range(4)]
        if temperature <= 0:
            return max(range(4), key=lambda v: (w[v], -v))
        e = [math.exp((y - max(w)) / temperature) for y in w]
        return min(sum(sum(e[: v + 1]) < u * sum(e) for v in range(4)), 3)

    facts = []
    for k in range(math.ceil(1 / tau)):
        t, new = min(k * tau, 1.0), []
        for p, tok in enumerate(row):
            x, u = seq + 2 * p + 3 * tok, lambda what, p=p: uniform(f"{seq}/{p}", f"{seed}/{k}/{what}")  # noqa: B023
            d, s, i = ((0.6 + 0.5 * math.sin(x + a)) / (1 - t + 1e-6) for a in range(3))
            d, s, i = d if p >= prompt else 0, s if p >= prompt else 0, i if p >= prompt - 1 else 0
            fires = u("fire") < min(max((d + s) * tau, 0), 1 - 1e-6)
            op = "KEEP" if not fires else "DEL" if u("which") < d / (d + s + 1e-8) else "SUB"
            after = [] if op == "DEL" else [(tok if op == "KEEP" else pick(x, 1.3, u("sub_token")), op)]
            if u("ins") < min(max(i * tau, 0), 1 - 1e-6):
                after.append((pick(x, 2.1, u("ins_token")), "INS"))
            facts.append((k, p, op, [a for a, _ in after], [o for _, o in after]))
            new += [a for a, _ in after]
        row = new
    return row, sorted(facts)


@pytest.mark.parametrize("temperature", [0.0, 0.7])
def test_edit_flow_follows_its_rules(spark, temperature):
    start = {0: [5, 6, 7, 8], 1: [2], 2: [1, 1, 1, 1, 1, 1], 3: [9, 4, 3]}
    canvas = spark.createDataFrame([(s, p, t) for s, row in start.items() for p, t in enumerate(row)], "seq long, pos int, tok int")
    final, facts = D.edit_flow(canvas, edit_rates, 0.3, temperature=temperature, seed=5, prompt_len=2)
    got, trace = {}, {}
    for r in final.collect():
        got.setdefault(r["seq"], {})[r["pos"]] = r["tok"]
    for r in facts.collect():
        trace.setdefault(r["seq"], []).append((r["step"], r["pos"], r["op"], r["after"], r["after_ops"]))
        assert not r["reused"] and r["t"] == min(r["step"] * 0.3, 1.0)
    for s, row in start.items():
        want = plain_edits(s, row, 0.3, temperature, 5, 2)
        assert ([got[s][p] for p in range(len(got[s]))], sorted(trace[s])) == want


def test_rates_are_taken_again_after_a_step_without_edits(spark):
    canvas = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "seq long, pos int, tok int")
    asked = []

    def none(c):
        asked.append(1)
        return edit_rates(c).withColumns({f"{n}_rate": F.lit(0.0) for n in ("del", "sub", "ins")})

    final, facts = D.edit_flow(canvas, none, 0.25, time_independent=True, time_epsilon=0.3)
    assert len(asked) == 1 and final.count() == 2
    assert {(r["step"], r["reused"]) for r in facts.collect()} == {(0, False), (1, True), (2, True)}
    moving = D.edit_flow(canvas, edit_rates, 0.25, seed=3, time_independent=True)
    same = D.edit_flow(canvas, edit_rates, 0.25, seed=3)
    assert sorted(moving[0].collect()) == sorted(same[0].collect())


def test_eval_step_of_the_loss_alone(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1, 1.0, True, True)], "batch long, seq long, pos int, tok int, weight double, masked boolean, counts boolean")
    logits = spark.createDataFrame([(0, 0, t, 0.0) for t in range(4)], "seq long, pos int, tok int, logit double")
    loss, seen, labels = C.eval_step(rows, logits, "token", ["batch"], loss_only=True)
    assert seen is None and labels is None and abs(loss.first()["loss"] - math.log(4)) < 1e-12


def test_quotas_on_the_driver_are_spark_quotas(spark):
    for n, steps in ((10, 4), (4, 3), (16, 5), (3, 8), (0, 4), (97, 13)):
        for name in ("linear", "cosine"):
            want = spark.range(1).select(S.transfer_quota(F.lit(n), steps, S.alpha(name))).first()[0]
            assert S.planned_quota(n, steps, S.NUMBERS[name]) == [*want]
    assert D.plan_quota(10, 4, replace(D.PROGRAMS["hybrid"])) == [3, 3, 2, 2]
    quota, extra = [3, 1, 5, 2], 7
    got = spark.range(1).select(L.spread_quota(F.array(*[F.lit(x).cast("long") for x in quota]), F.lit(extra).cast("long"), 1)).first()[0]
    assert [*got] == [3, 4, 7, 4]
    drawn = spark.range(300).select(S.transfer_quota(F.lit(8), 4, S.alpha("linear"), True, S.binomial_draw(F.col("id"), 5)).alias("q")).collect()
    assert all(sum(r["q"]) == 8 and len(r["q"]) == 4 for r in drawn) and len({tuple(r["q"]) for r in drawn}) > 20
    assert abs(sum(r["q"][0] for r in drawn) / 300 - 2) < 0.3


def test_hash_split_of_repeated_null_and_equal_keys(spark):
    rows = [(k % 5, k) for k in range(200)] + [(None, k) for k in range(40)] + [(3, 7)] * 60
    df = spark.createDataFrame(rows, "key long, v long")
    for share in (0.0, 0.05, 0.3, 0.61, 1.0):
        out = S_.hash_split(df, "key", share).collect()
        assert Counter((r["key"], r["v"]) for r in out) == Counter(rows)
        assert sum(r["split"] == "test" for r in out) == math.ceil(share * len(rows))
    assert S_.hash_split(df.limit(0), "key").count() == 0
    assert S_.hash_split(spark.createDataFrame([("a",), (None,)], "key string"), "key", 0.5).where("split = 'test'").count() == 1


def test_large_heads_are_exact(spark, monkeypatch):
    monkeypatch.setattr(S_, "MANY", 10)
    rng = random.Random(3)
    values = [rng.choice([None, rng.randrange(50), rng.randrange(10**12)]) for _ in range(500)] + [5] * 100
    df = spark.createDataFrame([(v,) for v in values], "ord long")
    order = sorted(values, key=lambda v: -1 if v is None else v)
    for n in (11, 150, 333, 599, 600, 900):
        assert sorted([r["ord"] for r in S_.head(df, n).collect()], key=lambda v: -1 if v is None else v) == order[:n]
    assert S_.head(df.limit(0), 20).count() == 0


def test_readers_need_what_they_need(spark, tmp_path):
    spark.createDataFrame([("x",)], "text string").write.parquet(f"{tmp_path}/opc-annealing-corpus/other")
    with pytest.raises(NotImplementedError):
        readers.opc_annealing(spark, f"{tmp_path}/opc-annealing-corpus", {"lang": "python"})
    assert readers.config_names(spark, f"{tmp_path}/opc-annealing-corpus") == ["other"]
    assert readers.opc_annealing(spark, f"{tmp_path}/opc-annealing-corpus", {}).count() == 1


def test_tokenizer_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["Hello, world", "", None, "naïve 日本語\n\n  x", "a" * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["ids"] for r in df.select("k", X.bpe_ids(path)(F.col("t")).alias("ids")).collect()}
    assert got == {k: own.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    chats = spark.createDataFrame([([("user", "hi there"), ("assistant", "yes, you")],)], f"messages {X.MESSAGES}")
    row = X.sft_map(chats, encode=X.bpe_ids(path)).first()
    assert own.decode(row["input_ids"][row["prompt_len"] :]).strip() == "yes, you<|eot_id|>" and row["labels"][: row["prompt_len"]] == [-100] * row["prompt_len"]
    assert X.sft_map(chats, mask_prompt=False).first()["labels"] == X.sft_map(chats).first()["input_ids"]


def test_greedy_by_repeated_commits(spark):
    """One place a step, the most confident; a scorer that reads the canvas, continuations of unequal lengths."""
    def plain_greedy(seq, start):
        row = [p if p < start else MASK for p in range(N)]
        while MASK in row:
            best = {}
            for p in range(N):
                logits = [weight(seq, p, t, row[p - 1] if p else 7) for t in range(V)]
                e = [math.exp(x) for x in logits]
                tok = max(range(V), key=lambda t: (logits[t], -t))  # noqa: B023
                best[p] = e[tok] / sum(e), tok
            p = min((p for p in range(N) if row[p] == MASK), key=lambda p: (-best[p][0], p))
            row[p] = best[p][1]
        return row

    want = {s: plain_greedy(s, at) for s, at in STARTS.items()}
    canvas = spark.createDataFrame([(s, p, p if p < at else MASK, True) for s, at in STARTS.items() for p in range(N)], "seq long, pos int, tok int, is_valid boolean")
    targets = [(s, p, (want[s][p] + (s == 2 and p == 8)) % V) for s, at in STARTS.items() for p in range(at, N)]
    got = M.greedy_decoded(canvas, scorer(spark), MASK, spark.createDataFrame(targets, "seq long, pos int, tok int")).collect()
    assert {(r["seq"], r["greedy"], r["equal"]) for r in got} == {(s, s != 2, N - at - (s == 2)) for s, at in STARTS.items() if at < N}


def test_pairs_are_split_by_the_contexts_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    encode = lambda t: own.encode(t, add_special_tokens=False).ids
    pairs = [("Hello wor", "ld, this is"), ("a  \n", "b"), ("", "only"), ("only", ""), ("unbeliev", "able things"), ("naïv", "eté 日本")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string")
    context, continuation = P.encode_pair(F.col("a"), F.col("b"), X.bpe_ids(path))
    got = {r["k"]: (r["c"], r["d"]) for r in df.select("k", context.alias("c"), continuation.alias("d")).collect()}
    for k, (a, b) in enumerate(pairs):
        left = a.rstrip()
        whole, n = encode(left + a[len(left) :] + b), len(encode(left))
        assert got[k] == (encode(left), whole[n:])
