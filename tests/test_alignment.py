"""Alignments in blocks, linear edits and weights, and the edit-flow step against plain loops."""

import math
import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from seqloom.functions.rng import draw
from seqloom.functions.schedules import kappa
from seqloom.operators import align as E
from seqloom.operators import corrupt as C


def plain_align(a, b, sub=1, gap=1):
    """The whole table, and back from its end: a pair before a deletion before an insertion."""
    cost = [[gap * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * sub, cost[i - 1][j] + gap, cost[i][j - 1] + gap)
    z0, z1, i, j = [], [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * sub:
            i, j = i - 1, j - 1
            z0.append(a[i]), z1.append(b[j])
        elif i and cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
            z0.append(a[i]), z1.append(-1)
        else:
            j -= 1
            z0.append(-1), z1.append(b[j])
    return z0[::-1], z1[::-1], cost[-1][-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 26])
def test_alignment_in_blocks_is_that_of_the_whole_table(cells):
    rng = random.Random(cells)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        sub, gap = rng.choice([(1, 1), (2, 1), (3, 2)])
        assert E.aligned(a, b, sub, gap, cells) == plain_align(a, b, sub, gap)


def test_long_alignments_need_little_memory():
    """15,000 by 15,000 places: the whole way would be 225 MB; with 20 MB a block it is far less."""
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(15_000)]
    b = [x for x in a if rng.random() > 0.05]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    z0, z1, cost = E.aligned(a, b, cells=20_000_000)
    assert [x for x in z0 if x != -1] == a and [x for x in z1 if x != -1] == b and cost == len(a) - len(b)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000


def plain_edits(zt, z1):
    out, n = [], 0
    for a, b in zip(zt, z1, strict=True):
        if a != b:
            out.append(("INS", max(n - 1, 0), b) if a == -1 else ("DEL", n, None) if b == -1 else ("SUB", n, b))
        n += a != -1
    return out


def test_edits_are_those_of_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        n = rng.choice([0, 1, 2, 30])
        rows.append((k, [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)], [rng.choice([-1, 0, 1, 2]) for _ in range(n)]))
    got = spark.createDataFrame(rows, "k long, a array<int>, b array<int>").select("k", E.remaining_edits(F.col("a"), F.col("b")).alias("e")).collect()
    assert {r["k"]: [(e["kind"], e["pos"], e["token"]) for e in r["e"]] for r in got} == {k: plain_edits(a, b) for k, a, b in rows}


def test_long_rows_take_little_time(spark):
    n = 20_000
    flags = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 3 == 0).alias("m"))
    z = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 4 == 1, -1).otherwise(i % 7)).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 5 == 1, -1).otherwise(i % 6)).alias("b"))
    flags.select(C.context_weights(F.col("m"))).collect(), z.select(E.remaining_edits(F.col("a"), F.col("b"))).collect()
    began = time.perf_counter()
    weights = flags.select(C.context_weights(F.col("m"))).first()[0]
    edits = z.select(E.remaining_edits(F.col("a"), F.col("b"))).first()[0]
    assert time.perf_counter() - began < 4
    masked = [i % 3 == 0 for i in range(n)]
    for j in (0, 3, 9_999, n - 2):
        want = sum(0.5 * 0.3 * 0.7 ** (abs(i - j) - 1) for i in range(max(0, j - 200), min(n, j + 201)) if not masked[i]) if masked[j] else 0
        assert abs(weights[j] - want) < 1e-9
    assert [(e["kind"], e["pos"], e["token"]) for e in edits] == plain_edits([-1 if i % 4 == 1 else i % 7 for i in range(n)], [-1 if i % 5 == 1 else i % 6 for i in range(n)])


@pytest.mark.parametrize("p", [0.01, 0.3, 0.95, 1.0])
def test_context_weights_by_pairs(spark, p):
    rng = random.Random(7)
    rows = [(k, [rng.random() < 0.4 for _ in range(rng.choice([0, 1, 2, 50]))]) for k in range(12)] + [(99, None)]
    got = {r["k"]: r["w"] for r in spark.createDataFrame(rows, "k long, m array<boolean>").select("k", C.context_weights(F.col("m"), p).alias("w")).collect()}
    for k, m in rows:
        want = None if m is None else [sum(0.5 * p * (1 - p) ** (abs(i - j) - 1) for i in range(len(m)) if not m[i]) if m[j] else 0 for j in range(len(m))]
        assert want is got[k] is None or all(abs(x - y) < 1e-9 for x, y in zip(got[k], want, strict=True))


def test_the_edit_flow_step_by_hand(spark):
    rng = random.Random(5)
    pairs = {k: ([9, *(rng.randrange(4) for _ in range(rng.randint(0, 6)))], [9, *(rng.randrange(4) for _ in range(rng.randint(0, 6)))]) for k in range(10)}
    rate = lambda s, p, x, k: 0.2 + abs(math.sin(s + 2 * p + 3 * x + k))
    logit = lambda s, p, kind, v: math.sin(s + p + 5 * v + (kind == "INS"))

    def rates(canvas):
        x = F.col("seq") + 2 * F.col("pos") + 3 * F.col("tok")
        by_place = canvas.select("seq", "pos", *[(0.2 + F.abs(F.sin(x + k))).alias(n) for k, n in enumerate(("del_rate", "sub_rate", "ins_rate"))])
        toks = canvas.select("seq", "pos", F.explode(F.array(F.lit("SUB"), F.lit("INS"))).alias("kind")).select("*", F.explode(F.array(*[F.lit(v) for v in range(4)])).alias("token"))
        return by_place, toks.withColumn("logit", F.sin(F.col("seq") + F.col("pos") + 5 * F.col("token") + F.when(F.col("kind") == "INS", 1).otherwise(0)))

    df = spark.createDataFrame([(k, *p) for k, p in pairs.items()], "seq long, x0 array<int>, x1 array<int>")
    for per in (True, False):
        loss, rows = C.edit_flow_step(df, rates, kappa("cubic"), 8, per)
        got = {r["seq"]: r["loss"] for r in loss.collect()}
        held = {r["seq"]: r for r in rows.collect()}
        for k, (x0, x1) in pairs.items():
            z0, z1, _ = plain_align(x0, x1)
            t = (1 - 1e-3) * draw(str(k), "8/t")
            share = 2 * t**3 - 3 * t**2 + 2 * t
            weight = min((6 * t**2 - 6 * t + 2) / (1 - share + 1e-6), 20)
            zt = [b if draw(f"{k}/{i}", "8/mix") < share else a for i, (a, b) in enumerate(zip(z0, z1, strict=True))]
            xt = [x for x in zt if x != -1]
            assert held[k]["xt"] == xt and abs(held[k]["weight"] - weight) < 1e-9
            value = sum(rate(k, p, x, n) for p, x in enumerate(xt) for n in range(3))
            for kind, pos, token in plain_edits(zt, z1):
                value -= math.log(rate(k, pos, xt[pos], ("DEL", "SUB", "INS").index(kind)))
                if kind != "DEL":
                    value -= logit(k, pos, kind, token) - math.log(sum(math.exp(logit(k, pos, kind, v)) for v in range(4)))
            assert abs(got[k] - weight * value / (max(len(x1), 1) if per else 1)) < 1e-9
