"""The counted model against one computed from dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import kneser_ney as kn


def brute(train, order):
    texts = [["<s>", *t.encode().lower().split(), "</s>"] for t in train]
    raw = [Counter(tuple(t[i - k + 1 : i + 1]) for t in texts for i in range(max(1, k - 1), len(t))) for k in range(1, order + 1)]
    adjusted = [raw[-1]]
    for k in range(order - 1, 0, -1):
        types = Counter(g[1:] for g in raw[k])
        adjusted.insert(0, {g: types.get(g) or c for g, c in raw[k - 1].items()})
    drops = [kn.discounts(*[sum(c == n for c in a.values()) for n in (1, 2, 3, 4)]) for a in adjusted]
    context = [defaultdict(lambda: [0, 0.0]) for _ in range(order)]
    for k in range(order):
        for g, c in adjusted[k].items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][1] += drops[k][min(c, 3) - 1]
    vocab, total = len(raw[0]), sum(raw[0].values())

    def prob(gram):
        p = 1 / (vocab + 1)
        for k in range(min(order, len(gram))):
            g = gram[len(gram) - 1 - k :]
            tot, free = context[k].get(g[:-1], (0, 0))
            if tot:
                c = adjusted[k].get(g, 0)
                p = (max(c - drops[k][min(c, 3) - 1], 0) if c else 0) / tot + free / tot * p
            elif k:
                break
        return p

    def score(text):
        t = ["<s>", *text.encode().lower().split(), "</s>"]
        logs = sum(math.log10(prob(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))
        base = sum(math.log10((raw[0].get((w,), 0) + 1) / (total + vocab + 1)) for w in t[1:])
        return len(t) - 1, sum((w,) in raw[0] for w in t[1:]), base, logs

    return score, total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 30)) % 40) for _ in range(200)]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (None, "W1 w2 Ünseen"), (5, "w1 w1 w1"), (5, "w1 w1 w1"), (1002, "zz yy w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", kn.F.lit(1)).repartition(3)
    learnt = [t or "" for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    score, total = brute(learnt, order)
    got = kn.score_with_folds(df, order).collect()
    assert len(got) == len(rows)
    want = Counter((d, *[round(x, 6) for x in score(t or "")]) for d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 7 == 2) for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert kn.score_with_folds(df).count() == 0
    model = kn.train(df)
    one = kn.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (one["n_tokens"], one["n_known"], one["score"]) == (3, 0, 0.0)


def test_arrays_survive_the_way():
    keys = np.array([3, 5, 1 << 63, (1 << 64) - 1], dtype=np.uint64)
    got = kn.spread_out(kn.squeeze(keys, np.arange(4, dtype=np.uint64)))
    assert (got[0] == keys).all() and got[1].tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        kn.local_path("hdfs://host/x")
    assert kn.local_path("file:/a/b") == "/a/b" == kn.local_path("file:///a/b") == kn.local_path("/a/b")


def test_mapped_arrays_are_bounded_and_let_go(tmp_path):
    """A task's model keeps few arrays mapped, whatever the number of ranges, and none after the task; a pickled model brings none along."""
    import gc
    import os
    import pickle

    n = 300
    for r in range(n):
        kn.save_array(f"{tmp_path}/1", f"keys-{r}", np.array([r << 54], dtype=np.uint64))
        kn.save_array(f"{tmp_path}/1", f"adjusted-{r}", np.array([r], dtype=np.uint32))
    shards = kn.Shards(str(tmp_path), 1, n, [1] * n, 0)
    keys = np.array([r << 54 for r in range(n)], dtype=np.uint64)
    ranges = shards.ranges(keys)
    for r in {*ranges.tolist()}:
        kn.save_array(f"{tmp_path}/1", f"keys-{r}", keys[ranges == r])
        kn.save_array(f"{tmp_path}/1", f"adjusted-{r}", np.flatnonzero(ranges == r).astype(np.uint32))
    model = kn.Model([shards], [[0.5, 1, 1.5]], n, n, {})
    opened = lambda: sum("1/" in os.readlink(f"/proc/self/fd/{f}") and str(tmp_path) in os.readlink(f"/proc/self/fd/{f}") for f in os.listdir("/proc/self/fd") if os.path.islink(f"/proc/self/fd/{f}"))
    for _ in range(5):
        own = pickle.loads(pickle.dumps(model))
        rank, value = own.levels[0].find(keys, "adjusted")
        assert (rank >= 0).all() and value.tolist() == list(range(n))
        assert 0 < opened() <= 2 * kn.MAPS
        assert "held" not in pickle.loads(pickle.dumps(own)).levels[0].__dict__
        del own
        gc.collect()
        assert opened() == 0


def test_a_text_longer_than_a_segment(spark):
    """More than 4 MB of words, cut at white space: the same as the counts of a plain model."""
    long = " ".join(f"w{k * k % 977}" for k in range(900_000))
    assert len(long) > 1 << 22
    rows = [(0, long), (1, "w1 w4 w9"), (3, "other words")]
    learnt = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    score, total = brute(learnt, 2)
    got = {r["doc_id"]: r for r in kn.score_with_folds(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        want = score(t)
        assert (got[d]["n_tokens"], got[d]["n_known"]) == want[:2] and abs(got[d]["base_score"] / want[2] - 1) < 1e-9 and abs(got[d]["score"] / want[3] - 1) < 1e-9
        assert got[d]["train_tokens"] == total
