"""Kernel against its definition, held-out accuracy, gapped insults and odd rows."""

from itertools import combinations

import numpy as np
import pytest

from seqloom.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def plain_kernel(a, b):
    def features(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < tx.SPAN:
                key = tuple(tx.codes(np.array([ord(word[x]) for x in (i, j, k)])).tolist())
                out[key] = out.get(key, 0) + tx.DECAY ** (k - i + 1)
        return out

    fa, fb = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    value = (dot(fa, fb) / (dot(fa, fa) * dot(fb, fb)) ** 0.5) ** 2
    return value if value >= tx.FLOOR else 0


def test_kernel_is_the_definition():
    names = ["^idiot", "^worthless", "^aaaa", "^éàü"]
    words = ["^idiot", "^idxiot", "^i.d.i.o.t", "^aaa", "^worth", "^lessworth", "^éàüö", "^abababab", "^" + "z" * 16]
    got = tx.Landmarks(names).kernel(words)
    for k, w in enumerate(words):
        assert got[k] == pytest.approx([plain_kernel(w, n) for n in names], abs=1e-5)
    assert tx.kernel_of(names)[0][0] == pytest.approx(1)


def test_units_and_windows():
    assert tx.units(b"you i d i o t, (moron) ok") == {b"you", b"idiot", b"moron"}
    assert "^idiot" in tx.variants(b"i-d-i-o-t")
    assert all(len(v) <= tx.LONGEST + 1 for v in tx.variants(b"x" * 100 + b"idiot" + b"y" * 30))


def training(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice([*"abdeghiklmnoprstuw"], rng.integers(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(600):
        own = [*rng.choice(vocabulary, 20)]
        if k % 3 == 0:
            own[k % 20] = ("idiot", "moron")[k % 2]
        docs.append((k, " ".join(own)))
        labels.append((k, int(k % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_gapped_and_inserted_insults(spark):
    docs, labels = training(spark)
    scorer = tx.train(docs, labels)
    texts = ["such an idiot he is", "an i d i o t", "what a mo-ron", "i.d.i.o.t", "an idiiot", "the sun ran on by the lake", "", None, "IDIOT"]
    odd = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("score", tx.F.lit("x"))
    got = {r["doc_id"] or 0: r["score"] for r in tx.score_documents(odd, scorer).collect()}
    assert all(got[k] >= 0.7 for k in (0, 1, 2, 3, 4, 8)) and all(got[k] < 0.5 for k in (5, 6, 7))
    assert tx.score_documents(docs.limit(0), scorer).count() == 0


def test_one_class_or_none(spark):
    docs, labels = training(spark)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        scorer = tx.train(docs, some)
        assert tx.score_documents(docs, scorer).where("score >= 0.5").count() == 0


def test_small_memory_changes_nothing():
    names = ["^idiot", "^moron", "^river"]
    texts = [b"an idiot by the river " * 3, b" ".join(b"w%d" % k for k in range(900)) + b" moron idiots", b"", b"rivers"]
    want = tx.TextKernel(tx.Landmarks(names)).rows(texts)
    assert np.allclose(tx.TextKernel(tx.Landmarks(names), 40).rows(texts), want)


def test_held_out_documents(spark):
    rows = tx.op3_kernel_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def plain_units(text):
    """Words without punctuation at their edges; runs of single letters are one word; three characters or more."""
    edges, found, single = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", set(), ""
    for raw in [w for w in "".join(c.lower() if ord(c) < 128 else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]:
        word = raw.strip(edges)
        if len(word.encode()) <= 1:
            single += word or raw.encode()[:1].decode("utf-8", "replace")
        else:
            found |= {single, word}
            single = ""
    return {w for w in found | {single} if len(w.encode()) >= 3}


def plain_variants(unit):
    text = unit.lower()
    forms = {text, "".join(c for c in text if c.isalpha())}
    out = set()
    for form in forms:
        if len(form) > tx.LONGEST:
            out |= {form[k : k + tx.LONGEST] for k in range(0, len(form) - tx.LONGEST // 2, tx.LONGEST // 2)}
        else:
            out.add(form)
    return {"^" + x for x in out if len(x) >= 3}


def plain_features(word):
    out = {}
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < tx.SPAN:
            key = tuple(tx.codes(np.array([ord(word[x]) for x in (i, j, k)])).tolist())
            out[key] = out.get(key, 0) + tx.DECAY ** (k - i + 1)
    size = sum(v * v for v in out.values()) ** 0.5
    return {k: v / size for k, v in out.items()} if size else {}


def plain_rows(texts, names):
    """Best kernels and the means of the three best, landmark by landmark, by the kernel's definition."""
    marks, known, out = [plain_features(n) for n in names], {}, []
    for text in texts:
        best = np.zeros((3, len(names)))
        for unit in plain_units(text):
            if unit not in known:
                rows = [[sum(v * m.get(k, 0) for k, v in f.items()) ** 2 for m in marks] for f in map(plain_features, plain_variants(unit))]
                row = np.array(rows).max(axis=0) if rows else np.zeros(len(names))
                known[unit] = np.where(row >= tx.FLOOR, row, 0)
            best = np.sort(np.concatenate([best, known[unit][None]]), axis=0)[-3:]
        out.append(np.concatenate([best[-1], best.mean(axis=0)]))
    return np.array(out)


def plain_fit(kernel, labels, names, penalty=3e-4):
    """The same problem by plain accelerated descent, and the logistic curve by plain descent."""
    blank = 1 + len(labels) // 5
    x, y = np.concatenate([kernel, np.zeros((blank, kernel.shape[1]))]), np.concatenate([labels, np.zeros(blank)])
    value, vector = np.linalg.eigh(tx.kernel_of(names))
    keep = value > 1e-4 * value.max()
    back = np.kron(np.eye(2), vector[:, keep] / np.sqrt(value[keep]))
    z, sign = np.concatenate([x @ back, np.ones((len(x), 1))], axis=1), np.where(y > 0, 1.0, -1.0)
    balance = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())
    speed = 1 / (penalty + 2 * np.linalg.eigvalsh((z * balance[:, None]).T @ z / len(z)).max())
    w = held = np.zeros(z.shape[1])
    for k in range(60_000):
        at = w + k / (k + 3) * (w - held)
        held = w
        gap = np.maximum(1 - sign * (z @ at), 0)
        grad = penalty * at - 2 * z.T @ (balance * sign * gap) / len(z)
        w = at - speed * grad
        if np.abs(grad).max() < 1e-12:
            break
    margin, a, b = z @ w, 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    step = 1.0 / (balance.sum() * (1 + margin**2).max())
    old = new = np.array([a, b])
    for k in range(200_000):
        at = new + k / (k + 3) * (new - old)
        p = 1 / (1 + np.exp(-(at[0] * margin + at[1])))
        grad = np.array([((p - target) * balance * margin).sum(), ((p - target) * balance).sum()])
        old, new = new, at - 4 * step * grad
        if np.abs(grad).max() < 1e-9:
            break
    return lambda rows: 1 / (1 + np.exp(-(new[0] * (np.concatenate([rows @ back, np.ones((len(rows), 1))], axis=1) @ w) + new[1])))


def test_scores_are_those_of_a_plain_scorer(spark):
    """300 documents scored by definition: units, kernel, three best, logistic curve; and a fit on their labels by plain descent."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scorer = tx.train(docs, labels)
    assert len(scorer.names) > 8
    rows = docs.where("n_chars < 1500").join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("toxic", "doc_id").collect()
    rows = (rows[:200] + rows[-100:])[:300]
    kernel = plain_rows([r["text"] for r in rows], scorer.names)
    got = {r["doc_id"]: r["score"] for r in tx.score_documents(docs, scorer).collect()}
    want = 1 / (1 + np.exp(-(kernel @ scorer.weights + scorer.bias)))
    assert max(abs(got[r["doc_id"]] - x) for r, x in zip(rows, want, strict=True)) < 1e-4
    flags = np.array([r["toxic"] for r in rows])
    assert 0 < flags.sum() < len(flags)
    own = tx.fit(kernel, flags, scorer.names)(kernel)
    assert np.abs(own - plain_fit(kernel, flags, scorer.names)(kernel)).max() < 1e-4


def test_repeated_ids_and_long_texts(spark):
    """Of repeated ids one text is learnt from, every row is scored; an insult behind 4 MB of clean words is found."""
    docs, labels = training(spark)
    again = docs.where("doc_id < 30").withColumn("text", tx.F.lit("the same clean words")).unionByName(docs.where("doc_id < 5"))
    scorer = tx.train(docs.unionByName(again), labels.unionByName(labels))
    long = "calm river words " * 300_000
    odd = spark.createDataFrame([(1, long + " you idiot"), (2, long), (2, "an idiot")], "doc_id long, text string")
    got = [(r["doc_id"], r["score"] >= 0.7) for r in tx.score_documents(odd, scorer).collect()]
    assert sorted(got) == [(1, True), (2, False), (2, True)]
