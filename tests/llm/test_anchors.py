"""SimHash anchors against all pairs."""

import random

import numpy as np
import xxhash

from seqloom.llm import anchors


def brute_fp(text, width):
    ws = [w for w in text.encode().lower().split()]
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choice(["Aa", "bb", "é", "d"]) + str(i % 50) for i in range(3000))
    want = brute_fp(text, 4)
    assert anchors.fingerprint(text.encode()) == want
    cut = anchors.segments
    monkeypatch.setattr(anchors, "segments", lambda data: cut(data, 100))
    assert anchors.fingerprint(text.encode()) == want
    for t in ("", " \n", "one", "a b c", "a b c d", "A B C D E"):
        assert anchors.fingerprint(t.encode()) == brute_fp(t, 4)


def test_block_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 21, 300)
    for t in (0, 1, 2):
        row, anchor, home = anchors.block_anchors(x, 6, t)
        assert home.sum() == len(x) and len({*zip(row.tolist(), anchor.tolist())}) == len(row)
        homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
        y = x.copy()
        for _ in range(t):
            y ^= 1 << rng.integers(0, 21, len(x))
        row2, anchor2, _ = anchors.block_anchors(y, 6, t)
        near = {*zip(row2.tolist(), anchor2.tolist())}
        assert all((k, homes[k]) in near for k in range(len(x)))


def near_rows(n, groups, seed):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = rng.getrandbits(64)
        for _ in range(n):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            out.append(base)
    return out


def run(spark, fps, most):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, first long")
    fps_df = df.groupBy("fp").agg(anchors.F.min("first").alias("first"))
    fps_df = fps_df.withColumn("more", anchors.F.array().cast("array<long>"))
    return {(r["node"]): r["root"] for r in anchors.linked(fps_df, 4, anchors.block_widths(64, 3), 1, most).collect()}


def test_links_are_all_found(spark):
    fps = near_rows(6, 60, 2) + [random.Random(5).getrandbits(64) for _ in range(200)]
    want = brute_components(range(len(fps)), fps, 4)
    for most in (20_000, 4):
        roots = run(spark, fps, most)
        signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
        got = [roots.get(s, s) for s in signed]
        for i in range(len(fps)):
            for j in range(i):
                assert (got[i] == got[j]) == (want[i] == want[j])


def test_dense_groups_use_the_forest():
    fps = np.array(near_rows(200, 2, 3), dtype=np.uint64)
    fps2 = np.stack([fps, np.zeros_like(fps)], axis=1)
    a, b = anchors.forest(fps2, fps, 4)
    want = brute_components(range(len(fps)), fps.tolist(), 4)
    groups = {int(f): w for f, w in zip(fps, want)}
    assert all(groups[int(x)] == groups[int(y)] for x, y in zip(a, b))
    assert len(a) == len({int(f) for f in fps}) - len({*groups.values()})
    starts, homes = np.array([0]), np.ones(len(fps), dtype=bool)
    sparse = {frozenset(p) for x, y in anchors.compare_groups(starts, fps2, fps, homes, 4, dense=500_000) for p in zip(x.tolist(), y.tolist())}
    assert sparse == {frozenset((int(x), int(y))) for x in fps for y in fps if x != y and bin(int(x) ^ int(y)).count("1") <= 4}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.replace("w7 ", "zz ")), (None, base), (11, ""), (4, None), (8, "hello there"), (2, "  \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": anchors.F.lit("x"), "root": anchors.F.lit(1)})
    got = {(r["doc_id"]): (r["fp"], r["component_id"]) for r in anchors.near_duplicates(df).collect()}
    fps = [brute_fp(t or "", 4) for _, t in rows]
    want = brute_components([d for d, _ in rows], fps, 4)
    for (doc, _), fp, comp in zip(rows, fps, want):
        assert got[doc] == (int(np.uint64(fp).astype(np.int64)), comp)
    assert anchors.near_duplicates(df.limit(0)).count() == 0


def test_one_of_similar_texts_stays(spark):
    rng = random.Random(4)
    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(40):
        base = text(rng.randint(120, 400))
        for c in range(3):
            copy = list(base)
            for at in range(rng.randrange(60), len(copy), 60) if c else ():
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
            groups[len(rows) - 1] = g
    rows += [(None, "  "), (7000, ""), (7001, None), (None, rows[0][1]), (7002, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"at": anchors.F.lit(1), "row": anchors.F.lit("x"), "fp": anchors.F.lit(2)})
    kept = anchors.one_of_similar(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7000) == 1 and None not in ids and 7001 not in ids and 7002 not in ids
    left = sorted(i for i in ids if i < 7000)
    assert {groups[i] for i in left} == set(range(40)) and len(left) <= 42
    assert anchors.one_of_similar(df.limit(0)).count() == 0


def brute_sets(texts, width=5):
    out = []
    for t in texts:
        ws = t.lower().split()
        out.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set()))
    return out


def brute_kept(texts, width=5):
    """Places of the texts that stay: the first of each component at similarity 0.8."""
    sets, root = brute_sets(texts, width), list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def kept_of(spark, texts, **options):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    return sorted(r["doc_id"] for r in anchors.one_of_similar(df, **options).collect())


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(6)
    texts = []
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(5, 195), 5 + k % 6 if k < 50 else 2):
            other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    texts += ["x x x x x", "x x x x x x x y"]  # of the three shingles in a row two are one: equal majorities
    want = brute_kept(texts)
    assert 60 < len(want) < len(texts) and {120, 121} <= {*want}
    assert kept_of(spark, texts) == want
    assert kept_of(spark, texts, most=300) == want


def test_similar_forest_spans_the_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(15):
            base = base.copy()
            base[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(base))
    sizes = np.array([len(x) for x in sets])
    a, b = anchors.similar_forest(np.concatenate(sets), sizes)
    whole = [{*x.tolist()} for x in sets]
    root = list(range(len(sets)))
    for i, x in enumerate(whole):
        for j, y in enumerate(whole[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len(a) == len(sets) - len({*root}) > 20 and len({*root}) > 12
    assert all(root[x] == root[y] for x, y in zip(a.tolist(), b.tolist())) and len({*b.tolist()}) == len(b)


def test_short_texts_beside_an_empty_one(spark):
    rng = random.Random(8)
    def text(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = ["", *[text(6) for _ in range(60)], *[text(8) for _ in range(60)], None, " "]
    kept = kept_of(spark, texts)
    assert kept == list(range(121))


def test_short_similar_texts_are_all_found(spark):
    rng = random.Random(9)
    texts = []
    for k in range(150):
        ws = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 9, 12, 13, 20, 34]))]
        texts += [" ".join(ws), " ".join(ws + ["more"] * (1 + k % 2)), " ".join(ws[1:])]
    want = brute_kept([t or "" for t in texts])
    assert 150 <= len(want) < 400
    assert kept_of(spark, texts) == want


def test_only_worded_texts_are_candidates(spark, monkeypatch):
    seen = []
    linked = anchors.linked
    monkeypatch.setattr(anchors, "linked", lambda fps, *a, **b: seen.append(fps.count()) or linked(fps, *a, **b))
    assert kept_of(spark, ["", "one two", None, "  "]) == [0, 1] and seen == [1]
