"""URL rules against a plain reading of them, mining against counting; search against all products."""

import re
from collections import Counter
from itertools import combinations

import numpy as np

from seqloom.llm import matrix_search as ms
from seqloom.llm import url_rules as ur


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_parts(spark):
    urls = [None, "", "no scheme/com/en/", "http://EXAMPLE.com/en/71", "https://www.example.com/en/8", "x://com/en/", "http://acom/en/", "http://a.net/de/8", "http://example.net/de/8x", "http://b.example.net/de/81?x=1#y", "http://É.org/es/", "http://org?/es/", "a://b://c.com/en/1", "http://com/EN/", "http://x.org/es/#//", "http://y.com\n/en/"]
    pages = spark.createDataFrame([(k if k else None, u) for k, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("host", ur.F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = Counter(tuple(r)[:5] for r in ur.judge(pages, labels).collect())
    want = Counter()
    for k, u in [*enumerate(urls), (3, urls[3])]:
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        want[(k if k else None, host, path, rule, verdict or "allow")] += 1
    assert got == want
    assert ur.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_are_the_counted_ones(spark):
    rng = np.random.default_rng(0)
    rows, pages = [], []
    for k in range(400):
        host = ("spam", "news", "blog")[k % 3]
        key = ("buy", "id", "q")[int(rng.integers(3))]
        bad = (host == "spam" and key == "buy") or rng.random() < 0.05
        pages.append((k, f"http://{host}.example.info/p/{k}?{key}=1"))
        rows.append((k, int(bad)))
    pages += [(1000, "http://spam.other.info/z?buy=2"), (1001, "http://spam.other.info/z?id=2"), (1002, None)]
    got = ur.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
    assert {r["page_id"]: r["verdict"] for r in got if r["page_id"] >= 1000} == {1000: "block", 1001: "allow", 1002: "allow"}
    frame = spark.createDataFrame(pages[:400], "page_id long, url string").select("page_id", ur.tokens_of(ur.F.col("url")).alias("tokens"))
    learnt = frame.join(spark.createDataFrame(rows, "doc_id long, toxic int").selectExpr("doc_id page_id", "toxic > 0 blocked"), "page_id").select("tokens", "blocked")
    mined = {tuple(r["tokens"]): r["confidence"] for r in ur.mine(learnt).collect()}
    counted = {}
    data = [(frozenset(r["tokens"]), r["blocked"]) for r in learnt.collect()]
    tokens = sorted({t for s, _ in data for t in s})
    share = sum(b for _, b in data) / len(data)
    for n in range(1, 7):
        for some in combinations(tokens, n):
            held = [b for s, b in data if s.issuperset(some)]
            if sum(held) >= max(10, 0.005 * len(data)) and sum(held) / len(held) >= 0.6 and sum(held) / len(held) / share >= 1.5 and (sum(held) / len(held) - share) / (share * (1 - share) / len(held)) ** 0.5 >= 4:
                counted[some] = sum(held) / len(held)
    kept = {s: c for s, c in counted.items() if not any({*o} < {*s} and d >= c for o, d in counted.items())}
    assert mined.keys() == kept.keys() and all(abs(mined[s] - kept[s]) < 1e-9 for s in kept)


def test_tokens_that_always_come_together_are_one(spark):
    """Thirty query keys shared by the blocked pages, three by half of the others: no 2^30 sets, and any of the keys blocks."""
    keys = "&".join(f"k{k}=1" for k in range(30))
    pages = [(k, f"http://shop.example.info/x?{keys if k % 4 == 0 else 'a=1&b=2&c=3' if k % 4 == 1 else 'id=7'}") for k in range(400)]
    labels = [(k, int(k % 4 == 0 and k % 20 != 0)) for k in range(400)]
    new = [(1000, "http://other.info/?k17=5"), (1001, "http://other.info/?a=1"), (1002, "http://shop.example.info/"), (1003, "http://x.example.info/?k3=1&k4=1&id=1")]
    got = ur.judge(spark.createDataFrame(pages + new, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r["page_id"]: r["verdict"] for r in got if r["page_id"] >= 1000} == {1000: "block", 1001: "allow", 1002: "allow", 1003: "block"}
    assert all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in got if r["page_id"] < 1000)


def test_rules_with_several_ways(spark):
    rules = [(1, ["a", "x"], [["a", "b"], ["x", "y"]]), (2, ["c"], [["c"]])]
    pages = [(1, ["a", "y"]), (2, ["b", "x", "a"]), (3, ["a", "b"]), (4, ["c", "y", "b"]), (5, [])]
    got = ur.match(spark.createDataFrame(pages, "page_row long, tokens array<string>"), spark.createDataFrame(rules, "rule_id long, tokens array<string>, ways array<array<string>>")).collect()
    assert {r["page_row"]: r["rule_ids"] for r in got} == {1: [1], 2: [1], 4: [1, 2]}


def test_few_rows_are_no_evidence(spark):
    rows = [(["h:a", f"p:{k % 9}"], k < 9) for k in range(90)]
    assert ur.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).count() == 0
    chance = [([f"h:{k % 3}", f"p:{k % 7}"], k % 5 < 3) for k in range(2100)]  # every set is blocked as often as all are
    assert ur.mine(spark.createDataFrame(chance, "tokens array<string>, blocked boolean"), min_lift=0.5).count() == 0


def test_verdicts_of_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rules = [(1, ["h:a", "p:x"]), (2, ["q:z"]), (3, ["h:a", "h:b", "p:y"]), (4, ["never"])]
    names = ["h:a", "h:b", "p:x", "p:y", "q:z", "h:com"]
    pages = [(k, ["h:com", *[t for t in names[:5] if rng.random() < 0.4]]) for k in range(200)]
    got = {r["page_row"]: r["rule_ids"] for r in ur.match(spark.createDataFrame(pages, "page_row long, tokens array<string>"), spark.createDataFrame(rules, "rule_id long, tokens array<string>")).collect()}
    want = {k: [i for i, need in rules if {*need} <= {*t}] for k, t in pages}
    assert got == {k: v for k, v in want.items() if v}


def test_documents_named_by_urls(spark):
    urls = ["http://a.com/en/12?x=1", "http://a.com/en/12/", "http://a.com/en/12.html", "http://a.com/en/x12", "http://a.com/12", None, "http://a.com/en/" + "9" * 40, "http://" + "a" * 200_000 + ".com/en/7" + "/b" * 100_000]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(ur.document_of(ur.F.col("url")).alias("d")).collect()
    assert [r["d"] for r in rows] == [12, 12, 12, None, None, None, None, 7]


def brute(vectors, asked, k):
    out = {}
    for i, (q, e) in enumerate(vectors):
        if asked(q):
            scores = []
            for j, (c, f) in enumerate(vectors):
                if i != j and len(e) == len(f):
                    s = 0.0
                    for a, b in zip(e, f):
                        s += float(a) * float(b)
                    scores.append((-s, c, j))
            out.setdefault(q, []).append([(n + 1, c, -s) for n, (s, c, _) in enumerate(sorted(scores)[:k])])
    return out


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(k), rng.normal(size=16).astype(np.float32).tolist()) for k in rng.permutation(700)]
    vectors += [(700 + k, vectors[5][1]) for k in range(150)] + [(40, vectors[9][1]), (860, [1.0, 2.0]), (880, [2.0, 1.0]), (861, [0.5, 0.5])]
    odd = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [float("inf")] + [1.0] * 15), (None, vectors[0][1]), (980, [])]
    df = spark.createDataFrame(vectors + odd + [(20, [None, 1.0])], "vec_id long, embedding array<float>").withColumn("rank", ms.F.lit(9))
    for sizes in ({"query_rows": 10, "vector_rows": 90}, {}):
        got = {}
        for r in ms.search(df, ms.F.col("vec_id") % 20 == 0, 20, **sizes).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = brute(vectors, lambda i: i % 20 == 0, 20)
        assert got.keys() == want.keys()
        for q, lists in want.items():
            assert sorted(got[q]) == sorted(x for one in lists for x in one)
    assert ms.search(df.limit(0), ms.F.col("vec_id") % 20 == 0).count() == 0


def test_long_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=2048)
    vectors = [(k, (base + rng.normal(size=2048) * 1e-3).astype(np.float32).tolist()) for k in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in ms.search(df, ms.F.col("vec_id") % 20 == 0, 20, vector_rows=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(vectors, lambda i: i % 20 == 0, 20)
    assert {q: sorted(x) for q, x in got.items()} == {q: one[0] for q, one in want.items()}
    codes = rng.integers(-127, 128, (9, 9000)).astype(np.int8)
    assert (ms.code_products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    full = np.full((2, 5000), 127, np.int8)
    assert (ms.code_products(full, full) == 127 * 127 * 5000).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 64)) * 10.0 ** rng.integers(-3, 4, (20, 1)), rng.normal(size=(300, 64)) * 10.0 ** rng.integers(-3, 4, (300, 1))
    (qc, qs, qn, ql), (xc, xs, xn, xl) = ms.quantise(q), ms.quantise(x)
    near = (qc.astype(float) @ xc.T.astype(float)) * qs[:, None] * xs
    assert (np.abs(near - q @ x.T) <= (qn + ql)[:, None] * xl + ql[:, None] * xn + 1e-9).all()
