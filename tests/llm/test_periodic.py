"""Periodic runs against the definition, tried for every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import periodic

SCHEMA = "doc_id long, text string"


def plain_runs(words, least=6, times=4):
    """For every period the maximal stretches; of those the ones that have no smaller period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 40, ["a", "b"] * 4, ["a", "b"] * 9 + ["a"])
    one, two = ["a"], ["a", "b"]
    while len(two) < 200:
        one, two = two, two + one
    yield two
    for n in (7, 20, 60, 130):
        for letters in (1, 2, 3):
            yield [rng.choice("abc"[:letters]) for _ in range(n)]
    for _ in range(30):
        block = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        yield [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + (block * 9)[: rng.randint(1, 8 * len(block))] + [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + block * 4


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_runs_are_those_of_the_definition(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    for words in texts():
        ids = np.array([ord(w) - 97 for w in words], dtype=np.int64)
        assert [tuple(r) for r in periodic.runs_of(ids).tolist()] == plain_runs(words), words


def test_other_bounds():
    words = "abcabcabcabcabcabcxxxxxxxxabababababab"
    ids = np.array([ord(w) for w in words], dtype=np.int64)
    assert [tuple(r) for r in periodic.runs_of(ids, 8, 6).tolist()] == plain_runs(words, 8, 6)
    with pytest.raises(ValueError, match="times"):
        periodic.runs_of(ids, 6, 3)


def test_long_texts():
    ids = np.tile(np.arange(977), 400)
    assert periodic.runs_of(ids).tolist() == [[0, 977 * 400, 977]]
    assert periodic.runs_of(np.zeros(300_000, dtype=np.int64)).tolist() == [[0, 300_000, 1]]
    assert len(periodic.runs_of(np.random.default_rng(1).integers(0, 50_000, 300_000))) == 0


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_rows(spark):
    """Nulls, empty and repeated texts, all kinds of white space, clashing names, an empty table."""
    data = [(1, "x " * 9 + "end"), (None, None), (2, ""), (2, " \t\n"), (3, "a b\x0bc\x0cd é é é é é é é"), (3, "x " * 9 + "end"), (4, "a b c a b c a b c a b c d")]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({"runs": F.lit("mine"), "row": F.lit(1), "n_words": F.lit(2)})
    out = periodic.with_runs(docs).collect()
    assert [(r["row"]["doc_id"], r["row"]["text"], r["row"]["runs"]) for r in out] == [(*d, "mine") for d in data]
    for r, (_, text) in zip(out, data, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), runs, collapsed(words, runs))
    assert periodic.with_runs(docs.where("doc_id > 9")).count() == 0


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(9)
    data = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 3, 8, 90])))) for k in range(300)] + [(301, None), (302, "")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(expected(*d) for d in data)
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in data) > 20


def test_query_on_short_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    short = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").collect()}
    got = {r["doc_id"]: tuple(r) for r in periodic.op13_periodic_runs(spark, sf).collect()}
    assert all(got[k] == expected(k, t) for k, t in short.items()) and len(short) > 100
