"""Line runs against a dictionary count, the ring against its laws, packing against a round trip."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import line_runs, packing, ring

STRIP = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows, min_docs):
    keys = [[ascii_lower(x.strip(STRIP)) for x in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for ks in keys for k in {*ks} if len(k) >= 1)
    out = []
    for (doc, t), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if found[k] < min_docs]
        out.append((doc, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [2, 3])
def test_lines_match_a_plain_count(spark, tmp_path, fanout):
    rows = [(k, f"Shared Line\n\tshared LINE \nown {k}\n\nÉ shared\n{'x' * (k % 3)}") for k in range(40)]
    rows += [(None, None), (None, "shared line"), (7, ""), (7, "a\nb\n"), (99, " shared line"), (100, "z" * 300_000 + "\nshared line")]
    path = str(tmp_path / "d")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": line_runs.F.lit(1), "hits": line_runs.F.lit("x"), "row": line_runs.F.lit(2)})
    df.repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    batches = line_runs.batches_of(docs, 1000, 2)
    assert len(batches) > 2
    out = line_runs.drop_frequent_lines(docs, 10, 1, fanout, batches=batches)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = sorted([(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in out.collect()], key=repr)
    assert got == brute_lines(rows, 10)


def test_filtered_documents_are_one_batch(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(100).selectExpr("id AS doc_id", "'same' AS text").repartition(4).write.parquet(path)
    few = spark.read.parquet(path).where("doc_id < 5")
    assert len(line_runs.batches_of(few)) == 1
    assert line_runs.drop_frequent_lines(few).where("_n_dropped > 0").count() == 0


def test_batches_grow_and_hold_every_row_once(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('line ', id % 7, '\nown ', sha2(string(id), 512)) AS text")
    df.withColumn("_metadata", line_runs.F.lit(1)).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    parts = [[r["doc_id"] for r in b.collect()] for b in line_runs.batches_of(docs, 20_000, 3)]
    assert sorted(x for p in parts for x in p) == list(range(3000))
    assert len(parts) >= 3 and all(len(b) > 2 * len(a) for a, b in zip(parts[:-2], parts[1:-1]))
    assert [len(b.columns) for b in line_runs.batches_of(docs, 20_000, 3)][0] == 3


def test_the_query_runs_in_batches(spark, monkeypatch):
    """On a table of one file: several batches, anti joins with sealed keys, runs merged into higher levels."""
    seen = []
    add, merge = line_runs.LineRuns.add, line_runs.LineRuns._merge
    monkeypatch.setattr(line_runs.LineRuns, "add", lambda self, docs, text="text": (seen.append(("add", any(r[0] == "sealed" for r in self.runs))), add(self, docs, text))[1])
    monkeypatch.setattr(line_runs.LineRuns, "_merge", lambda self, runs, level: (seen.append(("merge", level)), merge(self, runs, level))[1])
    line_runs.op4_line_dedup(spark, "/root/testdata/sf0.01").count()
    adds = [x for k, x in seen if k == "add"]
    assert len(adds) >= 3 and adds[0] is False and adds[-1] is True
    assert [x for k, x in seen if k == "merge"]


def test_texts_with_many_frequent_lines(spark):
    """Lists longer than PARTS are cut; 60,000 lines of 6,000 frequent keys take seconds."""
    import time

    few = [(k, "\n".join(f"line {n}" for n in range(300 + k % 3)) + f"\nown {k}") for k in range(12)]
    df = spark.createDataFrame(few, "doc_id long, text string")
    got = sorted([(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in line_runs.drop_frequent_lines(df).collect()], key=repr)
    assert got == brute_lines(few, 10)
    many = [(k, "\n".join(f"line {n}" for n in range(6000)) * (10 if k == 0 else 1)) for k in range(10)]
    began = time.perf_counter()
    rows = line_runs.drop_frequent_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 30
    want = {d: [r for r in brute_lines(many, 10) if r[0] == d][0] for d in (0, 5)}
    assert all((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) == want[r["doc_id"]] for r in rows if r["doc_id"] in want)


def test_large_lists_are_joined(spark):
    rows = [(k % 3, f"Shared Line\nown {k}") for k in range(40)] + [(None, "shared line\ncopied")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"own": line_runs.F.lit(1), "salt": line_runs.F.lit(2), "t": line_runs.F.lit(3)}).repartition(5)
    out = line_runs.drop_frequent_lines(df, broadcast_bytes=0)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert sorted([(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in out.collect()], key=repr) == brute_lines(rows, 10)


def test_runs_are_reopened_by_the_next_job(spark, tmp_path):
    batch = lambda lo, hi: spark.createDataFrame([(k, f"all\n{'some' if k < 12 else 'none'} {k // 12}\nown {k}") for k in range(lo, hi)], "doc_id long, text string")
    path = None
    for n, (lo, hi) in enumerate([(0, 7), (7, 14), (14, 21), (21, 30)]):
        runs = line_runs.LineRuns.open(spark, path, min_docs=10) if path else line_runs.LineRuns(spark, 10)
        runs.add(batch(lo, hi))
        path = f"{tmp_path}/runs-{n}"
        runs.write(path)
    again = line_runs.LineRuns.open(spark, path, min_docs=10)
    assert {r[0] for r in again.runs} >= {"merged", "sealed"} and max(r[1] for r in again.runs) == 2
    keys = {r[0] for r in again.sealed().collect()}
    h = {t: spark.sql(f"SELECT xxhash64('{t}')").first()[0] for t in ("all", "some 0", "none 1", "own 3")}
    assert keys == {h["all"], h["some 0"], h["none 1"]}


def test_lines_of_an_empty_table(spark):
    assert line_runs.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ring_result(spark, keys, shards):
    df = spark.createDataFrame([(k, 1) for k in keys], "doc_id long, size long")
    return [tuple(r) for r in ring.shard_rows(df, "doc_id", ["size"], shards).collect()]


def test_ring_is_balanced_gapless_and_whole(spark):
    keys = [*range(500), *[None] * 300, *[3] * 200]
    got = ring_result(spark, keys, 16)
    assert Counter(r[0] for r in got) == Counter(keys)
    sizes = Counter(r[2] for r in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r[3] for r in got if r[2] == shard) == list(range(sizes[shard]))


def plain_ring(keys, shards, vnodes):
    """(place, shard) counts: a row at a time, own shards first, then the overflow clockwise."""
    import xxhash

    nodes = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 42) >> 48, s)
    circle = [nodes[p % 65536] for p in range(2 * 65536) if p % 65536 in nodes]
    places = sorted(nodes)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    got, over = Counter(), []
    for p in sorted(keys):
        at = next((k for k, q in enumerate(places) if q >= p), 0)
        if room[circle[at]]:
            room[circle[at]] -= 1
            got[p, circle[at]] += 1
        else:
            over.append((p, at))
    for p, at in over:
        at = next(k for k in range(at + 1, at + 1 + len(places)) if room[circle[k % len(places)]]) % len(places)
        room[circle[at]] -= 1
        got[p, circle[at]] += 1
    return got


def test_ring_against_a_plain_one(spark):
    keys = [*range(700), *[None] * 150, *[3] * 200]
    place = {r["k"]: r["p"] for r in spark.createDataFrame([(k,) for k in {*keys}], "k long").selectExpr("k", "shiftrightunsigned(xxhash64(k), 48) AS p").collect()}
    got = Counter((place[r[0]], r[2]) for r in ring_result(spark, keys, 16))
    assert got == plain_ring([place[k] for k in keys], 16, 128)


def test_ring_carries_columns_of_any_name(spark):
    names = ["rank", "shard", "slot", "_place", "_copies", "_sub", "_at", "k0"]
    df = spark.createDataFrame([(k, *[k * 10 + j for j in range(8)]) for k in (1, 2, 2, None) if k] + [(None, *range(8))], "doc_id long, " + ", ".join(f"`{n}` long" for n in names))
    out = ring.shard_rows(df, "doc_id", names, 3)
    assert out.columns == ["doc_id", *[n for n in names if n not in ("shard", "slot")], "shard", "slot"]
    rows = out.collect()
    assert Counter((r["doc_id"], r["rank"], r["_copies"]) for r in rows) == Counter({(1, 10, 14): 1, (2, 20, 24): 2, (None, 0, 4): 1})


def test_op9_of_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 400_000), (5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ring.op9_ring_shards(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)


def test_texts_longer_than_a_segment_keep_their_ids(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    text = "some words, é and more. " * 190_000  # above the 4 MB at which texts are cut
    assert len(text.encode()) > 1 << 22
    ids = whole.encode(text, add_special_tokens=False).ids + [1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["piece"]: (r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces_of(df).collect()}
    assert got == {k // 4096: (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}


def test_ring_moves_few_rows_and_handles_few(spark):
    one = {r[0]: r[2] for r in ring_result(spark, range(3000), 16)}
    two = {r[0]: r[2] for r in ring_result(spark, range(3000), 17)}
    assert sum(one[k] != two[k] for k in one) < 0.35 * len(one)
    assert ring_result(spark, [], 16) == []
    assert [r[3] for r in ring_result(spark, [5], 16)] == [0]


def test_chunked_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    whole, known = Tokenizer.from_file(path), packing.ChunkIds(path, 50)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert np.frombuffer(known.encode(row["text"].encode()), "<u4").tolist() == whole.encode(row["text"], add_special_tokens=False).ids
    for text in ["", " a  b\tC\n", "It's I'LL 42 x<|endoftext|>y <|startoftext|>", "É é ́x ÅΣς q z\x1cw", "naïve 日本語 🙂!!", "a" * 300 + " Ǆ", "end. End, a.b x!. é. q.\nw,. ab.́ c.' 's. it's, <|ENDOFTEXT|> A. <|x. Yes.", "ÀÉîõü ßaß ÿ ŷ Žđ ªº straße ÑANDÚ ǅ"]:
        ids = np.frombuffer(known.encode(text.encode()), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids


def test_signs_behind_a_word_are_chunks_of_their_own():
    path = packing.tokenizer_path(packing.TOKENIZER)
    known = packing.ChunkIds(path)
    known.encode("Word$$$ word### é&&& word.*** é!!\nword&&&".encode())
    assert {*known} == {b"word", "é".encode(), b"$$$", b"###", b"&&&", b".***", b"!!"}
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aZéÿÉßI $.'_`{~!?s<|9\n\u0144\u0338’İ=&") for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(known.encode(text.encode()), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_distinct_chunk_is_looked_up_and_learnt_once_for_many_texts(monkeypatch):
    path = packing.tokenizer_path(packing.TOKENIZER)
    known, asked, learn = packing.ChunkIds(path, 40), [], packing.ChunkIds.learn
    monkeypatch.setattr(packing.ChunkIds, "learn", lambda self, new: asked.extend(new) or learn(self, new))
    texts = ["The cat, the CAT.\n", "", "cat the", " \x0b\x0c", "a<|endoftext|> The cat", "naïve! the"] * 50
    ids = known.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len({*asked}) and {b"the", b"cat", b",", b".", b"a<|endoftext|>", b"The"} <= {*asked}
    asked.clear()
    known.encode_all([b"cat the."])
    assert asked == []
    for k in range(30):
        words = [f"w{chr(97 + k % 26)}{chr(97 + j)}" for j in range(k)]
        known.encode(" ".join(words).encode())
        assert len(known) + len(known.older) <= 40
    known.encode(b"cat")
    assert asked.count(b"cat") == 1  # forgotten at last, and learnt again


def test_a_workers_chunks_are_kept_from_task_to_task(spark):
    df = spark.range(64).selectExpr("id doc_id", "concat('kept words ', id) text").repartition(32)
    assert packing.pieces_of(df, remembered=1234).count() == 64

    def seen(batches):
        import os

        import pandas as pd

        from seqloom.llm import packing

        for _ in batches:
            yield pd.DataFrame([(os.getpid(), packing.chunk_ids.cache_info().hits)], columns=["pid", "hits"])

    hits = dict(tuple(r) for r in spark.range(64).repartition(32).mapInPandas(seen, "pid long, hits long").collect())
    assert sum(hits.values()) >= 8


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_fills_no_sequence_twice(histogram):
    runs = packing.plan_runs(histogram, 40)
    seen, used = Counter(), {}
    for n, rank, count, first, offset in runs:
        assert rank == seen[n]
        seen[n] += count
        for k in range(count):
            for p in range(offset, offset + n):
                assert p < 40 and used.setdefault((first + k, p), (n, rank + k, offset)) == (n, rank + k, offset)
    assert seen == Counter(histogram)
    for s in {s for s, _ in used}:
        places = sorted(p for t, p in used if t == s)
        assert places == list(range(len(places)))
        assert sum(1 for x in {v for (t, _), v in used.items() if t == s} if 3 * x[0] > 40) <= 2


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "word " * 70), (4, "word " * 70), (None, "x y z"), (5, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", packing.F.lit("clash"))
    got = packing.pack_documents(df, 32).collect()
    want = Counter()
    for doc, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 32):
            part = np.array(ids[k : k + 32], "<u4").tobytes()
            want[(doc, k // 32, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 32
    assert packing.pack_documents(df.limit(0), 32).count() == 0


def test_digest_of_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = line_runs.op4_line_dedup(spark, str(tmp_path)).first()
    assert row["kept_sha256"] == hashlib.sha256(b"a\nb").hexdigest() and (row["n_lines"], row["n_dropped"]) == (2, 0)


def test_op4_takes_several_batches(spark, tmp_path, monkeypatch):
    rows = [(k, f"own {k} {random.Random(k).randbytes(20_000).hex()}\nin all\n" + ("in nine" if k < 9 else "x")) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    sizes, merges = [], []
    add, merge = line_runs.LineRuns.add, line_runs.LineRuns._merge
    monkeypatch.setattr(line_runs.LineRuns, "add", lambda self, docs, text="text": sizes.append(docs.count()) or add(self, docs, text))
    monkeypatch.setattr(line_runs.LineRuns, "_merge", lambda self, runs, level: merges.append(len(runs)) or merge(self, runs, level))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_runs.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert len(sizes) > 1 and sum(sizes) == 40 and 2 in merges
    assert got == {k: (3, 1 if k < 9 else 2) for k in range(40)}
