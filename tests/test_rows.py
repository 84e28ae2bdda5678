"""Row operators on small fixtures: sources, packing, trimming, alignment, decoding and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import align as E
from seqloom.operators import corrupt as C
from seqloom.operators import decode as L
from seqloom.operators import metrics as M
from seqloom.operators import pack as P
from seqloom.operators import samplers as D
from seqloom.operators import text as X
from seqloom.sources import datasets as S
from seqloom import storage
from seqloom.storage import dealt
from seqloom.streaming import pipelines as R

IDS = "input_ids array<int>, labels array<int>, attention_mask array<int>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_concat_and_merge(spark):
    a, b = frame(spark, [(1,), (2,)], "x long"), frame(spark, [(3,), (4,)], "x long")
    assert [r["x"] for r in S.concat([a, b]).orderBy("source_ord", "x").collect()] == [1, 2, 3, 4]
    assert S.concat([a, a, None]).count() == 2
    with pytest.raises(ValueError):
        S.concat([None])
    both = S.merge([{"train": a}, {"train": b, "test": a}])
    assert {k: v.count() for k, v in both.items()} == {"train": 4, "test": 2}
    with pytest.raises(ValueError):
        S.merge([])


def test_truncation(spark):
    rows = spark.range(5).select(F.col("id").alias("ord"))
    assert S.head(rows, 2).count() == 2 and S.head(rows, 10).count() == 5 and S.head(rows, None) is rows
    two = S.with_split(rows, "train").unionByName(S.with_split(rows, "test"))
    got = {r["split"]: r["count"] for r in S.limit_splits(two, {"train": 3, "test": 2}).groupBy("split").count().collect()}
    assert got == {"train": 3, "test": 2}
    assert S.limit_splits(two, {"train": 1}).count() == 6
    assert S.limit_stream_splits(two, {"train": 1}).count() == 1


def test_load_and_sinks(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(10).selectExpr("id AS ord", "'t' AS text").write.parquet(f"{folder}/part.parquet")
    readers = {"part": lambda s, path, own: S.with_split(S.read_auto(s, path))}
    assert S.load(spark, f"{folder}/part.parquet[train:4,test:2]", readers).count() == 6
    assert S.load(spark, f"{folder}/part.parquet[train:4,test:2]", readers, streaming=True).select("ord").distinct().count() == 6
    with pytest.raises(ValueError):
        S.load(spark, "unknown", readers)
    rows = frame(spark, [([1, 2], [1, 2], [1, 1], "train", 5)], IDS + ", split string, extra long")
    S.write_sft(rows, f"{folder}/sft")
    assert {*S.load(spark, f"{folder}/sft", {}, preprocessed=True).columns} == {"input_ids", "labels", "attention_mask", "split", "source_ord"}
    path = S.write_pt(rows, folder, 128, True, False)
    assert "max_length-128-insert_eos-True-drop_tail-False" in path and "extra" not in spark.read.parquet(path).columns
    (tmp_path / "map.json").write_text(json.dumps({"3": 1, "5": 0}))
    assert sorted(tuple(r) for r in S.cluster_map(spark, f"{folder}/map.json").collect()) == [(3, 1), (5, 0)]
    with pytest.raises(ValueError):
        S.all_configs(spark, [], None)


def test_transform_registry(spark):
    @S.transform("double_id")
    def double_id(df, by=2):
        return df.withColumn("id", F.col("id") * by)

    assert S.use("double_id", by=3)(spark.range(3)).agg(F.sum("id")).first()[0] == 9
    assert S.use("seqloom.operators.pack.drop_mask")(frame(spark, [([1], [1], [1])], IDS)).columns == ["input_ids", "labels"]
    with pytest.raises(ValueError):
        S.use("none")


def test_collators(spark):
    rows = frame(spark, [([1, 2, 3], [1, 2, 3], [1, 1, 1])], IDS)
    out = P.prepend_bos(rows, 99).first()
    assert (out["input_ids"], out["labels"], out["attention_mask"]) == ([99, 1, 2, 3], [-100, 1, 2, 3], [1, 1, 1, 1])
    for none in (None, 0):
        with pytest.raises(ValueError):
            P.prepend_bos(rows, none)
    stacked = P.collate(lambda d: P.prepend_bos(d, 99), P.drop_mask)(rows)
    assert stacked.columns == ["input_ids", "labels"] and P.drop_mask(stacked).columns == stacked.columns
    assert P.random_truncate(rows.withColumn("b", F.lit(1)), "b", 0.0, 1).first()["attention_mask"] == [1, 1, 1]
    cut = P.random_truncate(rows.withColumn("b", F.lit(1)), "b", 1.0, 1).first()
    assert cut["input_ids"] == [1, 2, 3] and cut["labels"].count(-100) == cut["attention_mask"].count(0)


def test_trims(spark):
    rows = frame(spark, [([10, 11, 12, 1, 99], [10, 11]), ([0, 0, 10, 11, 12], [10, 11]), ([10, 11], [10, 11])], "s array<int>, p array<int>")
    got = [r[0] for r in rows.select(P.trim_sample(F.col("s"), F.col("p"), 0, [1])).collect()]
    assert got == [[12], [12], []]
    infill = frame(spark, [([10, 20, 11, 21], [10, 99, 11, 99]), ([10, 20, 1, 21], [10, 99, 99, 99])], "s array<int>, p array<int>")
    assert [r[0] for r in infill.select(P.trim_infill(F.col("s"), F.col("p"), 99, 0, [1])).collect()] == [[20, 21], [20]]


def test_packing(spark):
    rng = random.Random(0)
    docs = [(k, k // 7, [rng.randrange(100) for _ in range(rng.choice([0, 1, 5, 40]))]) for k in range(30)]
    df = frame(spark, docs, "d long, g long, input_ids array<int>")
    for drop in (True, False):
        want = {}
        for g in {d[1] for d in docs}:
            flat = [x for d in docs if d[1] == g for x in d[2]]
            for k in range(0, len(flat), 16):
                if len(flat[k : k + 16]) == 16 or not drop:
                    want[(g, k // 16)] = flat[k : k + 16]
        assert {(r["g"], r["chunk"]): r["input_ids"] for r in P.pack(df, 16, "g", "d", drop).collect()} == want


def test_packing_shuffles_ids_once(spark):
    rows = frame(spark, [(g, d, [d] * (d + 1)) for g in (0, 1) for d in range(9)], "g long, d long, input_ids array<int>")
    plan = P.pack(rows, 4, "g", "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_small_scans_are_dealt_over_cores(spark, tmp_path, monkeypatch):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(50).repartition(30).write.parquet(f"{tmp_path}/many")
    few, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "many"))
    cores = spark.sparkContext.defaultParallelism
    assert dealt(few).rdd.getNumPartitions() == cores and sorted(r[0] for r in dealt(few).collect()) == [*range(50)]
    assert few.rdd.getNumPartitions() < cores <= many.rdd.getNumPartitions() and dealt(many) is many
    spark.range(50).repartition(cores - 1).write.parquet(f"{tmp_path}/most")
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64m"), spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        most = spark.read.parquet(f"{tmp_path}/most")
        assert cores // 4 < most.rdd.getNumPartitions() < cores
        assert dealt(most) is not most  # little to move
        monkeypatch.setattr(storage, "ENOUGH", 1)
        assert dealt(most) is most and dealt(few) is not few  # much in each of nearly as many splits; one split is moved anyway
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0]), spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_clips_and_labels(spark):
    rows = frame(spark, [([1, 2, 3, 4, 5], 2), ([1, 2, 3], 3), ([1], -1)], "input_ids array<int>, prompt_len int")
    clip = lambda **k: [r["input_ids"] for r in P.clip_rows(rows, k.pop("n"), **k).collect()]
    assert clip(n=3) == [[1, 2, 3], [1, 2, 3], [1]] and clip(n=2, side="left") == [[4, 5], [2, 3], [1]]
    assert clip(n=3, keep_prompt=True) == [[1, 2, 3], [1, 2, 3], [1]] and clip(n=3, side="left", keep_prompt=True) == [[1, 2, 5], [1, 2, 3], [1]]
    assert clip(n=2, side="left", keep_prompt=True) == [[1, 2], [1, 2, 3], [1]]
    with pytest.raises(ValueError):
        P.post_process(rows, 3, "middle")
    with pytest.raises(ValueError):
        P.start_sampler("none")


def test_first_turns(spark):
    chats = [[("user", " hi "), ("assistant", "ho")], [("system", "s"), ("assistant", "x"), ("user", "q"), ("user", "r"), ("assistant", "a"), ("assistant", "b")], [("user", "q"), ("assistant", " ")], [("user", "q")], []]
    df = frame(spark, [(c,) for c in chats], f"messages {X.MESSAGES}")
    got = [r[0] and tuple(r[0]) for r in df.select(X.first_turn(F.col("messages"))).collect()]
    assert got == [("hi", "ho"), ("q", "a"), None, None, None]


def plain_align(a, b):
    import functools

    @functools.cache
    def cost(i, j):
        if not i or not j:
            return i + j
        return min(cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    return cost(len(a), len(b))


def test_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        z0, z1, cost = E.aligned(a, b)
        assert cost == plain_align(a, b) == sum(x != y for x, y in zip(z0, z1))
        assert [x for x in z0 if x != -1] == a and [x for x in z1 if x != -1] == b and len(z0) == len(z1)
    assert E.aligned([1, 2], [2, 1])[:2] == ([1, 2], [2, 1]) and E.aligned([], [5])[:2] == ([-1], [5])


def test_context_weights(spark):
    masked = [True, False, True, True, False]
    got = frame(spark, [(masked,)], "m array<boolean>").select(C.context_weights(F.col("m"), 0.3)).first()[0]
    want = [sum(0.5 * 0.3 * 0.7 ** max(abs(i - j) - 1, 0) for i, m in enumerate(masked) if not m and i != j) if masked[j] else 0 for j in range(5)]
    assert got == pytest.approx(want)


def test_metrics(spark):
    rows = frame(spark, [("train", 1.0, 2.0), ("train", 2.0, 2.0), ("eval", 1.0, 1.0), ("none", 5.0, 0.0)], "split string, value double, weight double")
    got = {r["split"]: (r["nll"], r["ppl"]) for r in M.meter(rows).collect()}
    assert got["train"][0] == 1.5 and got["eval"][1] == pytest.approx(2.718281828) and got["none"] == (0.0, 1.0)
    assert {r["name"] for r in M.named(M.meter(rows)).collect()} == {"nll", "ppl", "eval_nll", "eval_ppl", "none_nll", "none_ppl"}


def test_programs_keep_what_is_given(spark):
    rng = random.Random(2)
    logits = frame(spark, [(s, p, t, rng.gauss(0, 2)) for s in range(3) for p in range(8) for t in range(6)], "seq long, pos int, tok int, logit double")
    canvas = frame(spark, [(s, p, p if p < 3 else 9, not (s == 2 and p == 7)) for s in range(3) for p in range(8)], "seq long, pos int, tok int, is_valid boolean")
    for key in ("masked", "origin", "parallel_factor", "remasking"):
        from dataclasses import replace

        out = D.run(canvas, lambda c: logits, 9, replace(D.PROGRAMS[key], steps=3, block_size=5), 3)[0].collect()
        final = {(r["seq"], r["pos"]): r["tok"] for r in out}
        assert all(final[s, p] == p for s in range(3) for p in range(3)) and final[2, 7] == 9
        assert all(v != 9 for k, v in final.items() if k != (2, 7)), key
    with pytest.raises(NotImplementedError):
        D.infill(canvas, lambda c: logits, 9, D.PROGRAMS["hybrid"])
    assert L.gumbel(logits, 0, 1) is logits and L.top_p(logits, None) is logits
    with pytest.raises(ValueError):
        L.confidence(logits, "none")


def test_packing_stream_is_the_batch_plan_by_file(spark, tmp_path):
    rows = [(k, 0, [k * 3 + i for i in range(3)]) for k in range(20)]
    for n in range(4):
        frame(spark, rows[5 * n : 5 * n + 5], "ord long, g long, input_ids array<int>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = R.scan(spark, f"{tmp_path}/in", "ord long, g long, input_ids array<int>", 1)
    R.drain(R.pack_stream(stream, 7, "g"), f"{tmp_path}/out", f"{tmp_path}/log")
    got = {r["chunk"]: r["input_ids"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == [*range(8)] and all(len(v) == 7 for v in got.values())
    used = [x for v in got.values() for x in v]
    assert len({*used}) == 56


def test_windowed_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = R.scan(spark, f"{tmp_path}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    R.drain(R.windowed_losses(stream).select("event_type", "mean", "n"), f"{tmp_path}/out", f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] > 0


def test_cutting_collator_leaves_batches_with_one_token_responses(spark):
    rows = frame(spark, [(0, 0, 2, [5, 6, 7], [-100, -100, 7], [1, 1, 1]), (0, 1, 1, [5, 6, 7, 8], [-100, 6, 7, 8], [1, 1, 1, 1]), (1, 2, 1, [5, 6, 7, 8], [-100, 6, 7, 8], [1, 1, 1, 1])], f"batch long, id long, prompt_len int, {IDS}")
    out = {r["id"]: r for r in P.cutting_collator("batch", "id", 0, 3, ratio=1.0)(rows).collect()}
    assert out[0]["input_ids"] == [5, 6, 7, 0] and out[0]["labels"] == [-100, -100, 7, -100] and out[0]["attention_mask"] == [1, 1, 1, 0]
    assert out[1]["input_ids"] == [5, 6, 7, 8] and 2 <= len(out[2]["input_ids"]) < 4
    assert {len(r["input_ids"]) for r in P.cutting_collator("batch", "id", 0, 3)(rows).collect()} == {4}
    assert P.cutting_collator("batch", "id", 0, 3, per_batch=True)(rows.limit(0)).count() == 0


def test_label_mismatches_condition_reads_columns_not_their_expressions(spark):
    texts = frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, ""), (4, None)], "conv_id long, text string")
    rows = texts.select("conv_id", X.token_ids(F.col("text")).alias("input_ids"), F.lit(2).alias("prompt_len"))
    rows = rows.withColumn("labels", P.sft_labels(F.col("input_ids"), F.col("prompt_len")))
    wrong = rows.withColumn("labels", F.transform("labels", lambda x, i: F.when((F.col("conv_id") == 2) & (i == F.size("labels") - 1), x + 1).otherwise(x)))
    found = C.label_mismatches(wrong)
    assert found.columns == wrong.columns
    assert [r["conv_id"] for r in found.collect()] == [2]
    conditions = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "exists(" in x]
    assert conditions and not any("md5" in x for x in conditions)
