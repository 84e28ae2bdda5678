"""The pipeline's stages on planted rows, each held against what it has to do."""

import random
from collections import Counter

import corpus_pipeline
from seqloom.llm import packing

SF = "/root/testdata/sf0.01"


def test_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(0)
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    near = prose.replace(prose.split()[150], "another", 1)
    toxic = " ".join(["an idiot and a moron, worthless scum, pathetic trash and a stupid disgusting clown"] * 2)
    planted = [(10_001, prose), (10_002, prose), (10_003, near), (10_004, "fine words 1 " * 9 + item), (10_005, toxic), (10_006, ""), (10_007, None), (None, "text without an id " * 3)]
    planted += [(10_100 + k, f"own line {k} {rng.random()}\n  A line COMMON to many \nlast {k}") for k in range(12)]
    extra = spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in planted], docs.schema)
    sf = str(tmp_path)
    docs.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        seen[name] = now.collect()
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in seen.items()}
    gone = [d for d in (10_001, 10_004, 10_006, 10_007, None, 10_100) if not ids["toxicity"][d]]
    assert ids["toxicity"][10_005] == 0 and not gone and all(ids["toxicity"][d] for d in (10_001, 10_004, 10_006, 10_007, None, 10_100))
    assert ids["line_dedup"] == ids["toxicity"]
    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert all("COMMON" not in texts[10_100 + k] and texts[10_100 + k].endswith(f"last {k}") for k in range(12))
    assert ids["simhash_near_dedup"][10_001] == 1 and not ids["simhash_near_dedup"][10_002] and not ids["simhash_near_dedup"][10_003]
    assert ids["simhash_near_dedup"][10_004] and ids["simhash_near_dedup"][None]
    assert not ids["decontamination"][10_004] and ids["decontamination"][10_001]
    assert {*ids["decontamination"]} == {*ids["best_fit_packing"]}
    room = Counter()
    for r in seen["best_fit_packing"]:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096
    whole = {**{name: c for name, c in ids.items()}}
    assert whole["decontamination"].total() > 600


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).columns == [*[c.split()[0] for c in packing.PIECES.split(", ")], "sequence_id", "offset"]


def test_stages_on_no_rows_and_on_clashing_names(spark, tmp_path):
    """Every stage keeps an empty table empty, and columns that are named like its own come through."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["row", "score", "text_id", "key", "hits", "own", "t", "h", "root", "label", "_body", "lines"]
    odd = docs.withColumns({n: F.concat(F.lit(f"{n} of "), "doc_id") for n in names})
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        for kind, some in (("none", odd.where("doc_id < 0")), ("some", odd)):
            some.write.parquet(f"{tmp_path}/{n}-{kind}")
            got = stage(spark, spark.read.parquet(f"{tmp_path}/{n}-{kind}"), SF)
            rows = got.collect()
            assert got.columns == odd.columns and (kind == "some") == bool(rows), name
            assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names), name
    assert corpus_pipeline.STAGES[4][1](spark, odd.where("doc_id < 0"), SF).count() == 0


def test_stages_give_workers_small_batches(spark, tmp_path):
    """A batch is held by the JVM, outside its heap, and by the worker; 20 MB in one split are several batches."""
    from pyspark.sql import functions as F

    from seqloom.storage import BATCH

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text")).coalesce(1)
    for stage in (s for name, s in corpus_pipeline.STAGES if name != "line_dedup"):
        spark.conf.unset(limit)
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(5), SF)
        sizes = docs.mapInArrow(_sizes, "size long").agg(F.max("size"), F.sum("size")).first()
        assert 20_000_000 < sizes[1] and sizes[0] < 2 * BATCH
    spark.conf.set(limit, "1m")
    corpus_pipeline.STAGES[4][1](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(5), SF)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)


def _sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])
