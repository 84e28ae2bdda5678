"""Streaming queries: a whole table goes through a stream and comes out as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pack as P
from ..functions.rng import uniform_sql
from ..streaming import epochs as E
from ..streaming import pipelines as R
from ..storage import shared_folder as folder
from .chat import SFT, sft_rows, text_of
from .packing import CORPUS, LENGTH, TOKENS, corpus
from .registry import query, table


@query("stream_filter_clip", f"WITH {CORPUS} SELECT doc_id, least(len(input_ids), 256)::INT AS n FROM corpus WHERE len(input_ids) >= 64")
def stream_filter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "stream")
    corpus(spark, sf_dir).repartition(4).write.parquet(f"{root}/in")
    rows = R.scan(spark, f"{root}/in", "doc_id long, pack_group long, input_ids array<int>", 1).where(F.size("input_ids") >= 64)
    R.drain(P.clip_rows(rows, 256).select("doc_id", F.size("input_ids").alias("n")), f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, n int").parquet(f"{root}/out")


def _repeated(spark: SparkSession, rows: DataFrame, schema: str, root: str, step: int, epochs: int | None = 1, rows_per_task: int | None = None) -> DataFrame:
    """rows, saved in the order of doc_id, as a stream in that order."""
    rows.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{root}/in")
    return E.repeat(spark, f"{root}/in", schema, f"{root}/position", step, epochs, rows_per_task)


@query("stream_pack", f"WITH {TOKENS} SELECT pack_group, chunk, md5(array_to_string(ids, ',')) AS ids FROM chunks WHERE len(ids) = {LENGTH}")
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a corpus that comes in order, in two runs of the stream, with what is left over carried from one to the next."""
    root = folder(spark, "stream")
    n = table(spark, sf_dir, "documents").count()
    rows = _repeated(spark, corpus(spark, sf_dir), "doc_id long, pack_group long, input_ids array<int>, ord long", root, -(-2 * n // 3), 1, max(1, n // 16))
    for _ in range(2):
        R.drain(R.pack_stream(rows, LENGTH, "pack_group"), f"{root}/out", f"{root}/log")
    out = spark.read.schema("pack_group long, chunk long, input_ids array<int>").parquet(f"{root}/out")
    return out.select("pack_group", "chunk", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"))


@query("stream_batches", f"""WITH o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)
SELECT doc_id, lang, ord // 100 * 100 + row_number() OVER (PARTITION BY ord // 100 ORDER BY {uniform_sql('doc_id', 1)}, doc_id) - 1 AS place FROM o""")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch in a seeded random order, by windows of 100 rows of the stream."""
    root = folder(spark, "stream")
    n = table(spark, sf_dir, "documents").count()
    rows = _repeated(spark, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id long, lang string, ord long", root, max(100, n // 200 * 100))
    for _ in range(3):
        R.each_batch(rows, lambda b: R.shuffled_batch(b, "doc_id", 1, "ord", 100), f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, lang string, place long, batch int").parquet(f"{root}/out").select("doc_id", "lang", "place")


@query("stream_epochs", "SELECT i AS epoch, doc_id, i * (SELECT count(*) FROM documents) + row_number() OVER (PARTITION BY i ORDER BY doc_id) - 1 AS stream_ord FROM documents, range(3) r(i)")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of a stream without end, drained in two runs of one and a half."""
    root, docs = folder(spark, "stream"), table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    rows = _repeated(spark, docs, "doc_id long, epoch long, stream_ord long", root, -(-3 * n // 2), None, max(1, n // 5))
    for _ in range(2):
        R.drain(rows, f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, epoch long, stream_ord long").parquet(f"{root}/out").where(F.col("stream_ord") < 3 * n)


@query("stream_shuffle", f"""WITH RECURSIVE o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY lang) AS total FROM documents),
s AS (SELECT lang, doc_id, n, total, floor({uniform_sql("(lang || '/' || n)", 9)} * 16)::INT AS slot FROM o),
b AS (SELECT lang, 15::BIGINT AS n, list(doc_id ORDER BY n) AS buffer, NULL::BIGINT AS doc_id FROM o WHERE n < 16 GROUP BY lang
  UNION ALL SELECT b.lang, s.n, list_concat(list_append(b.buffer[1:s.slot], s.doc_id), b.buffer[s.slot + 2:]), b.buffer[s.slot + 1] FROM b JOIN s ON s.lang = b.lang AND s.n = b.n + 1),
last AS (SELECT lang, n, unnest(buffer) AS doc_id, generate_subscripts(buffer, 1) - 1 AS slot FROM b JOIN (SELECT lang, max(n) AS n FROM o GROUP BY lang) USING (lang, n))
SELECT lang, doc_id, n - 16 AS turn FROM b WHERE doc_id IS NOT NULL
UNION ALL SELECT lang, doc_id, n - 15 + row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql("(lang || '/end/' || slot)", 9)}) - 1 FROM last""")
def stream_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which buffers of 16 rows a language put rows out, in two runs of the stream, and then the rest."""
    root, docs = folder(spark, "stream"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    schema = "doc_id long, lang string, ord long"
    rows = _repeated(spark, docs, schema, root, -(-docs.count() // 2))
    for _ in range(2):
        R.drain(R.shuffle_buffer(rows, "lang", "ord", 16, 9), f"{root}/out", f"{root}/log")
    out = spark.read.schema(f"{schema}, turn long").parquet(f"{root}/out")
    rest = R.buffered_rest(spark, f"{root}/log", schema, "lang", 16, 9)
    return out.unionByName(rest).select("lang", "doc_id", "turn")


@query("stream_skip_pack", f"""WITH {TOKENS.replace('FROM documents', 'FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 90 OFFSET 40)')} SELECT pack_group, chunk, md5(array_to_string(ids, ',')) AS ids FROM chunks WHERE len(ids) = {LENGTH}""")
def stream_skip_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows 40 to 129 of a stream, counted in state over two runs, go on into packing in the same query."""
    root = folder(spark, "stream")
    kinds = "doc_id long, pack_group long, input_ids array<int>, ord long"
    rows = _repeated(spark, corpus(spark, sf_dir), kinds, root, -(-table(spark, sf_dir, "documents").count() // 2))
    with R.rocksdb(spark):
        for _ in range(2):
            R.drain(R.pack_stream(R.skip_take_stream(rows, 40, 90, "ord"), LENGTH, "pack_group"), f"{root}/out", f"{root}/log")
    out = spark.read.schema("pack_group long, chunk long, input_ids array<int>").parquet(f"{root}/out")
    return out.select("pack_group", "chunk", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"))


@query("stream_position_filter", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 90 OFFSET 40")
def stream_position_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by their position in the stream: a filter without state."""
    root, docs = folder(spark, "stream"), table(spark, sf_dir, "documents").select("doc_id")
    rows = _repeated(spark, docs, "doc_id long, stream_ord long", root, docs.count())
    R.drain(R.skip_take_stream(rows, 40, 90, "stream_ord"), f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, stream_ord long").parquet(f"{root}/out").select("doc_id")


@query("stream_meter", """SELECT event_type AS split, round(sum(value * w) / sum(w), 6) AS nll, round(exp(sum(value * w) / sum(w)), 3) AS ppl FROM (SELECT event_type, value / 100 AS value, 1 + event_id % 3 AS w FROM events) GROUP BY event_type""")
def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses that come in three runs of a stream; the meter's sums go on from one to the next."""
    root = folder(spark, "stream")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("split"), (F.col("value") / 100).alias("value"), (1.0 + F.col("event_id") % 3).alias("weight"))
    losses = _repeated(spark, rows, "doc_id long, split string, value double, weight double", root, -(-rows.count() // 3))
    for _ in range(3):
        R.meter(losses, f"{root}/meter", f"{root}/log")
    return R.metered(spark, f"{root}/meter").select("split", F.round("nll", 6).alias("nll"), F.round("ppl", 3).alias("ppl"))


@query("stream_clip_prompts", SFT + """SELECT conv_id, array_to_string(list_concat(input_ids[1:prompt_len], input_ids[prompt_len + 1 : 60]), ',') AS input_ids,
  array_to_string(list_concat(labels[1:prompt_len], labels[prompt_len + 1 : 60]), ',') AS labels FROM sft WHERE prompt_len <= 60""")
def stream_clip_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prompt fits, clipped behind it, as a stream."""
    root = folder(spark, "stream")
    kinds = "conv_id long, input_ids array<int>, labels array<int>, prompt_len int"
    sft_rows(spark, sf_dir).select("conv_id", "input_ids", "labels", "prompt_len").repartition(3).write.parquet(f"{root}/in")
    rows = R.scan(spark, f"{root}/in", kinds, 1)
    fits = P.post_process(rows, 60, "right")
    R.drain(P.clip_rows(fits, 60, keep_prompt=True), f"{root}/out", f"{root}/log")
    return spark.read.schema(kinds).parquet(f"{root}/out").select("conv_id", text_of("input_ids"), text_of("labels"))


@query("stream_union", "SELECT doc_id, 0 AS source_ord FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr'")
def stream_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "stream")
    for lang in ("en", "fr"):
        table(spark, sf_dir, "documents").where(F.col("lang") == lang).select("doc_id").write.parquet(f"{root}/{lang}")
    R.drain(R.union([R.scan(spark, f"{root}/en", "doc_id long"), None, R.scan(spark, f"{root}/fr", "doc_id long")]), f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, source_ord int").parquet(f"{root}/out")


@query("stream_skip_take", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 90 OFFSET 40")
def stream_skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files come in the order of their time; each holds a range of ids."""
    import time

    root = folder(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    for k, part in enumerate((docs.where("doc_id < 50"), docs.where("doc_id >= 50 AND doc_id < 120"), docs.where("doc_id >= 120"))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(0.05 if k < 2 else 0)
    R.skip_take(R.scan(spark, f"{root}/in", "doc_id long", 1), 40, 90, "doc_id", f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, batch long").parquet(f"{root}/out/rows").select("doc_id")
