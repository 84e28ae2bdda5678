"""Queries over loading, uniting, cutting and splitting; `documents` stands for datasets whose configs are sources and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..sources import datasets as D
from .registry import query, table


def _docs(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """A reader whose path is `<folder>/<language>`."""
    folder, _, lang = path.rpartition("/")
    return D.with_split(table(spark, folder, "documents").where(F.col("lang") == lang).select("doc_id", "lang", F.col("doc_id").alias("ord")))


@query("load_union_truncate", """
SELECT * FROM (SELECT doc_id, lang, 'train' AS split, 0 AS source_ord FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50)
UNION ALL
SELECT * FROM (SELECT doc_id, lang, 'train', 1 FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20)
UNION ALL
SELECT * FROM (SELECT doc_id, lang, 'test', 1 FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 5)
""")
def load_union_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = {"en": _docs, "fr": _docs}
    return D.load(spark, f"{sf_dir}/en[train:50] | {sf_dir}/fr[train:20,test:5]", readers).select("doc_id", "lang", "split", "source_ord")


@query("overlap_truncate", """
SELECT * FROM (SELECT doc_id, 'train' AS split FROM documents ORDER BY doc_id LIMIT 30)
UNION ALL SELECT * FROM (SELECT doc_id, 'test' FROM documents ORDER BY doc_id LIMIT 10)
""")
def overlap_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limit_splits(_ordered(spark, sf_dir), {"train": 30, "test": 10}).select("doc_id", "split")


@query("disjoint_truncate", """
SELECT * FROM (SELECT doc_id, 'test' AS split FROM documents ORDER BY doc_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT doc_id, 'train' FROM documents ORDER BY doc_id LIMIT 30 OFFSET 10)
""")
def disjoint_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limit_stream_splits(_ordered(spark, sf_dir), {"train": 30, "test": 10}).select("doc_id", "split")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ord_=F.col("doc_id"))


@query("hash_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {uniform_sql('doc_id', 42)}, doc_id) <= ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, 42).select("doc_id", "split")


@query("split_then_filter", f"""
SELECT doc_id, split FROM (
  SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY {uniform_sql('doc_id', 42)}, doc_id) <= ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM documents) WHERE contains(text, 'License')
""")
def split_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the split, so it does not change who is in which split."""
    return D.hash_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", F.lit("License"))).select("doc_id", "split")


@query("lang_filter", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang") == "de").select("doc_id", "source")


@query("substring_filter", """
SELECT conv_id, reply FROM (
  SELECT conv_id, max(text) FILTER (turn = 1) AS reply FROM conversations GROUP BY conv_id) WHERE contains(reply, 'the')
""")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-sensitive, on the content of the second message."""
    from ..operators.text import chats

    rows = chats(table(spark, sf_dir, "conversations"))
    reply = F.get("messages", F.lit(1))["content"]
    return rows.select("conv_id", reply.alias("reply")).where(F.contains("reply", F.lit("the")))


@query("hash_shuffle", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY {uniform_sql('doc_id', 7)}, doc_id) AS place FROM documents
""")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in its buffer of 100."""
    from pyspark.sql.window import Window

    rows = D.shuffled(_ordered(spark, sf_dir), "doc_id", 7, 100)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy(F.floor(F.col("ord") / 100)).orderBy("shuffle_key", "doc_id")).cast("long").alias("place"))


@query("skip_take", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 40")
def skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").offset(40).limit(25)


@query("repeat_epochs", "SELECT i AS epoch, lang, count(*) AS n FROM documents, range(3) r(i) GROUP BY ALL")
def repeat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.repeated(_ordered(spark, sf_dir), 3)
    return rows.groupBy(F.col("epoch").cast("long").alias("epoch"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("config_union", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def config_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.all_configs(spark, ["src1", "src2"], lambda s, c: table(s, sf_dir, "documents").where(F.col("source") == c).select("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("merge_splits", """
SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT 'test' FROM documents WHERE lang = 'fr') GROUP BY split
""")
def merge_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda lang: table(spark, sf_dir, "documents").where(F.col("lang") == lang).select("doc_id")
    both = D.merge([{"train": by("en")}, {"train": by("de"), "test": by("fr")}])
    return D.concat([df.withColumn("split", F.lit(k)) for k, df in both.items()]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("split_rename", "SELECT CASE role WHEN 'user' THEN 'train' WHEN 'assistant' THEN 'test' ELSE role END AS split, count(*) AS n FROM conversations GROUP BY 1")
def split_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("role", "split")
    return D.rename_splits(rows, {"user": "train", "assistant": "test"}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("batch_slicing", "SELECT doc_id // 32 AS batch, count(*) AS n FROM documents GROUP BY 1")
def batch_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(D.batch_of(F.col("doc_id"), 32).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("length_batches", "SELECT doc_id, (ntile(10) OVER (ORDER BY n_chars, doc_id) - 1)::INT AS batch FROM documents")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10).select("doc_id", "batch")


_TEST = f"CASE WHEN row_number() OVER (ORDER BY {uniform_sql('doc_id', 42)}, doc_id) <= ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END"
_CHAT = "messages[0].content AS prompt, messages[1].content AS answer"


def _stored(spark: SparkSession, rows: DataFrame, name: str, config: str | None = None, root: str | None = None) -> str:
    """Rows as a saved dataset of that name; the folder."""
    from ..storage import shared_folder

    path = root or f"{shared_folder(spark, 'dataset')}/{name}"
    rows.write.parquet(f"{path}/{config}" if config else path)
    return path


def _chat_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"), "split")


def _loaded(spark: SparkSession, spec: str) -> DataFrame:
    from ..sources.readers import READERS

    return D.load(spark, spec, READERS)


@query("read_alpaca", f"SELECT lang || chr(10) || chr(10) || source AS prompt, text AS answer, {_TEST} AS split FROM documents")
def read_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit(" "), F.col("lang")).alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output"))
    return _chat_of(_loaded(spark, _stored(spark, rows, "tatsu-lab/alpaca")))


@query("read_opc_sft", f"SELECT * FROM (SELECT lang AS prompt, text AS answer, {_TEST} AS split FROM documents) WHERE contains(answer, 'License')")
def read_opc_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the parts are made."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("instruction"), F.col("text").alias("output"))
    path = _stored(spark, rows, "OpenCoder-LLM/opc-sft-stage1", "educational_instruct")
    return _chat_of(_loaded(spark, f"{path}[name:educational_instruct,lang:License]"))


@query("read_opc_annealing", "SELECT doc_id, 'train' AS split FROM documents WHERE lang = 'de'")
def read_opc_annealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three configs that keep the language in different columns."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (config, column) in enumerate((("algorithmic_corpus", "lang"), ("synthetic_qa", "program_lang"), ("synthetic_code_snippet", "lang"))):
        path = _stored(spark, docs.where(F.col("doc_id") % 3 == k).select("doc_id", F.col("lang").alias(column)), "OpenCoder-LLM/opc-annealing-corpus", config, path)
    return _loaded(spark, f"{path}[lang:de]").select("doc_id", "split")


@query("read_ultrachat", "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'test' ELSE 'train' END AS split, count(*)::INT AS n FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id")
def read_ultrachat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.text import chats

    split = F.element_at(F.array(F.lit("test_sft"), F.lit("train_sft"), F.lit("train_gen")), (F.col("conv_id") % 3 + 1).cast("int"))
    path = _stored(spark, chats(table(spark, sf_dir, "conversations")).withColumn("split", split), "HuggingFaceH4/ultrachat_200k")
    return _loaded(spark, path).select("conv_id", "split", F.size("messages").alias("n"))


@query("read_reasoning", "SELECT lang AS prompt, text AS answer, source AS reasoning FROM documents")
def read_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("question"), F.array("source", F.lit("other")).alias("thinking_trajectories"), F.col("text").alias("attempt"))
    m = F.col("messages")
    return _loaded(spark, _stored(spark, rows, "simplescaling/s1K")).select(m[0]["content"].alias("prompt"), m[1]["content"].alias("answer"), m[1]["reasoning_content"].alias("reasoning"))


@query("read_mixture", f"SELECT doc_id AS id, {_TEST} AS split FROM documents")
def read_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _loaded(spark, _stored(spark, rows, "allenai/tulu-3-sft-mixture")).select("id", "split")


@query("read_configured", "SELECT doc_id, 'train' AS split FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 'train' FROM documents WHERE lang = 'es'")
def read_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named config, and `all` where none is named."""
    docs, path = table(spark, sf_dir, "documents"), None
    for config, lang in (("all", "fr"), ("chat", "es"), ("code", "de")):
        path = _stored(spark, docs.where(F.col("lang") == lang).select("doc_id"), "HuggingFaceTB/smoltalk", config, path)
    return _loaded(spark, f"{path} | {path}[name:chat]").select("doc_id", "split")


@query("split_repeated_keys", f"""WITH k AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END AS key, lang FROM documents),
r AS (SELECT key, row_number() OVER (ORDER BY {uniform_sql("coalesce(key::VARCHAR, '')", 42)}, key NULLS FIRST) AS r, count(*) OVER () AS n FROM k)
SELECT key, count(*) FILTER (r <= ceil(0.3 * n)) AS test, count(*) FILTER (r > ceil(0.3 * n)) AS train FROM r GROUP BY key""")
def split_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys, many rows, null keys: every row keeps its place and the number of test rows is exact."""
    key = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7)
    rows = D.hash_split(table(spark, sf_dir, "documents").select(key.alias("key"), "lang"), "key", 0.3)
    return rows.groupBy("key").agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "train").alias("train"))


def _uneven_files(spark: SparkSession, rows: DataFrame, path: str, fmt: str = "parquet", options: dict | None = None) -> None:
    """Three files in the order of doc_id: of 7 rows, of most rows, and of the last 11."""
    last = rows.agg(F.max("doc_id")).first()[0] - 11
    parts = [rows.where("doc_id < 7"), rows.where((F.col("doc_id") >= 7) & (F.col("doc_id") <= last)), rows.where(F.col("doc_id") > last)]
    out = parts[0].coalesce(1).sortWithinPartitions("doc_id")
    for part in parts[1:]:
        out = out.unionByName(part.coalesce(1).sortWithinPartitions("doc_id"))
    (out.select(F.concat_ws(" ", "doc_id", "lang", "source").alias("value")) if fmt == "text" else out).write.format(fmt).options(**options or {}).save(path)


_PLACED = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)"


@query("read_file_order", f"SELECT doc_id, ord, 'train' AS split FROM {_PLACED} WHERE ord < 25 UNION ALL SELECT doc_id, ord, 'test' FROM {_PLACED} WHERE ord < 10")
def read_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows are those of the first files, however large the others are."""
    from ..storage import shared_folder

    path = f"{shared_folder(spark, 'dataset')}/HuggingFaceTB/smoltalk"
    _uneven_files(spark, table(spark, sf_dir, "documents").select("doc_id", "lang"), f"{path}/all")
    return _loaded(spark, f"{path}[train:25,test:10]").select("doc_id", "ord", "split")


@query("file_order", f"SELECT doc_id, ord FROM {_PLACED}")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place through files of unequal sizes."""
    from ..storage import shared_folder

    path = shared_folder(spark, "dataset")
    _uneven_files(spark, table(spark, sf_dir, "documents").select("doc_id"), path)
    return D.in_file_order(spark.read.parquet(path))


@query("load_pt_text", f"SELECT doc_id || ' ' || lang || ' ' || source AS value, CASE WHEN ord < 30 THEN 'test' ELSE 'train' END AS split FROM {_PLACED} WHERE ord < 110")
def load_pt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files through the pretraining loader, cut into disjoint parts."""
    from ..sources.readers import READERS
    from ..storage import shared_folder

    path = f"{shared_folder(spark, 'dataset')}/corpus.txt"
    _uneven_files(spark, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path, "text")
    return D.load_texts(spark, f"{path}[train:80,test:30]", READERS).select("value", "split")


@query("load_pt_epochs", f"SELECT doc_id, i AS epoch, i * 40 + ord - 10 AS stream_ord FROM {_PLACED}, range(3) r(i) WHERE ord BETWEEN 10 AND 49")
def load_pt_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming specification whose train part is repeated for ever, drained for three epochs in two runs."""
    from ..sources.readers import READERS
    from ..storage import shared_folder
    from ..streaming import pipelines as R

    root = shared_folder(spark, "dataset")
    _uneven_files(spark, table(spark, sf_dir, "documents").select("doc_id"), f"{root}/corpus")
    rows = D.load_texts(spark, f"{root}/corpus[train:40,test:10]", READERS, position=f"{root}/position", rows=60)
    for _ in range(2):
        R.drain(rows.select("doc_id", "epoch", "stream_ord"), f"{root}/out", f"{root}/log")
    return spark.read.schema("doc_id long, epoch long, stream_ord long").parquet(f"{root}/out")


@query("read_csv_json", "SELECT doc_id, lang, n_chars, 'csv' AS kind FROM documents UNION ALL SELECT doc_id, lang, n_chars, 'json' FROM documents")
def read_csv_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV by a declared schema, JSON by that of its first file."""
    from ..storage import shared_folder

    root, docs = shared_folder(spark, "dataset"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    _uneven_files(spark, docs, f"{root}/rows.csv", "csv", {"header": "true"})
    _uneven_files(spark, docs, f"{root}/rows.json", "json")
    csv = D.read_auto(spark, f"{root}/rows.csv", schema="doc_id long, lang string, n_chars long")
    json = D.read_auto(spark, f"{root}/rows.json")
    return csv.withColumn("kind", F.lit("csv")).unionByName(json.withColumn("kind", F.lit("json")))


@query("length_grouped", f"""WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {uniform_sql('doc_id', 5)}, doc_id) - 1 AS r FROM documents),
m AS (SELECT *, r // 24 * 24 + row_number() OVER (PARTITION BY r // 24 ORDER BY n_chars DESC, r) - 1 AS place FROM p),
top AS (SELECT arg_min(place, (-n_chars, place)) AS top FROM m WHERE place % 24 = 0)
SELECT doc_id, CASE WHEN place = 0 THEN top WHEN place = top THEN 0 ELSE place END AS place FROM m, top""")
def length_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Megabatches of three batches of eight, the longest of all rows first."""
    return D.length_grouped(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8, 5, 3).select("doc_id", "place")


@query("load_relative", f"SELECT doc_id, 'train' AS split, 0 AS source_ord FROM {_PLACED} WHERE ord < 12 UNION ALL SELECT doc_id, 'train', 1 FROM documents WHERE lang = 'de'")
def load_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative names below the folder of a setting, matched with readers by a part of their path."""
    import os

    from ..sources.specs import BASE_ENV
    from ..storage import shared_folder

    root, docs = shared_folder(spark, "dataset").removeprefix("file:"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    _uneven_files(spark, docs.select("doc_id"), f"{root}/HuggingFaceTB/smoltalk/all")
    _stored(spark, docs.withColumnRenamed("lang", "program_lang"), "", "synthetic_qa", f"{root}/OpenCoder-LLM/opc-annealing-corpus")
    before = os.environ.get(BASE_ENV)
    os.environ[BASE_ENV] = root
    try:
        return _loaded(spark, "HuggingFaceTB/smoltalk[train:12] + OpenCoder-LLM/opc-annealing-corpus[lang:de]").select("doc_id", "split", "source_ord")
    finally:
        os.environ.pop(BASE_ENV) if before is None else os.environ.update({BASE_ENV: before})
