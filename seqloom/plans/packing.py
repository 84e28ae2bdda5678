"""Queries over packing, padding, truncation and trimming, and the flagship report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..operators import pack as P
from ..operators import text as X
from ..storage import dealt
from .chat import SFT, ids_sql, sft_rows, text_of
from .registry import query, table

EOS, BOS, PAD, MASK, LENGTH, GROUP = 2, 1, 0, 3, 128, 1000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pack_group, input_ids) with an end id."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.floor(F.col("doc_id") / GROUP).alias("pack_group"), P.append_eos(X.token_ids(F.col("text")), EOS).alias("input_ids"))


CORPUS = f"""corpus AS (SELECT doc_id, doc_id // {GROUP} AS pack_group, CASE WHEN len(ids) > 0 AND ids[len(ids)] = {EOS} THEN ids ELSE list_append(ids, {EOS}) END AS input_ids
  FROM (SELECT doc_id, {ids_sql("coalesce(text, '')")} AS ids FROM documents))"""
TOKENS = f"""{CORPUS}, tokens AS (SELECT pack_group, tok, row_number() OVER (PARTITION BY pack_group ORDER BY doc_id, p) - 1 AS i
  FROM (SELECT doc_id, pack_group, unnest(input_ids) AS tok, generate_subscripts(input_ids, 1) AS p FROM corpus)),
chunks AS (SELECT pack_group, i // {LENGTH} AS chunk, list(tok ORDER BY i) AS ids FROM tokens GROUP BY ALL)"""


@query("append_eos", f"WITH {CORPUS} SELECT doc_id, len(input_ids)::INT AS n, input_ids[len(input_ids)]::INT AS last FROM corpus")
def append_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size("input_ids").alias("n"), F.element_at("input_ids", -1).alias("last"))


@query("pack_sequences", f"WITH {TOKENS} SELECT pack_group, chunk, md5(array_to_string(ids, ',')) AS ids FROM chunks WHERE len(ids) = {LENGTH}")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.pack(corpus(spark, sf_dir), LENGTH, "pack_group", "doc_id")
    return rows.select("pack_group", "chunk", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"))


@query("pack_keep_tail", f"WITH {TOKENS} SELECT pack_group, count(*) AS chunks, sum(len(ids))::BIGINT AS tokens, min(len(ids))::INT AS shortest FROM chunks GROUP BY pack_group")
def pack_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.pack(corpus(spark, sf_dir), LENGTH, "pack_group", "doc_id", drop_tail=False)
    n = F.size("input_ids")
    return rows.groupBy("pack_group").agg(F.count(F.lit(1)).alias("chunks"), F.sum(n.cast("long")).alias("tokens"), F.min(n).alias("shortest"))


_KEY = "(pack_group::VARCHAR || '/' || chunk::VARCHAR)"


@query("corpus_mask_report", f"""
WITH {TOKENS}, full_chunks AS (SELECT *, 0.001 + 0.999 * {uniform_sql(_KEY, 11)} AS t FROM chunks WHERE len(ids) = {LENGTH}),
hit AS (SELECT pack_group, chunk, t, len(list_filter(range({LENGTH}), lambda i: {uniform_sql(_KEY + " || '/' || i::VARCHAR", 12)} < t)) AS masked FROM full_chunks)
SELECT pack_group, count(*) AS chunks, sum(masked)::BIGINT AS masked, round(sum(masked) / (count(*) * {LENGTH}::DOUBLE), 6) AS share FROM hit GROUP BY pack_group
""")
def corpus_mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the corpus, draws a time per sequence, masks each token with its probability and reports per group."""
    from ..functions.schedules import alpha
    from ..operators import corrupt as C

    rows = P.pack(corpus(spark, sf_dir), LENGTH, "pack_group", "doc_id").withColumn("key", F.concat_ws("/", "pack_group", "chunk"))
    timed = rows.withColumn("t", C.draw_time(F.col("key"), 11, 0.001))
    hit = F.filter(F.sequence(F.lit(0), F.size("input_ids") - 1), lambda i: uniform(F.concat_ws("/", F.col("key"), i.cast("string")), 12) < 1 - alpha("linear")(F.col("t")))
    n = F.size(hit).cast("long")
    out = timed.groupBy("pack_group").agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("masked"))
    return out.withColumn("share", F.round(F.col("masked") / (F.col("chunks") * LENGTH), 6))


@query("prepend_bos", SFT + "SELECT conv_id, array_to_string(list_prepend(1, input_ids), ',') AS input_ids, array_to_string(list_prepend(-100, labels), ',') AS labels, (len(input_ids) + 1)::INT AS ones FROM sft")
def prepend_bos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.prepend_bos(sft_rows(spark, sf_dir), BOS)
    return rows.select("conv_id", text_of("input_ids"), text_of("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("pad_batch", SFT + """SELECT conv_id, array_to_string(list_concat(input_ids, list_resize([]::INT[], w - len(input_ids), 0)), ',') AS input_ids,
  array_to_string(list_concat(labels, list_resize([]::INT[], w - len(labels), -100)), ',') AS labels, w::INT AS width
FROM (SELECT *, max(len(input_ids)) OVER (PARTITION BY conv_id // 8) AS w FROM sft)""")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.pad_batch(sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8)), "batch", PAD)
    return rows.select("conv_id", text_of("input_ids"), text_of("labels"), F.size("attention_mask").alias("width"))


@query("block_eos_pad", SFT + "SELECT conv_id, array_to_string(list_concat(input_ids, list_resize([]::INT[], (32 - len(input_ids) % 32) % 32, 2)), ',') AS input_ids FROM sft")
def block_eos_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_rows(spark, sf_dir).select("conv_id", F.array_join(P.block_pad(F.col("input_ids"), EOS, 32).cast("array<string>"), ",").alias("input_ids"))


@query("random_truncate", SFT + f"""SELECT conv_id, least(len(input_ids), cut)::INT AS kept, array_to_string([CASE WHEN i > cut THEN -100 ELSE labels[i] END FOR i IN range(1, len(labels) + 1)], ',') AS labels, array_to_string(input_ids, ',') AS input_ids FROM (
  SELECT *, CASE WHEN {uniform_sql('conv_id // 8', '5a')} < 0.5 THEN floor({uniform_sql('conv_id // 8', '5b')} * w)::BIGINT + 1 ELSE w END AS cut
  FROM (SELECT *, max(len(input_ids)) OVER (PARTITION BY conv_id // 8) AS w FROM sft))""")
def random_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.random_truncate(sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8)), "batch", 0.5, 5)
    return rows.select("conv_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("kept"), text_of("labels"), text_of("input_ids"))


@query("resp_cutoff", SFT + f"""SELECT conv_id, array_to_string(input_ids[1:n], ',') AS input_ids, array_to_string(labels[1:n], ',') AS labels FROM (SELECT *, len(input_ids) - greatest(len(input_ids) - prompt_len - chosen, 0) AS n FROM (
  SELECT *, first_value(len(input_ids) - prompt_len) OVER (PARTITION BY conv_id // 8 ORDER BY {uniform_sql('conv_id', 3)}) AS chosen FROM sft))""")
def resp_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.cut_responses(sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8)), "batch", "conv_id", 3)
    return rows.select("conv_id", text_of("input_ids"), text_of("labels"))


@query("padded_resp_cutoff", SFT + f"""SELECT conv_id, array_to_string(list_concat(input_ids, list_resize([]::INT[], w - len(input_ids), 0))[1:n], ',') AS input_ids FROM (
  SELECT conv_id, input_ids, w, w - CASE WHEN s > 1 THEN floor({uniform_sql('conv_id // 8', 4)} * (s - 1))::BIGINT + 1 ELSE 0 END AS n FROM (
  SELECT conv_id, input_ids, max(len(input_ids)) OVER b AS w, min(len(input_ids) - prompt_len) OVER b AS s FROM sft WINDOW b AS (PARTITION BY conv_id // 8)))""")
def padded_resp_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sft_rows(spark, sf_dir).withColumns({"batch": F.floor(F.col("conv_id") / 8), "n_ids": F.size("input_ids")})
    return P.cut_padded(P.pad_batch(rows, "batch", PAD), "batch", 4).select("conv_id", text_of("input_ids"))


@query("collated_cutoff", SFT + f"""SELECT conv_id, array_to_string(list_concat(input_ids, list_resize([]::INT[], w - len(input_ids), 0))[1:n], ',') AS input_ids,
  array_to_string(list_concat(labels, list_resize([]::INT[], w - len(labels), -100))[1:n], ',') AS labels, least(len(input_ids), n)::INT AS ones FROM (
  SELECT *, w - CASE WHEN s > 1 AND {uniform_sql('conv_id // 8', '6/hit')} < 0.5 THEN floor({uniform_sql('conv_id // 8', 6)} * (s - 1))::BIGINT + 1 ELSE 0 END AS n FROM (
  SELECT *, max(len(input_ids)) OVER b AS w, min(len(input_ids) - prompt_len) OVER b AS s FROM sft WINDOW b AS (PARTITION BY conv_id // 8)))""")
def collated_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the padded batches are cut."""
    rows = sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8))
    out = rows.transform(P.cutting_collator("batch", "conv_id", PAD, 6, ratio=0.5))
    return out.select("conv_id", text_of("input_ids"), text_of("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("collated_per_batch", SFT + f"""SELECT conv_id, array_to_string(list_resize(input_ids[1:n], w, 0), ',') AS input_ids, array_to_string(list_resize(labels[1:n], w, -100), ',') AS labels, n::INT AS ones FROM (
  SELECT *, max(n) OVER (PARTITION BY conv_id // 8) AS w FROM (SELECT *, len(input_ids) - greatest(len(input_ids) - prompt_len - chosen, 0) AS n FROM (
  SELECT *, first_value(len(input_ids) - prompt_len) OVER (PARTITION BY conv_id // 8 ORDER BY {uniform_sql('conv_id', 6)}) AS chosen FROM sft)))""")
def collated_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are cut before padding."""
    rows = sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8))
    out = rows.transform(P.cutting_collator("batch", "conv_id", PAD, 6, per_batch=True))
    return out.select("conv_id", text_of("input_ids"), text_of("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("edit_pairs", SFT + "SELECT conv_id, array_to_string(list_concat(input_ids[1:prompt_len], list_resize([]::INT[], 4, 3)), ',') AS x0, array_to_string(input_ids, ',') AS x1 FROM sft")
def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, x1 = P.edit_pairs(F.col("input_ids"), F.col("prompt_len"), P.start_sampler("masks[length:4]", MASK), BOS)
    return sft_rows(spark, sf_dir).select("conv_id", F.array_join(x0.cast("array<string>"), ",").alias("x0"), F.array_join(x1.cast("array<string>"), ",").alias("x1"))


@query("ensure_bos", SFT + "SELECT conv_id, CASE WHEN input_ids[1] = 1 THEN len(input_ids) ELSE len(input_ids) + 1 END::INT AS n FROM sft")
def ensure_bos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_rows(spark, sf_dir).select("conv_id", F.size(P.ensure_bos(F.col("input_ids"), BOS)).alias("n"))


_STOP = "list_position([x % 97 = 0 FOR x IN body], true)"


@query("sample_trim", SFT + f"""SELECT conv_id, array_to_string(CASE WHEN {_STOP} > 0 THEN body[1:{_STOP} - 1] ELSE body END, ',') AS generated
FROM (SELECT conv_id, input_ids[prompt_len + 1:] AS body FROM sft)""")
def sample_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left pads off, the prompt cut, up to the first stop; ids that 97 divides stand for stops."""
    rows = sft_rows(spark, sf_dir)
    marked = F.concat(P.filled(PAD, 3), F.transform("input_ids", lambda x, i: F.when((x % 97 == 0) & (i >= F.col("prompt_len")), EOS).otherwise(x)))
    out = P.trim_sample(marked, F.slice("input_ids", F.lit(1), F.col("prompt_len")), PAD, [EOS])
    return rows.select("conv_id", F.array_join(out.cast("array<string>"), ",").alias("generated"))


@query("infill_trim", SFT + f"""SELECT conv_id, array_to_string(CASE WHEN {_STOP} > 0 THEN body[1:{_STOP} - 1] ELSE body END, ',') AS generated
FROM (SELECT conv_id, [input_ids[i] FOR i IN range(1, len(input_ids) + 1) IF i % 3 = 0] AS body FROM sft)""")
def infill_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third place of the prompt is a mask."""
    rows = sft_rows(spark, sf_dir)
    prompt = F.transform("input_ids", lambda x, i: F.when((i + 1) % 3 == 0, MASK).otherwise(x))
    output = F.transform("input_ids", lambda x: F.when(x % 97 == 0, EOS).otherwise(x))
    out = P.trim_infill(output, prompt, MASK, PAD, [EOS])
    return rows.select("conv_id", F.array_join(out.cast("array<string>"), ",").alias("generated"))


@query("decode_words", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: length(w) < 4), ' ') AS text FROM documents")
def decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words come back from their ids by a vocabulary of short words; ids that it lacks are left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    vocabulary = docs.select(F.explode("w").alias("word")).where(F.length("word") < 4).distinct().select(F.xxhash64("word").alias("id"), "word")
    return X.decode(docs.select("doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("ids")), "doc_id", "ids", vocabulary)


@query("saved_sft", SFT + "SELECT CASE WHEN conv_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, prompt_len::INT AS prompt_len, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM sft")
def saved_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped rows are saved by split and loaded again as preprocessed data."""
    from ..sources import datasets as D
    from ..storage import shared_folder

    path = f"{shared_folder(spark, 'sink')}/sft"
    D.write_sft(sft_rows(spark, sf_dir).withColumn("split", F.when(F.col("conv_id") % 4 == 0, "test").otherwise("train")), path)
    return D.load(spark, path, {}, preprocessed=True).select("split", F.col("prompt_len").cast("int").alias("prompt_len"), text_of("input_ids"), text_of("labels"))


@query("saved_pt", f"WITH {TOKENS} SELECT 'train' AS split, 'max_length-{LENGTH}-insert_eos-True-drop_tail-True' AS folder, md5(array_to_string(ids, ',')) AS ids, true AS same FROM chunks WHERE len(ids) = {LENGTH}")
def saved_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed chunks are saved below a folder that tells the options."""
    from ..sources import datasets as D
    from ..storage import shared_folder

    rows = P.pack(corpus(spark, sf_dir), LENGTH, "pack_group", "doc_id").withColumn("split", F.lit("train"))
    path = D.write_pt(rows, shared_folder(spark, "sink"), LENGTH, True, True)
    back = D.load(spark, path, {}, preprocessed=True)
    ids = F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ","))
    return back.select("split", F.lit(path.rpartition("/")[2]).alias("folder"), ids.alias("ids"), (F.col("labels") == F.col("input_ids")).alias("same"))


@query("map_by_path", SFT + "SELECT array_to_string(list_prepend(1, input_ids), ',') AS input_ids, array_to_string(list_prepend(-100, labels), ',') AS labels FROM sft")
def map_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map named by its dotted path, with an option bound."""
    from ..sources import datasets as D

    return sft_rows(spark, sf_dir).transform(D.use("seqloom.operators.pack.prepend_bos", bos=BOS)).select(text_of("input_ids"), text_of("labels"))


@query("json_map", "SELECT vec_id::INT AS tok, label::INT AS cluster FROM embeddings")
def json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary's clusters from JSON objects of 64 entries, one a line."""
    from ..sources import datasets as D
    from ..storage import shared_folder

    path = f"{shared_folder(spark, 'map')}/clusters"
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("vec_id").cast("string"), "label")))
    table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64)).agg(F.to_json(pairs).alias("value")).select("value").write.text(path)
    return D.cluster_map(spark, path, lines=True)


@query("collated_without_mask", SFT + """SELECT conv_id, array_to_string(list_resize(list_prepend(1, input_ids), w + 1, 0), ',') AS input_ids, array_to_string(list_resize(list_prepend(-100, labels), w + 1, -100), ',') AS labels, false AS has_mask
FROM (SELECT *, max(len(input_ids)) OVER (PARTITION BY conv_id // 8) AS w FROM sft)""")
def collated_without_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collator of three steps: a first token, padding, and away with the mask."""
    rows = sft_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8))
    out = P.collate(lambda df: P.prepend_bos(df, BOS), lambda df: P.pad_batch(df, "batch", PAD), P.drop_mask)(rows)
    return out.select("conv_id", text_of("input_ids"), text_of("labels"), F.lit("attention_mask" in out.columns).alias("has_mask"))


@query("edit_pairs_empty", SFT + "SELECT conv_id, '1' AS x0, array_to_string(CASE WHEN input_ids[1] = 1 THEN input_ids ELSE list_prepend(1, input_ids) END, ',') AS x1 FROM sft")
def edit_pairs_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a prompt and from nothing: the first token alone becomes the whole text."""
    x0, x1 = P.edit_pairs(F.col("input_ids"), None, P.start_sampler("empty"), BOS)
    return sft_rows(spark, sf_dir).select("conv_id", F.array_join(x0.cast("array<string>"), ",").alias("x0"), F.array_join(x1.cast("array<string>"), ",").alias("x1"))
