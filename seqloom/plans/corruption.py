"""Queries over masking, loss weights and losses; embeddings stand for logits over a 64-token vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..functions.schedules import alpha, kappa
from ..operators import corrupt as C
from ..operators.decode import argmax
from .chat import SFT, sft_rows, text_of
from .registry import query, table

MASK = 3
_T = f"(0.001 + 0.999 * {uniform_sql('conv_id', 21)})"
_FLAGS = f"[labels[i + 1] <> -100 AND {uniform_sql('(conv_id::VARCHAR || chr(47) || i::VARCHAR)', 22)} < t FOR i IN range(len(labels))]"
NOISED = SFT + f", timed AS (SELECT *, {_T} AS t FROM sft), noised AS (SELECT *, {_FLAGS} AS masked FROM timed) "


def noised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sft_rows(spark, sf_dir).withColumn("t", C.draw_time(F.col("conv_id"), 21))
    return C.mask_tokens(rows, "conv_id", 1 - alpha("linear")(F.col("t")), MASK, 22)


@query("mask_tokens", NOISED + "SELECT conv_id, round(t, 9) AS t, array_to_string([CASE WHEN masked[i] THEN 3 ELSE input_ids[i] END FOR i IN range(1, len(masked) + 1)], ',') AS noised FROM noised")
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noised_rows(spark, sf_dir).select("conv_id", F.round("t", 9).alias("t"), text_of("noised"))


@query("loss_weights", NOISED + "SELECT conv_id, round(1 / (t + 1e-6), 6) AS scheduler, 1.0::DOUBLE AS uniform FROM noised")
def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return noised_rows(spark, sf_dir).select("conv_id", F.round(C.loss_weight("scheduler", t, alpha("linear")), 6).alias("scheduler"), C.loss_weight("uniform", t).alias("uniform"))


@query("cart_weights", NOISED + """, flat AS (SELECT conv_id, unnest(masked) AS m, generate_subscripts(masked, 1) AS i FROM noised)
SELECT a.conv_id, a.i::INT AS place, round(coalesce(sum(0.5 * 0.3 * power(0.7, abs(a.i - b.i) - 1)), 0), 6) AS weight
FROM flat a LEFT JOIN flat b ON a.conv_id = b.conv_id AND a.i <> b.i AND NOT b.m WHERE a.m GROUP BY ALL""")
def cart_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noised_rows(spark, sf_dir).select("conv_id", "masked", F.posexplode(C.context_weights(F.col("masked"), C.geometric_p("cart"))).alias("p", "w"))
    return rows.where(F.get("masked", F.col("p"))).select("conv_id", (F.col("p") + 1).alias("place"), F.round("w", 6).alias("weight"))


_LOGITS = "(SELECT vec_id // 16 AS seq, (vec_id % 16)::INT AS pos, unnest(range(64))::INT AS tok, unnest(embedding)::DOUBLE * 20 AS logit FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).cast("int").alias("pos"), F.posexplode("embedding").alias("tok", "x")).select("seq", "pos", "tok", (F.col("x").cast("double") * 20).alias("logit"))


_CE = f"""WITH l AS {_LOGITS}, n AS (SELECT seq, pos, max(logit) AS top FROM l GROUP BY ALL),
z AS (SELECT l.seq, l.pos, any_value(top) + ln(sum(exp(logit - top))) AS norm FROM l JOIN n USING (seq, pos) GROUP BY ALL),
ce AS (SELECT l.seq, l.pos, norm - logit AS ce FROM l JOIN z USING (seq, pos) WHERE tok = pos * 3)"""


def ce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    return C.cross_entropy(rows, rows.where(F.col("tok") == F.col("pos") * 3).select("seq", "pos", "tok"))


@query("cross_entropy", _CE + " SELECT seq, pos, round(ce, 6) AS ce FROM ce")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ce_rows(spark, sf_dir).select("seq", "pos", F.round("ce", 6).alias("ce"))


@query("loss_norms", _CE + """, s AS (SELECT seq // 4 AS batch, seq, sum(CASE WHEN pos % 2 = 0 THEN ce * (1 + pos) ELSE 0 END) AS v, count(*) FILTER (pos < 12) AS n FROM ce GROUP BY ALL)
SELECT batch, round(sum(v) / greatest(sum(n), 1), 6) AS token, round(avg(v / greatest(n, 1)), 6) AS sequence, round(sum(v) / count(*), 6) AS batch_loss FROM s GROUP BY batch""")
def loss_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ce_rows(spark, sf_dir).select(F.floor(F.col("seq") / 4).alias("batch"), "seq", "ce", (1.0 + F.col("pos")).alias("weight"), (F.col("pos") % 2 == 0).alias("masked"), (F.col("pos") < 12).alias("counts"))
    kinds = {k: C.loss_norms(rows, k, ["batch"]).select("batch", F.round("loss", 6).alias(n)) for k, n in (("token", "token"), ("sequence", "sequence"), ("batch", "batch_loss"))}
    return kinds["token"].join(kinds["sequence"], "batch").join(kinds["batch"], "batch")


@query("eval_step", _CE + """, r AS (SELECT seq, pos, ce * (1 + pos) * (pos % 2 = 0)::INT AS v, pos < 12 AS counts FROM ce), b AS (SELECT seq // 4 AS batch, sum(v) / greatest(count(*) FILTER (counts), 1) AS loss FROM r GROUP BY ALL)
SELECT l.seq, l.pos, l.pos * 3 AS label, arg_max(l.tok, (l.logit, -l.tok)) AS best, round(any_value(loss), 6) AS loss FROM l JOIN b ON b.batch = l.seq // 4 GROUP BY l.seq, l.pos""")
def eval_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's loss beside each place's label and best token."""
    rows = logits(spark, sf_dir)
    batch = F.floor(F.col("seq") / 4).alias("batch")
    wanted = rows.where(F.col("tok") == F.col("pos") * 3).select(batch, "seq", "pos", "tok", (1.0 + F.col("pos")).alias("weight"), (F.col("pos") % 2 == 0).alias("masked"), (F.col("pos") < 12).alias("counts"))
    loss, seen, labels = C.eval_step(wanted, rows, "token", ["batch"])
    best = argmax(seen).withColumnRenamed("tok", "best")
    return labels.withColumnRenamed("tok", "label").join(best, ["seq", "pos"]).withColumn("batch", batch).join(loss, "batch").select("seq", "pos", "label", "best", F.round("loss", 6).alias("loss"))


@query("label_mismatches", SFT + "SELECT conv_id FROM sft WHERE conv_id % 7 = 0")
def label_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of every seventh row is made wrong."""
    wrong = F.transform("labels", lambda x, i: F.when((F.col("conv_id") % 7 == 0) & (i == F.size("labels") - 1), x + 1).otherwise(x))
    return C.label_mismatches(sft_rows(spark, sf_dir).withColumn("labels", wrong)).select("conv_id")


@query("bos_if_needed", SFT + """SELECT conv_id, array_to_string(CASE WHEN bool_and(conv_id % 16 <> 3) OVER (PARTITION BY conv_id // 8) THEN input_ids ELSE list_prepend(1, input_ids) END, ',') AS input_ids FROM sft""")
def bos_if_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second batch has a row that does not begin with an ignored label."""
    labels = F.when(F.col("conv_id") % 16 == 3, F.col("input_ids")).otherwise(F.col("labels"))
    rows = sft_rows(spark, sf_dir).withColumns({"batch": F.floor(F.col("conv_id") / 8), "labels": labels})
    return C.bos_if_needed(rows, "batch", 1).select("conv_id", text_of("input_ids"))


@query("doubled_rows", NOISED + """SELECT conv_id, array_to_string(list_concat([CASE WHEN masked[i] THEN 3 ELSE input_ids[i] END FOR i IN range(1, len(masked) + 1)], input_ids), ',') AS pair_ids,
  array_to_string(list_concat(range(len(input_ids)), range(len(input_ids))), ',') AS positions FROM noised""")
def doubled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.doubled(noised_rows(spark, sf_dir)).select("conv_id", text_of("pair_ids"), text_of("positions"))


@query("block_attention_mask", """
WITH n AS (SELECT doc_id, 4 + n_chars % 13 AS n FROM documents), q AS (SELECT doc_id, n, unnest(range(2 * n)) AS q FROM n), p AS (SELECT doc_id, n, q, unnest(range(2 * n)) AS k FROM q),
m AS (SELECT doc_id, q, k, q >= n AS cq, k >= n AS ck, (q % n) // 4 AS bq, (k % n) // 4 AS bk FROM p)
SELECT doc_id, count(*) AS pairs, sum(q * 64 + k)::BIGINT AS places FROM m WHERE (bq = bk AND cq = ck) OR (bq > bk AND ck AND NOT cq) OR (bq >= bk AND ck AND cq) GROUP BY doc_id
""")
def block_attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of places attend, for doubled rows of 4 to 16 places; blocks of 4, the last one shorter."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), 2 * n - 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", (4 + F.col("n_chars") % 13).alias("n")).withColumn("q", upto(F.col("n"))).withColumn("k", upto(F.col("n")))
    hit = rows.where(C.block_mask(F.col("q"), F.col("k"), 4, F.col("n")))
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("q") * 64 + F.col("k")).alias("places"))


@query("edit_flow_time", SFT + f"SELECT conv_id, round(t, 9) AS t, round(least(1 / (1 - t + 1e-6), 20), 6) AS weight FROM (SELECT conv_id, 0.999 * {uniform_sql('conv_id', 31)} AS t FROM sft)")
def edit_flow_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sft_rows(spark, sf_dir).select("conv_id", C.edit_time(F.col("conv_id"), 31).alias("t"))
    return rows.select("conv_id", F.round("t", 9).alias("t"), F.round(C.clamped_weight(kappa("linear"), F.col("t")), 6).alias("weight"))


@query("kappa_mixing", SFT + f"SELECT conv_id, array_to_string([CASE WHEN {uniform_sql('(conv_id::VARCHAR || chr(47) || i::VARCHAR)', 32)} < 0.4 THEN input_ids[i + 1] ELSE labels[i + 1] END FOR i IN range(len(input_ids))], ',') AS zt FROM sft")
def kappa_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    zt = C.mix(F.col("labels"), F.col("input_ids"), kappa("linear")(0.4), F.col("conv_id"), 32)
    return sft_rows(spark, sf_dir).select("conv_id", F.array_join(zt.cast("array<string>"), ",").alias("zt"))
