"""Queries over one decoding step; each embedding is a position's logits (x 20) over 64 tokens, 16 positions a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import decode as L
from .corruption import _LOGITS, logits
from .registry import query, table

_P = f"""l AS {_LOGITS}, p AS (SELECT seq, pos, tok, logit, e / sum(e) OVER (PARTITION BY seq, pos) AS p
  FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq, pos)) AS e FROM l))"""
_BEST = f"""{_P}, best AS (SELECT seq, pos, arg_max(tok, (logit, -tok)) AS tok, max(p) AS conf FROM p GROUP BY ALL)"""
_MASKED = "(pos % 3 <> 0)"


@query("softmax_conf", f"WITH {_BEST} SELECT seq, pos, tok, round(conf, 6) AS conf FROM best")
def softmax_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confidence(logits(spark, sf_dir)).withColumn("conf", F.round("conf", 6))


@query("entropy_conf", f"WITH {_P} SELECT seq, pos, round(sum(p * ln(p + 1e-8)), 6) AS entropy, round(sum(p * ln(p + 1e-10)), 6) AS neg_entropy FROM p GROUP BY ALL")
def entropy_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    one, two = (L.confidence(rows, k).select("seq", "pos", F.round("conf", 6).alias(k)) for k in ("entropy", "neg_entropy"))
    return one.join(two, ["seq", "pos"])


@query("margin_conf", f"""WITH {_P} SELECT seq, pos, round(max(p) FILTER (r = 1) - max(p) FILTER (r = 2), 6) AS conf, max(tok) FILTER (r = 1) AS tok
FROM (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY logit DESC, tok) AS r FROM p) GROUP BY ALL""")
def margin_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confidence(logits(spark, sf_dir), "margin").withColumn("conf", F.round("conf", 6))


@query("random_conf", f"WITH {_BEST} SELECT seq, pos, tok, round({uniform_sql('(seq::VARCHAR || chr(47) || pos::VARCHAR)', 9)}, 9) AS conf FROM best")
def random_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confidence(logits(spark, sf_dir), "random", seed=9).withColumn("conf", F.round("conf", 9))


_TOP_P = "SELECT seq, pos, tok, logit, coalesce(sum(p) OVER (PARTITION BY seq, pos ORDER BY logit DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "


@query("top_p", f"WITH {_P} SELECT seq, pos, count(*) AS kept, round(min(logit), 6) AS least FROM ({_TOP_P} p) WHERE before <= 0.9 GROUP BY ALL")
def top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.top_p(logits(spark, sf_dir), 0.9).where(F.col("logit") > L.NEG)
    return rows.groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("kept"), F.round(F.min("logit"), 6).alias("least"))


@query("top_k", f"WITH {_P} SELECT seq, pos, count(*) AS kept, round(min(logit), 6) AS least FROM (SELECT *, rank() OVER (PARTITION BY seq, pos ORDER BY logit DESC) AS r FROM p) WHERE r <= 5 GROUP BY ALL")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.top_k(logits(spark, sf_dir), 5).where(F.col("logit") > L.NEG)
    return rows.groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("kept"), F.round(F.min("logit"), 6).alias("least"))


_SOFT = "SELECT seq, pos, tok, logit, e / sum(e) OVER (PARTITION BY seq, pos) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY seq, pos)) AS e FROM {0})"


def _draw_sql(first: str, second: str, seed: int) -> str:
    u = uniform_sql("(seq::VARCHAR || chr(47) || pos::VARCHAR)", seed)
    return f"""WITH l0 AS {_LOGITS}, l AS (SELECT seq, pos, tok, logit / 5 AS logit FROM l0), {first}, {second}, s AS ({_SOFT.replace('{0}', 'b')}),
c AS (SELECT *, sum(p) OVER (PARTITION BY seq, pos ORDER BY tok) AS run, max(tok) OVER (PARTITION BY seq, pos) AS last FROM s)
SELECT seq, pos, min(tok) AS tok, round(arg_min(p, tok), 6) AS p FROM c WHERE run >= {u} OR tok = last GROUP BY ALL"""


def _p_sql(name: str, source: str) -> str:
    return f"{name}_s AS ({_SOFT.replace('{0}', source)}), {name} AS (SELECT seq, pos, tok, logit FROM ({_TOP_P} {name}_s) WHERE before <= 0.8)"


def _k_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT seq, pos, tok, logit FROM (SELECT *, rank() OVER (PARTITION BY seq, pos ORDER BY logit DESC) AS r FROM {source}) WHERE r <= 20)"


@query("sample_p_then_k", _draw_sql(_p_sql("a", "l"), _k_sql("b", "a"), 3))
def sample_p_then_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample(logits(spark, sf_dir), 5.0, 0.8, 20, "p_then_k", 3).withColumn("p", F.round("p", 6))


@query("sample_k_then_p", _draw_sql(_k_sql("a", "l"), _p_sql("b", "a"), 4))
def sample_k_then_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample(logits(spark, sf_dir), 5.0, 0.8, 20, "k_then_p", 4).withColumn("p", F.round("p", 6))


@query("gumbel_argmax", f"""WITH l AS {_LOGITS} SELECT seq, pos, arg_max(tok, (exp(logit) / power(-ln({uniform_sql("(seq::VARCHAR || chr(47) || pos::VARCHAR || chr(47) || tok::VARCHAR)", 5)}), 0.7), -tok)) AS tok FROM l GROUP BY ALL""")
def gumbel_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.argmax(L.gumbel(logits(spark, sf_dir), 0.7, 5))


@query("suppress_tokens", f"WITH l AS {_LOGITS} SELECT seq, pos, arg_max(tok, (logit, -tok)) AS tok FROM l WHERE tok NOT IN (3, 17, 40) GROUP BY ALL")
def suppress_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.argmax(L.suppress(logits(spark, sf_dir), [3, 17, 40]))


@query("begin_suppress", f"""WITH l AS {_LOGITS}, b AS (SELECT seq, pos, arg_max(tok, (logit, -tok)) AS tok FROM l GROUP BY ALL),
k AS (SELECT * FROM l WHERE tok >= 32), p AS ({_SOFT.replace('{0}', 'k')})
SELECT b.seq, b.pos, b.tok, round(coalesce(p, 0), 6) AS conf FROM b LEFT JOIN p USING (seq, pos, tok)""")
def begin_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suppressed_confidence(logits(spark, sf_dir), [*range(32)]).withColumn("conf", F.round("conf", 6))


@query("cfg_mix", f"WITH l AS {_LOGITS} SELECT a.seq, a.pos, a.tok, round(b.logit + 2.5 * (a.logit - b.logit), 6) AS logit FROM l a JOIN l b ON a.seq = b.seq AND a.tok = b.tok AND b.pos = (a.pos + 1) % 16")
def cfg_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    other = rows.withColumn("pos", ((F.col("pos") + 15) % 16).cast("int"))
    return L.guided(rows, other, 1.5).withColumn("logit", F.round("logit", 6))


@query("right_shift", f"WITH l AS {_LOGITS} SELECT seq, pos, tok, round(coalesce(lag(logit) OVER (PARTITION BY seq, tok ORDER BY pos), logit), 6) AS logit FROM l")
def right_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shift_right(logits(spark, sf_dir)).withColumn("logit", F.round("logit", 6))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confidence(logits(spark, sf_dir)).withColumn("masked", F.col("pos") % 3 != 0)


_RANKED = f"""{_BEST}, r AS (SELECT *, {_MASKED} AS masked, row_number() OVER (PARTITION BY seq ORDER BY {_MASKED} DESC, conf DESC, pos) AS r,
  count(*) FILTER ({_MASKED}) OVER (PARTITION BY seq) AS n FROM best)"""


def _commit(name: str, make, rule: str) -> None:
    @query(name, f"WITH {_RANKED} SELECT seq, pos, {rule} AS commit FROM r")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(proposals(spark, sf_dir)).select("seq", "pos", "commit")


_COUNT = "count(*) FILTER (masked AND {0}) OVER (PARTITION BY seq)"
_commit("commit_quota", lambda c: L.commit_quota(c, 3), "masked AND r <= 3")
_commit("commit_threshold", lambda c: L.commit_threshold(c, 0.35), f"masked AND (conf >= 0.35 OR (r = 1 AND {_COUNT.format('conf >= 0.35')} = 0))")
_commit("commit_factor", lambda c: L.commit_factor(c, 1.2), f"masked AND r <= {_COUNT.format('(r = 1 OR conf >= 1 - 1.2 / (r + 1))')}")
_commit("commit_hybrid", lambda c: L.commit_hybrid(c, 0.3, 2), f"masked AND CASE WHEN {_COUNT.format('conf > 0.3')} >= 2 THEN conf > 0.3 ELSE r <= 2 END")
_commit("commit_carry", lambda c: L.commit_carry(c, 0.3, 4), "masked AND r <= greatest(n - 4, 0) AND (r = 1 OR conf >= 0.3)")
_commit("commit_random", lambda c: L.commit_random(c, 0.5, 0.75, 6), f"masked AND {uniform_sql('(seq::VARCHAR || chr(47) || pos::VARCHAR)', 6)} < 1 - 0.5 / 0.75::DOUBLE")
_commit("block_restriction", lambda c: L.commit_quota(L.in_block(c, 8).withColumn("masked", F.col("masked") & (F.col("pos") < 8)), 3), "coalesce(masked AND pos < 8 AND r8 <= 3, false)".replace("r8", "(SELECT count(*) + 1 FROM r s WHERE s.seq = r.seq AND s.masked AND s.pos < 8 AND (s.conf > r.conf OR (s.conf = r.conf AND s.pos < r.pos)))"))


@query("commit_soft", f"""WITH {_BEST} SELECT seq, pos, {_MASKED} AND row_number() OVER (PARTITION BY seq ORDER BY {_MASKED} DESC, conf / 0.1 - ln(-ln({uniform_sql('(seq::VARCHAR || chr(47) || pos::VARCHAR)', 8)})) DESC, pos) <= 3 AS commit FROM best""")
def commit_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.commit_soft(proposals(spark, sf_dir), 3, 0.1, 8).select("seq", "pos", "commit")


@query("write_canvas", f"WITH {_RANKED} SELECT seq, pos, CASE WHEN masked AND r <= 3 THEN tok WHEN masked THEN 99 ELSE pos END::INT AS tok FROM r")
def write_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proposals(spark, sf_dir)
    canvas = rows.select("seq", "pos", F.when(F.col("masked"), 99).otherwise(F.col("pos")).alias("tok"))
    return L.write(canvas, L.commit_quota(rows, 3)).select("seq", "pos", "tok")


@query("semantic_clusters", f"""WITH {_P}, c AS (SELECT seq, pos, (tok % 8)::INT AS cluster, sum(p) + 1e-14 AS p FROM p GROUP BY ALL)
SELECT seq, pos, arg_max(cluster, (p, -cluster)) AS label, round(max(p), 6) AS prob, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM c GROUP BY seq, pos""")
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.range(64).select(F.col("id").cast("int").alias("tok"), (F.col("id") % 8).cast("int").alias("cluster"))
    return L.clusters(logits(spark, sf_dir), mapping).withColumns({"prob": F.round("prob", 6), "entropy": F.round("entropy", 6)})


@query("semantic_dispersion", f"""WITH {_P}, v AS (SELECT vec_id::INT AS tok, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x
  FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id < 64)),
m AS (SELECT seq, pos, d, sum(p * x) AS m FROM p JOIN v USING (tok) GROUP BY ALL)
SELECT seq, pos, round(greatest(0, 1 - sum(m * m)), 6) AS dispersion FROM m GROUP BY ALL""")
def semantic_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 vectors are the embedding matrix of the 64-token vocabulary."""
    vectors = table(spark, sf_dir, "embeddings").where("vec_id < 64").select(F.col("vec_id").cast("int").alias("tok"), F.col("embedding").alias("e"))
    return L.dispersion(logits(spark, sf_dir), vectors).withColumn("dispersion", F.round("dispersion", 6))


_H = f"""{_BEST}, canvas AS (SELECT seq, pos, CASE WHEN pos % 4 = 0 THEN 63 ELSE pos END AS tok, pos % 4 = 0 AS masked FROM best),
h AS (SELECT b.seq, b.pos, c.masked, CASE WHEN c.masked THEN 0 ELSE b.conf - p.p END AS h FROM best b JOIN canvas c USING (seq, pos) JOIN p ON p.seq = c.seq AND p.pos = c.pos AND p.tok = c.tok)"""


def h_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    canvas = rows.select("seq", "pos").distinct().select("seq", "pos", F.when(F.col("pos") % 4 == 0, 63).otherwise(F.col("pos")).alias("tok"))
    return L.h_statistic(rows, canvas, 63)


@query("h_statistic", f"WITH {_H} SELECT seq, pos, round(h, 6) AS h FROM h")
def h_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h_rows(spark, sf_dir).withColumn("h", F.round("h", 6))


@query("bernoulli_remask", f"WITH {_H} SELECT seq, pos, NOT masked AND h > 0 AND pos >= 2 AND pos < 14 AND {uniform_sql('(seq::VARCHAR || chr(47) || pos::VARCHAR)', 13)} < least(h, 1) AS remask FROM h")
def bernoulli_remask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = h_rows(spark, sf_dir).withColumn("masked", F.col("pos") % 4 == 0)
    return L.remask(rows, 2, 14, False, 13).select("seq", "pos", "remask")


@query("spread_quota", """WITH q AS (SELECT doc_id, (n_chars % 9)::BIGINT AS extra, [3, n_chars % 5, n_chars % 7, 2, n_chars % 3] AS q FROM documents),
f AS (SELECT doc_id, extra, i, q[i] AS x, row_number() OVER (PARTITION BY doc_id, i > 1 ORDER BY q[i], i) AS r FROM (SELECT *, unnest(range(1, 6)) AS i FROM q))
SELECT doc_id, string_agg((CASE WHEN i = 1 THEN x ELSE x + extra // 4 + CASE WHEN r <= extra % 4 THEN 1 ELSE 0 END END)::VARCHAR, ',' ORDER BY i) AS quota FROM f GROUP BY doc_id""")
def spread_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    quota = F.array(F.lit(3).cast("long"), n % 5, n % 7, F.lit(2).cast("long"), n % 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(L.spread_quota(quota, n % 9, 1).cast("array<string>"), ",").alias("quota"))


@query("masks_left", f"WITH {_BEST} SELECT pos AS step, count(*) FILTER (tok % 5 = 0) AS masks FROM best GROUP BY pos")
def masks_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.argmax(logits(spark, sf_dir)).select(F.col("pos").alias("step"), F.when(F.col("tok") % 5 == 0, -1).otherwise(F.col("tok")).alias("tok"))
    return L.masks_left(rows, -1)


_CANVAS = "(SELECT vec_id // 16 AS seq, (vec_id % 16)::INT AS pos, label AS tok, vec_id % 16 >= 3 AS is_valid FROM embeddings)"


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).cast("int").alias("pos"), F.col("label").alias("tok"), (F.col("vec_id") % 16 >= 3).alias("is_valid"))


@query("given_tokens", f"SELECT seq, pos, tok <> 5 AND is_valid AND tok NOT IN (1, 2) AS given FROM {_CANVAS}")
def given_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.given(canvas(spark, sf_dir), 5, [1, 2]).select("seq", "pos", "given")


@query("position_ids", f"SELECT seq, pos, CASE WHEN is_valid THEN sum(is_valid::INT) OVER (PARTITION BY seq ORDER BY pos) - 1 ELSE 1 END::BIGINT AS position_id FROM {_CANVAS}")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.position_ids(canvas(spark, sf_dir), 1).select("seq", "pos", "position_id")


@query("block_causal_mask", f"""SELECT a.seq, a.pos AS q, b.pos AS k, b.pos // 4 <= a.pos // 4 AND a.is_valid AND b.is_valid AS padded, b.pos // 4 <= a.pos // 4 AS triangular
FROM {_CANVAS} a JOIN {_CANVAS} b ON a.seq = b.seq""")
def block_causal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = canvas(spark, sf_dir).select("seq", F.col("pos").alias("q"), F.col("is_valid").alias("qv"))
    k = canvas(spark, sf_dir).select("seq", F.col("pos").alias("k"), F.col("is_valid").alias("kv"))
    a, b = F.col("q"), F.col("k")
    return q.join(k, "seq").select("seq", "q", "k", L.block_causal(a, b, F.col("qv"), F.col("kv"), 4).alias("padded"), L.block_triangular(a, b, 4).alias("triangular"))


@query("canvas_layouts", """SELECT doc_id, array_to_string(list_concat(list_resize([]::INT[], n, 7), [3, 3, 3, 3], list_resize([]::INT[], 6 - n, 2)), ',') AS right_padded,
  array_to_string(list_concat(list_resize([]::INT[], 6 - n, 2), list_resize([]::INT[], n, 7), [3, 3, 3, 3]), ',') AS left_padded,
  array_to_string(list_concat(list_resize([]::INT[], 8 - n, 2), list_resize([]::INT[], n, 7), [3, 3, 3, 3]), ',') AS block_padded
FROM (SELECT doc_id, n_chars % 7 AS n FROM documents)""")
def canvas_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_repeat(F.lit(7), (F.col("n_chars") % 7).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    make = lambda width, kind: F.array_join(L.canvas_row(F.col("ids"), 4, 3, 2, F.lit(width), kind, 4).cast("array<string>"), ",")
    return rows.select("doc_id", make(10, "right").alias("right_padded"), make(10, "left").alias("left_padded"), make(6, "block").alias("block_padded"))
