"""Queries over alignments and edit scripts: neighbouring benchmark texts, a character a token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..functions.schedules import kappa
from ..operators import align as E
from ..operators import corrupt as C
from ..operators.decode import argmax
from .corruption import _LOGITS, logits
from .registry import query, table

_TEXT = "regexp_replace({0}.text, '[^ -~]', '?', 'g')"
_PAIRS = f"""(SELECT a.item_id, {_TEXT.format('a')} AS a, {_TEXT.format('b')} AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, x0, x1): characters of each item's text and the next one's."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split(F.regexp_replace("text", "[^ -~]", "?"), ""), lambda c: F.ascii(c)).alias("x"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("x1"))
    return rows.withColumnRenamed("x", "x0").join(nxt, "item_id")


@query("align_cost", f"SELECT item_id, levenshtein(a, b)::BIGINT AS cost FROM {_PAIRS}")
def align_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.align(pairs(spark, sf_dir), "item_id").select("item_id", "cost")


@query("align_blanks")
def align_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.align(pairs(spark, sf_dir), "item_id")


@query("strip_blanks", f"SELECT item_id, a AS one, b AS two FROM {_PAIRS}")
def strip_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the alignment's blanks were put into comes back."""
    text = lambda z: F.array_join(F.transform(E.strip_blanks(F.col(z)), lambda x: F.char(x)), "")
    return E.align(pairs(spark, sf_dir), "item_id").select("item_id", text("z0").alias("one"), text("z1").alias("two"))


_Z = """z AS (SELECT vec_id, [CASE WHEN i % 5 = 2 THEN -1 ELSE (vec_id + i) % 9 END FOR i IN range(12)] AS zt, [CASE WHEN i % 4 = 1 THEN -1 ELSE (vec_id + i * i) % 9 END FOR i IN range(12)] AS z1 FROM embeddings)"""


@query("remaining_edits", f"""WITH {_Z}, f AS (SELECT vec_id, i, zt[i] AS a, z1[i] AS b, len(list_filter(zt[1:i - 1], lambda x: x <> -1)) AS n FROM (SELECT *, unnest(range(1, 13)) AS i FROM z))
SELECT vec_id, string_agg(CASE WHEN a = -1 THEN 'INS:' || greatest(n - 1, 0) || ':' || b WHEN b = -1 THEN 'DEL:' || n || ':' ELSE 'SUB:' || n || ':' || b END, ' ' ORDER BY i) AS edits
FROM f WHERE a <> b GROUP BY vec_id""")
def remaining_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, v = F.sequence(F.lit(0), F.lit(11)), F.col("vec_id")
    zt = F.transform(places, lambda i: F.when(i % 5 == 2, -1).otherwise(((v + i) % 9).cast("int")))
    z1 = F.transform(places, lambda i: F.when(i % 4 == 1, -1).otherwise(((v + i * i) % 9).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", E.remaining_edits(zt, z1).alias("e"))
    text = F.transform("e", lambda e: F.concat(e["kind"], F.lit(":"), e["pos"].cast("string"), F.lit(":"), F.coalesce(e["token"].cast("string"), F.lit(""))))
    return rows.where(F.size("e") > 0).select("vec_id", F.array_join(text, " ").alias("edits"))


@query("edit_range", f"""WITH {_Z}, f AS (SELECT vec_id, zt[i] AS a, z1[i] AS b, len(list_filter(zt[1:i - 1], lambda x: x <> -1)) AS n FROM (SELECT *, unnest(range(1, 13)) AS i FROM z))
SELECT vec_id, count(*) FILTER (a <> b AND CASE WHEN a = -1 THEN greatest(n - 1, 0) ELSE n END >= vec_id % 12)::INT AS beyond FROM f GROUP BY vec_id""")
def edit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits beyond a size that differs from row to row."""
    places, v = F.sequence(F.lit(0), F.lit(11)), F.col("vec_id")
    zt = F.transform(places, lambda i: F.when(i % 5 == 2, -1).otherwise(((v + i) % 9).cast("int")))
    z1 = F.transform(places, lambda i: F.when(i % 4 == 1, -1).otherwise(((v + i * i) % 9).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", E.out_of_range(E.remaining_edits(zt, z1), (v % 12).cast("int")).alias("beyond"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates are three of a place's logits, the first four places are the prompt."""
    rows = logits(spark, sf_dir).groupBy("seq", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "logit"))), lambda x: x["logit"]).alias("v"))
    rate = lambda k: F.abs(F.get("v", F.lit(k)))
    return rows.select("seq", "pos", (F.col("pos") + 100).alias("tok"), F.lit(4).alias("prompt_len"), rate(0).alias("del_rate"), rate(1).alias("sub_rate"), rate(2).alias("ins_rate"), F.col("v").alias("sub_logits"), F.col("v").alias("ins_logits"))


_U = lambda what: uniform_sql("(seq::VARCHAR || chr(47) || pos::VARCHAR)", f"7{what}")


@query("tau_leap_step", f"""WITH l AS {_LOGITS}, g AS (SELECT seq, pos, abs(max(logit) FILTER (tok = 0)) AS d, abs(max(logit) FILTER (tok = 1)) AS s, abs(max(logit) FILTER (tok = 2)) AS i, arg_max(tok, (logit, -tok)) AS best FROM l GROUP BY seq, pos),
r AS (SELECT seq, pos, d * (pos >= 4)::INT * 2 AS d, s * (pos >= 4)::INT * 2 AS s, i * (pos >= 3)::INT * 2 AS i, best FROM g),
f AS (SELECT *, {_U('fire')} < least((d + s) * 0.1, 1 - 1e-6) AS fires, {_U('which')} < least(d / (d + s + 1e-8), 1) AS del, {_U('ins')} < least(i * 0.1, 1 - 1e-6) AS ins FROM r)
SELECT seq, string_agg(concat_ws(',', CASE WHEN fires AND del THEN NULL WHEN fires THEN best ELSE 100 + pos END, CASE WHEN ins THEN best END), ',' ORDER BY pos)
  FILTER (NOT (fires AND del) OR ins) AS ids, bool_or(fires OR ins) AS edited FROM f GROUP BY seq""")
def tau_leap_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.rebuilt(E.tau_leap(_state(spark, sf_dir), 0.1, 2.0, seed=7))
    return out.select("seq", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "edited")


@query("tau_leap_trace", f"""WITH l AS {_LOGITS}, x AS (SELECT seq, pos, tok, exp((logit - max(logit) OVER (PARTITION BY seq, pos)) / 5) AS e FROM l),
w AS (SELECT *, sum(e) OVER (PARTITION BY seq, pos ORDER BY tok) AS run, sum(e) OVER (PARTITION BY seq, pos) AS total FROM x),
k AS (SELECT seq, pos, least(count(*) FILTER (run < {_U('sub_token')} * total), 63) AS sub, least(count(*) FILTER (run < {_U('ins_token')} * total), 63) AS new FROM w GROUP BY seq, pos),
g AS (SELECT seq, pos, abs(max(logit) FILTER (tok = 0)) AS d, abs(max(logit) FILTER (tok = 1)) AS s, abs(max(logit) FILTER (tok = 2)) AS i FROM l GROUP BY seq, pos),
r AS (SELECT seq, pos, d * (pos >= 4)::INT * 2 AS d, s * (pos >= 4)::INT * 2 AS s, i * (pos >= 3)::INT * 2 AS i FROM g),
f AS (SELECT *, {_U('fire')} < least((d + s) * 0.1, 1 - 1e-6) AS fires, {_U('which')} < least(d / (d + s + 1e-8), 1) AS del, {_U('ins')} < least(i * 0.1, 1 - 1e-6) AS ins FROM r JOIN k USING (seq, pos))
SELECT seq, pos, CASE WHEN NOT fires THEN 'KEEP' WHEN del THEN 'DEL' ELSE 'SUB' END AS op, concat_ws(',', CASE WHEN NOT fires THEN 100 + pos WHEN NOT del THEN sub END, CASE WHEN ins THEN new END) AS after,
  concat_ws(',', CASE WHEN NOT fires THEN 'KEEP' WHEN NOT del THEN 'SUB' END, CASE WHEN ins THEN 'INS' END) AS after_ops FROM f""")
def tau_leap_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one step at temperature 5, with the origin of each new id."""
    out = E.labelled(E.tau_leap(_state(spark, sf_dir), 0.1, 2.0, 5.0, seed=7))
    return out.select("seq", "pos", "op", F.array_join(F.col("out").cast("array<string>"), ",").alias("after"), F.array_join("after_ops", ",").alias("after_ops"))


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, x0, x1): behind a common first token, the best token of each place, and the same with a third of them gone and others changed."""
    best = argmax(logits(spark, sf_dir)).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("b"))
    first = F.array(F.lit(64))
    kept = F.transform(F.filter("b", lambda x: x["pos"] % 3 != 0), lambda x: x["tok"] + F.when(x["pos"] % 4 == 1, 1).otherwise(0))
    return best.select("seq", F.concat(first, kept).alias("x0"), F.concat(first, F.transform("b", lambda x: x["tok"])).alias("x1"))


#: Costs cell by cell in a list, then the way back: a pair before a deletion before an insertion.
_ALIGNED = f"""l AS {_LOGITS}, best AS (SELECT seq, pos, arg_max(tok, (logit, -tok)) AS tok FROM l GROUP BY seq, pos),
x AS (SELECT seq, list_prepend(64, coalesce(list(tok + CASE WHEN pos % 4 = 1 THEN 1 ELSE 0 END ORDER BY pos) FILTER (pos % 3 <> 0), [])) AS x0, list_prepend(64, list(tok ORDER BY pos)) AS x1 FROM best GROUP BY seq),
d AS (SELECT seq, x0, x1, len(x0) AS n, len(x1) + 1 AS w, 0 AS k, []::BIGINT[] AS c FROM x
  UNION ALL SELECT seq, x0, x1, n, w, k + 1, list_append(c, CASE WHEN k < w THEN k WHEN k % w = 0 THEN k // w ELSE least(c[k - w] + CASE WHEN x0[k // w] = x1[k % w] THEN 0 ELSE 1 END, c[k - w + 1] + 1, c[k] + 1) END) FROM d WHERE k < (n + 1) * w),
full_ AS (SELECT * FROM d WHERE k = (n + 1) * w),
r AS (SELECT seq, x0, x1, w, c, n AS i, w - 1 AS j, []::INT[] AS z0, []::INT[] AS z1 FROM full_
  UNION ALL SELECT seq, x0, x1, w, c, CASE WHEN pair OR del THEN i - 1 ELSE i END, CASE WHEN pair OR NOT del THEN j - 1 ELSE j END,
    list_prepend(CASE WHEN pair OR del THEN x0[i] ELSE -1 END, z0), list_prepend(CASE WHEN pair OR NOT del THEN x1[j] ELSE -1 END, z1)
  FROM (SELECT *, coalesce(i > 0 AND j > 0 AND c[i * w + j + 1] = c[(i - 1) * w + j] + CASE WHEN x0[i] = x1[j] THEN 0 ELSE 1 END, false) AS pair, coalesce(i > 0 AND c[i * w + j + 1] = c[(i - 1) * w + j + 1] + 1, false) AS del FROM r WHERE i > 0 OR j > 0)),
z AS (SELECT seq, x1, z0, z1, c[len(c)] AS cost FROM r WHERE i = 0 AND j = 0)"""


@query("align_tokens", f"WITH RECURSIVE {_ALIGNED} SELECT seq, array_to_string(z0, ',') AS z0, array_to_string(z1, ',') AS z1, cost FROM z")
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the best alignments is taken, place by place."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return E.align(token_pairs(spark, sf_dir), "seq").select("seq", text("z0"), text("z1"), "cost")


_TIME = f"(0.999 * {uniform_sql('seq', '3/t')})"
_MIXED = f"""m AS (SELECT seq, x1, z1, {_TIME} AS t, [CASE WHEN {uniform_sql("(seq::VARCHAR || chr(47) || i::VARCHAR)", '3/mix')} < {_TIME} THEN z1[i + 1] ELSE z0[i + 1] END FOR i IN range(len(z0))] AS zt FROM z),
f AS (SELECT seq, i, zt[i] AS a, z1[i] AS b, len(list_filter(zt[1:i - 1], lambda x: x <> -1)) AS n FROM (SELECT *, unnest(range(1, len(zt) + 1)) AS i FROM m)),
e AS (SELECT seq, CASE WHEN a = -1 THEN 'INS' WHEN b = -1 THEN 'DEL' ELSE 'SUB' END AS kind, CASE WHEN a = -1 THEN greatest(n - 1, 0) ELSE n END AS pos, CASE WHEN b <> -1 THEN b END AS token FROM f WHERE a <> b)"""


@query("edit_flow_loss", f"""WITH RECURSIVE {_ALIGNED}, {_MIXED}, size AS (SELECT seq, count(DISTINCT pos) AS size FROM l GROUP BY seq),
p AS (SELECT m.seq, unnest(range(len(list_filter(zt, lambda x: x <> -1)))) AS pos FROM m), pl AS (SELECT p.seq, p.pos, p.pos % size AS here, (p.pos + 1) % size AS next FROM p JOIN size USING (seq)),
g AS (SELECT seq, pos, abs(max(logit) FILTER (tok = 0)) AS d, abs(max(logit) FILTER (tok = 1)) AS s, abs(max(logit) FILTER (tok = 2)) AS i FROM l GROUP BY seq, pos),
rate AS (SELECT a.seq, a.pos, d, s, i, here, next FROM pl a JOIN g ON g.seq = a.seq AND g.pos = a.here),
norm AS (SELECT seq, pos, max(logit) + ln(sum(exp(logit - top))) AS norm FROM (SELECT *, max(logit) OVER (PARTITION BY seq, pos) AS top FROM l) GROUP BY seq, pos),
gain AS (SELECT e.seq, sum(ln(greatest(CASE kind WHEN 'DEL' THEN d WHEN 'SUB' THEN s ELSE i END, 1e-12)) + CASE WHEN kind = 'DEL' THEN 0 ELSE coalesce(l.logit - norm.norm, 0) END) AS gain
  FROM e JOIN rate r ON r.seq = e.seq AND r.pos = e.pos LEFT JOIN l ON l.seq = e.seq AND l.tok = e.token AND l.pos = CASE WHEN kind = 'INS' THEN next ELSE here END LEFT JOIN norm ON norm.seq = l.seq AND norm.pos = l.pos GROUP BY e.seq),
surv AS (SELECT seq, sum(d + s + i) AS survival FROM rate GROUP BY seq)
SELECT m.seq, round(least(1 / (1 - t + 1e-6), 20) * (survival - coalesce(gain, 0)) / len(x1), 6) AS loss FROM m JOIN surv USING (seq) LEFT JOIN gain USING (seq)""")
def edit_flow_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training step over aligned pairs: the pair's own edits, priced by rates of every place and by all 64 tokens."""
    own = logits(spark, sf_dir)
    size = own.groupBy("seq").agg(F.countDistinct("pos").alias("size"))
    rate = own.where("tok < 3").groupBy("seq", F.col("pos").alias("here")).agg(*[F.abs(F.max(F.when(F.col("tok") == k, F.col("logit")))).alias(n) for k, n in enumerate(("del_rate", "sub_rate", "ins_rate"))])

    def rates(canvas: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = canvas.join(size, "seq").select("seq", "pos", (F.col("pos") % F.col("size")).alias("here"), ((F.col("pos") + 1) % F.col("size")).alias("next"))
        by_kind = at.select("seq", "pos", F.explode(F.array(F.struct(F.lit("SUB").alias("kind"), F.col("here").alias("from")), F.struct(F.lit("INS").alias("kind"), F.col("next").alias("from")))).alias("k")).select("seq", "pos", "k.kind", "k.from")
        tokens = by_kind.join(own.select("seq", F.col("pos").alias("from"), F.col("tok").alias("token"), "logit"), ["seq", "from"]).drop("from")
        return at.join(rate, ["seq", "here"]).select("seq", "pos", "del_rate", "sub_rate", "ins_rate"), tokens

    return C.edit_flow_step(token_pairs(spark, sf_dir), rates, kappa("linear"), 3)[0].select("seq", F.round("loss", 6).alias("loss"))
