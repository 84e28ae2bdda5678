"""Queries over noise schedules and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules as S
from ..functions.rng import uniform_sql
from .registry import query, table

#: Every document's own time, in hundredths.
_TIMES = "(SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS t FROM documents)"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / 100.0).alias("t"))


def _schedule(name: str, make: S.Alpha | S.Kappa, value: str, slope: str, weight: str) -> None:
    @query(name, f"SELECT doc_id, t, round({value}, 9) AS value, round({slope}, 9) AS slope, round({weight.format(v=value, d=slope)}, 6) AS weight FROM {_TIMES}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.col("t")
        return _times(spark, sf_dir).select("doc_id", "t", F.round(make(t), 9).alias("value"), F.round(make.derivative(t), 9).alias("slope"), F.round(make.weight(t), 6).alias("weight"))


_ALPHA, _KAPPA = "-({d}) / (1 - ({v}) + 1e-6)", "({d}) / (1 - ({v}) + 1e-6)"
_schedule("alpha_linear", S.alpha("linear"), "(1 - t)", "(t * 0 - 1)", _ALPHA)
_schedule("alpha_cosine", S.alpha("Cosine"), "(1 - cos(pi() / 2 * (1 - t)))", "(-(pi() / 2) * sin(pi() / 2 * (1 - t)))", _ALPHA)
_schedule("kappa_cubic", S.kappa("cubic"), "(2 * t * t * t - 3 * t * t + 2 * t)", "(6 * t * t - 6 * t + 2)", _KAPPA)
_schedule("kappa_linear", S.kappa("linear"), "t", "(t * 0 + 1)", _KAPPA)
_schedule("kappa_cosine", S.kappa("cosine"), "(1 - cos(pi() / 2 * t))", "(pi() / 2 * sin(pi() / 2 * t))", _KAPPA)


@query("reverse_mask_prob", """
SELECT doc_id, s, t, round(s / t, 9) AS linear, round(cos(pi() / 2 * (1 - s)) / cos(pi() / 2 * (1 - t)), 9) AS cosine
FROM (SELECT doc_id, (n_chars % 75) / 100.0::DOUBLE AS s, (n_chars % 75 + 25) / 100.0::DOUBLE AS t FROM documents)
""")
def reverse_mask_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 75 / 100.0).alias("s"), ((F.col("n_chars") % 75 + 25) / 100.0).alias("t"))
    s, t = F.col("s"), F.col("t")
    return pairs.select("doc_id", "s", "t", F.round(S.alpha("linear").reverse_mask_prob(s, t), 9).alias("linear"), F.round(S.alpha("cosine").reverse_mask_prob(s, t), 9).alias("cosine"))


@query("transfer_quota_drawn", f"""
WITH RECURSIVE q(doc_id, k, rest, got) AS (
  SELECT doc_id, 0, (n_chars % 40)::BIGINT, []::BIGINT[] FROM documents
  UNION ALL
  SELECT doc_id, k + 1, rest - n, list_append(got, n) FROM (
    SELECT doc_id, k, rest, got, len([i FOR i IN range(1, rest + 1) IF {uniform_sql("(doc_id::VARCHAR || '/' || k::VARCHAR || '/' || i::VARCHAR)", 4)} < 1 - (cos(pi() / 2 * (1 - (5 - k) / 6.0::DOUBLE)) / cos(pi() / 2 * (1 - (6 - k) / 6.0::DOUBLE)))]) AS n FROM q WHERE k < 6))
SELECT doc_id, array_to_string(got, ',') AS quota FROM q WHERE k = 6
""")
def transfer_quota_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas drawn by the binomial law, cosine schedule, zeros kept."""
    docs = table(spark, sf_dir, "documents")
    quota = S.transfer_quota(F.col("n_chars") % 40, 6, S.alpha("cosine"), True, S.binomial_draw(F.col("doc_id"), 4))
    return docs.select("doc_id", F.array_join(quota.cast("array<string>"), ",").alias("quota"))


@query("transfer_quota", """
WITH RECURSIVE q(doc_id, k, rest, got) AS (
  SELECT doc_id, 0, (n_chars % 40)::BIGINT, []::BIGINT[] FROM documents
  UNION ALL
  SELECT doc_id, k + 1, rest - n, list_append(got, n) FROM (
    SELECT doc_id, k, rest, got, least(round_even(rest * (1 - ((8 - k - 1) / 8.0::DOUBLE) / ((8 - k) / 8.0::DOUBLE)), 0)::BIGINT, rest) AS n FROM q WHERE k < 8))
SELECT doc_id, array_to_string(list_filter(got, lambda x: x > 0), ',') AS quota FROM q WHERE k = 8
""")
def transfer_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quota = S.transfer_quota(F.col("n_chars") % 40, 8, S.alpha("linear"))
    return docs.select("doc_id", F.array_join(quota.cast("array<string>"), ",").alias("quota"))


@query("even_schedule", """
SELECT doc_id, array_to_string([(n_chars % 100) // 7 + CASE WHEN i < (n_chars % 100) % 7 THEN 1 ELSE 0 END FOR i IN range(7)], ',') AS quota FROM documents
""")
def even_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(S.even_quota(F.col("n_chars") % 100, 7).cast("array<string>"), ",").alias("quota"))


@query("step_quota", """
SELECT doc_id, i AS step, CASE WHEN i = 3 THEN m ELSE floor(m * (1 - (1 - (i + 1) / 4.0::DOUBLE) / (1 - i / 4.0::DOUBLE)))::BIGINT END AS quota
FROM (SELECT doc_id, n_chars % 50 AS m FROM documents), range(4) r(i)
""")
def step_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.col("n_chars") % 50).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("step"))
    i = F.col("step")
    return rows.select("doc_id", "step", S.step_quota(F.col("m"), 1 - (i + 1) / 4.0, 1 - i / 4.0, i == 3).alias("quota"))
