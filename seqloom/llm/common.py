"""What the training-data operators share: shared storage, ASCII text rules, learning folds, gapless ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import shared_folder as shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and \x09-\x0D: the white space of all text rules here.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, *partition_by: str) -> str:
    """Writes df as a Parquet table in the shared folder; its path."""
    path = shared_dir(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def saved(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, label, *partition_by))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def hash_fraction(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / float(1 << 53)


def least_share(n: Column, most: int, error: float = 0.0) -> Column:
    """Share of n evenly spread hashes below which the `most` least ones lie, but for a chance of about 10^-9.

    n may be wrong by the factor 1 + error. The rows below the share are few, so they can be ranked.
    """
    return (most + 6 * most**0.5 + 32) * (1 + error) / n


def gapless_ranks(df: DataFrame, group: str, ids: list[str], spread: int = 64) -> DataFrame:
    """Adds `rank`, gapless from 0 within `group`, to rows told apart by `ids` only.

    Equal rows are summed to one row with a multiplicity first, so a row that is a third of the
    table never meets itself in one task. Ranks are counted within `spread` hash buckets of a
    group and shifted by the buckets' totals, so a hot group is dealt over many tasks.
    """
    keys = [group, *ids]
    unique = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_sub", F.pmod(F.xxhash64(*ids), F.lit(spread)))
    within = Window.partitionBy(group, "_sub").orderBy(*ids)
    ranked = unique.withColumn("_upto", F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = unique.groupBy(group, "_sub").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col(group).alias("_g"), F.col("_sub").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = ranked.join(shifts, ranked[group].eqNullSafe(shifts["_g"]) & (ranked["_sub"] == shifts["_s"]))
    first = joined.select(*keys, "_copies", (F.col("_shift") + F.col("_upto") - F.col("_copies")).alias("_first"))
    return expand_copies(first, keys)


def expand_copies(df: DataFrame, keys: list[str], step: int = 4096) -> DataFrame:
    """One row per copy with rank _first .. _first + _copies - 1, in two explodes so that no array is longer than needed."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / step))))
    size = F.least(F.lit(step).cast("long"), F.col("_copies") - F.col("_block") * step)
    return blocks.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), size - 1))).select(*keys, (F.col("_first") + F.col("_block") * step + F.col("_at")).alias("rank"))
