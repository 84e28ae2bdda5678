"""From raw documents to packed training sequences: toxicity, line dedup, near dedup, decontamination, packing.

Each stage's rows are written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import stages
from seqloom.llm.common import saved, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_common_lines),
    ("simhash_near_dedup", stages.keep_one_of_similar),
    ("decontamination", stages.drop_contaminated),
    ("best_fit_packing", stages.pack_sequences),
]

#: SQL can express neither the learnt scores nor the fingerprints and token ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
