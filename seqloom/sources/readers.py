"""Named dataset readers for load(): each makes a public dataset's saved files what training needs.

A dataset is a folder of files; configs are its subfolders, splits its partitions `split=...`. Rows get `ord`, their
place in the files' order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as X
from . import datasets as D

#: Fixed: the column that holds the programming language in each config.
LANG_COLUMNS = {"synthetic_code_snippet": "lang", "algorithmic_corpus": "lang", "synthetic_qa": "program_lang"}


def config_names(spark: SparkSession, path: str) -> list[str]:
    """Subfolders of a dataset, in order of their names, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [s.getPath().getName() for s in found if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".", "split=")))


def rows_of(spark: SparkSession, path: str, config: str | None = None) -> DataFrame:
    df = D.read_auto(spark, path, config)
    return D.with_split(df if "ord" in df.columns else D.in_file_order(df))


def parted(df: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Test and train of the rows, by the hash of `id` or, without one, of the row itself."""
    bare = df.drop("split")
    own = F.col("id") if "id" in bare.columns else F.md5(F.to_json(F.struct(*[c for c in bare.columns if c != "ord"])))
    return D.hash_split(bare.withColumn("_key", own), "_key", share, seed).drop("_key")


def alpaca(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """instruction, input and output as a chat of prompt and answer; 95 to 5 parts."""
    rows = parted(rows_of(spark, path))
    prompt = X.instruction_prompt(F.col("instruction"), F.col("input"))
    return rows.select(X.pair_chat(prompt, F.col("output")).alias("messages"), "ord", "split")


def opc_sft(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """instruction and output as a chat; 95 to 5 parts; `lang` keeps the rows whose answer holds it, after the parts are made."""
    rows = parted(rows_of(spark, path, own.get("name")))
    chat = rows.select(X.pair_chat(F.col("instruction"), F.col("output")).alias("messages"), "ord", "split")
    return chat.where(F.contains(F.col("messages")[1]["content"], F.lit(own["lang"]))) if own.get("lang") else chat


def opc_annealing(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """One config or, without a name, all of them; `lang` filters by the column that the config keeps it in."""

    def one(s: SparkSession, config: str) -> DataFrame:
        rows = rows_of(s, path, config)
        if not own.get("lang"):
            return rows
        if config not in LANG_COLUMNS:
            raise NotImplementedError(f"no language column is known for {config!r}")
        return rows.where(F.col(LANG_COLUMNS[config]) == own["lang"])

    return one(spark, own["name"]) if own.get("name") else D.all_configs(spark, config_names(spark, path), one)


def ultrachat(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """Chats as they are; train_sft and test_sft are train and test, other splits go."""
    rows = rows_of(spark, path).where(F.col("split").isin("train_sft", "test_sft"))
    return D.rename_splits(rows, {"train_sft": "train", "test_sft": "test"})


def first_turns(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """ultrachat's first turns as prompt and answer; chats without both go."""
    rows = ultrachat(spark, path, own).withColumn("_turn", X.first_turn(F.col("messages"))).where("_turn IS NOT NULL")
    return rows.select(X.pair_chat(F.col("_turn.prompt"), F.col("_turn.response")).alias("messages"), "ord", "split")


def reasoning(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """question, thinking_trajectories and attempt as a chat with the reasoning beside the answer."""
    return rows_of(spark, path).select(X.reasoning_chat(F.col("question"), F.col("thinking_trajectories"), F.col("attempt")).alias("messages"), "ord", "split")


def mixture(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """Rows as they are; 95 to 5 parts of train."""
    return parted(rows_of(spark, path).where("split = 'train'"))


def configured(spark: SparkSession, path: str, own: dict) -> DataFrame:
    """The config `name`, `all` if none is named."""
    return rows_of(spark, path, own.get("name") or "all")


#: Fixed names of public datasets, matched as suffixes or parts of a path.
READERS: dict[str, D.Reader] = {
    "tatsu-lab/alpaca": alpaca,
    "allenai/tulu-3-sft-mixture": mixture,
    "HuggingFaceTB/smoltalk": configured,
    "OpenCoder-LLM/opc-sft-stage1": opc_sft,
    "OpenCoder-LLM/opc-sft-stage2": opc_sft,
    "OpenCoder-LLM/opc-annealing-corpus": opc_annealing,
    "HuggingFaceH4/ultrachat_200k": ultrachat,
    "simplescaling/s1K": reasoning,
}
