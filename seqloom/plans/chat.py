"""Queries over prompts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pack as P
from ..operators import text as X
from .registry import query, table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORD_ID = "((('0x' || substr(md5({0}), 1, 7))::BIGINT % 50000 + 10)::INT)"
WORDS = r"regexp_extract_all({0}, '\S+')"
IDS = "[" + WORD_ID.format("w") + " FOR w IN " + WORDS + "]"


def strip_sql(x: str) -> str:
    return STRIP.replace("{0}", x)


def ids_sql(x: str) -> str:
    return IDS.replace("{0}", x)


@query("instruction_prompt", f"""
SELECT doc_id, CASE WHEN length({strip_sql('two')}) > 0 THEN {strip_sql('one')} || chr(10) || chr(10) || {strip_sql('two')} ELSE {strip_sql('one')} END AS prompt
FROM (SELECT doc_id, split_part(text, '.', 1) AS one, split_part(text, chr(10), 2) AS two FROM documents)
""")
def instruction_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    one, two = F.split_part("text", F.lit("."), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(2))
    return docs.select("doc_id", X.instruction_prompt(one, two).alias("prompt"))


@query("pair_chat", "SELECT doc_id, 'user' AS role_0, split_part(text, chr(10), 1) AS content_0, 'assistant' AS role_1, text AS content_1 FROM documents")
def pair_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.pair_chat(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).alias("m"))
    return rows.select("doc_id", *[F.col("m")[k][f].alias(f"{f}_{k}") for k in (0, 1) for f in ("role", "content")])


@query("reasoning_chat", """
SELECT doc_id, 'assistant' AS role, text AS content, string_split(text, '.')[1] AS reasoning_content FROM documents
""")
def reasoning_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.reasoning_chat(F.col("lang"), F.split("text", r"\."), F.col("text"))[1].alias("m"))
    return rows.select("doc_id", "m.role", "m.content", "m.reasoning_content")


_TURNS = f"""
  first_user AS (SELECT conv_id, min(turn) AS u FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
  reply AS (SELECT c.conv_id, u, min(turn) AS a FROM conversations c JOIN first_user USING (conv_id) WHERE role = 'assistant' AND text IS NOT NULL AND turn > u GROUP BY ALL),
  pair AS (SELECT r.conv_id, {strip_sql('p.text')} AS prompt, {strip_sql('q.text')} AS response
    FROM reply r JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = u JOIN conversations q ON q.conv_id = r.conv_id AND q.turn = a)
"""


@query("first_turn", f"WITH {_TURNS} SELECT * FROM pair WHERE length(prompt) > 0 AND length(response) > 0")
def first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.chats(table(spark, sf_dir, "conversations")).select("conv_id", X.first_turn(F.col("messages")).alias("t"))
    return rows.where("t IS NOT NULL").select("conv_id", "t.prompt", "t.response")


_LAST = "arg_max(role, turn)"


@query("chat_render_headers", f"""
SELECT conv_id, '<|startoftext|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {strip_sql('text')} || '<|eot_id|>', '' ORDER BY turn)
  || CASE WHEN {_LAST} = 'assistant' THEN '' ELSE '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) END AS text
FROM conversations GROUP BY conv_id
""")
def chat_render_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chats(table(spark, sf_dir, "conversations")).select("conv_id", X.render_headers(F.col("messages"), True).alias("text"))


@query("chat_render_blocks", f"""
SELECT conv_id, string_agg(CASE
    WHEN role = 'system' AND turn = first THEN '[SYS]' || chr(10) || body || chr(10) || '[/SYS]' || chr(10) || chr(10)
    WHEN role = 'user' THEN '[Question]' || chr(10) || body || chr(10) || '[/Question]' || chr(10) || chr(10)
    WHEN role = 'assistant' THEN '[Answer]' || chr(10) || body || chr(10) || '[/Answer]' || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn)
  || CASE WHEN {_LAST} = 'assistant' THEN '' ELSE '[Answer]' || chr(10) END AS text
FROM (SELECT *, {strip_sql('text')} AS body, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY conv_id
""")
def chat_render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chats(table(spark, sf_dir, "conversations")).select("conv_id", X.render_blocks(F.col("messages"), True).alias("text"))


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, input_ids, labels, prompt_len, attention_mask) of first turns."""
    pairs = first_turn(spark, sf_dir)
    ids = pairs.select("conv_id", X.token_ids(F.col("prompt")).alias("p"), X.token_ids(F.col("response")).alias("r"))
    rows = ids.select("conv_id", F.concat("p", "r").alias("input_ids"), F.size("p").alias("prompt_len"))
    labels = P.sft_labels(F.col("input_ids"), F.col("prompt_len"))
    return rows.select("conv_id", "input_ids", labels.alias("labels"), "prompt_len", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"))


SFT = f"""WITH {_TURNS}, ids AS (SELECT conv_id, {ids_sql('prompt')} AS p, {ids_sql('response')} AS r FROM pair WHERE length(prompt) > 0 AND length(response) > 0),
sft AS (SELECT conv_id, list_concat(p, r) AS input_ids, list_concat([-100 FOR x IN p], r) AS labels, len(p)::INT AS prompt_len FROM ids)
"""


def text_of(name: str) -> F.Column:
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


@query("sft_labels", SFT + "SELECT conv_id, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, prompt_len FROM sft")
def sft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_rows(spark, sf_dir).select("conv_id", text_of("input_ids"), text_of("labels"), "prompt_len")


@query("length_filter", SFT + "SELECT conv_id, len(input_ids)::INT AS n FROM sft WHERE len(input_ids) <= 100")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.post_process(sft_rows(spark, sf_dir), 100, "filter").select("conv_id", F.size("input_ids").alias("n"))


@query("clip_right", SFT + "SELECT conv_id, array_to_string(input_ids[1:60], ',') AS input_ids, array_to_string(labels[1:60], ',') AS labels FROM sft WHERE prompt_len <= 60")
def clip_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.post_process(sft_rows(spark, sf_dir), 60, "right").select("conv_id", text_of("input_ids"), text_of("labels"))


@query("clip_left", SFT + "SELECT conv_id, array_to_string(input_ids[greatest(len(input_ids) - 60, 0) + 1:], ',') AS input_ids FROM sft")
def clip_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clip_rows(sft_rows(spark, sf_dir), 60, "left").select("conv_id", text_of("input_ids"))


@query("clip_keep_prompt", SFT + """SELECT conv_id, array_to_string(list_concat(input_ids[1:prompt_len],
  input_ids[prompt_len + 1 : prompt_len + greatest(60 - prompt_len, 0)]), ',') AS input_ids FROM sft""")
def clip_keep_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clip_rows(sft_rows(spark, sf_dir), 60, "right", True).select("conv_id", text_of("input_ids"))


@query("pre_tokens")
def pre_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.pre_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(X.pre_tokens(F.col("text")), "")).alias("joined"))


_ASKED = "'<|startoftext|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || prompt || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"


@query("sft_map", f"""WITH {_TURNS}, t AS (SELECT conv_id, {_ASKED} AS asked, response FROM pair WHERE length(prompt) > 0 AND length(response) > 0),
i AS (SELECT conv_id, {ids_sql("(asked || response || '<|eot_id|>')")} AS ids, len({ids_sql('asked')}) AS p FROM t)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string([CASE WHEN k <= p THEN -100 ELSE ids[k] END FOR k IN range(1, len(ids) + 1)], ',') AS labels, p::INT AS prompt_len FROM i""")
def sft_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns rendered by the template, encoded, the prompt's labels ignored."""
    pairs = first_turn(spark, sf_dir).select("conv_id", X.pair_chat(F.col("prompt"), F.col("response")).alias("messages"))
    return X.sft_map(pairs).select("conv_id", text_of("input_ids"), text_of("labels"), "prompt_len")


@query("bpe_round_trip", "SELECT doc_id, text FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte-level tokenizer's ids give the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = table(spark, sf_dir, "documents").select("doc_id", X.bpe_ids(path)(F.col("text")).alias("ids"))
    return ids.select("doc_id", X.bpe_text(path)(F.col("ids")).alias("text"))
