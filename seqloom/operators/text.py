"""Prompts, conversations and word tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def instruction_prompt(instruction: Column, extra: Column) -> Column:
    """Instruction, and after an empty line the input if it isn't blank; nulls are empty."""
    one, two = strip(F.coalesce(instruction, F.lit(""))), strip(F.coalesce(extra, F.lit("")))
    return F.when(F.length(two) > 0, F.concat(one, F.lit("\n\n"), two)).otherwise(one)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair_chat(user: Column, assistant: Column) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def reasoning_chat(question: Column, trajectories: Column, attempt: Column) -> Column:
    """User and assistant messages; the assistant's reasoning is the first trajectory, null if there is none."""
    def full(role: str, content: Column, reasoning: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), reasoning.alias("reasoning_content"))

    return F.array(full("user", question, F.lit(None).cast("string")), full("assistant", attempt, F.get(trajectories, F.lit(0))))


def chats(rows: DataFrame) -> DataFrame:
    """(conv_id, messages) of rows (conv_id, turn, role, text), in the order of turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def first_turn(messages: Column) -> Column:
    """struct(prompt, response): first user message and the first assistant message after it, both stripped; null unless both have text."""
    at = F.filter(F.transform(messages, lambda m, i: F.struct(m["role"].alias("r"), m["content"].alias("c"), i.alias("i"))), lambda m: m["c"].isNotNull())
    user = F.get(F.filter(at, lambda m: m["r"] == "user"), F.lit(0))
    reply = F.get(F.filter(at, lambda m: (m["r"] == "assistant") & (m["i"] > user["i"])), F.lit(0))
    prompt, response = strip(user["c"]), strip(reply["c"])
    return F.when((F.length(prompt) > 0) & (F.length(response) > 0), F.struct(prompt.alias("prompt"), response.alias("response")))


def render_headers(messages: Column, generate: bool = False, bos: str = "<|startoftext|>") -> Column:
    """Role headers and an end mark per message; BOS before the first; a header to go on from, unless an assistant spoke last."""
    head = lambda role: F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
    body = F.array_join(F.transform(messages, lambda m: F.concat(head(m["role"]), strip(m["content"]), F.lit("<|eot_id|>"))), "")
    text = F.when(F.size(messages) > 0, F.concat(F.lit(bos), body)).otherwise(F.lit(""))
    return F.concat(text, _opening(messages, head(F.lit("assistant")))) if generate else text


def render_blocks(messages: Column, generate: bool = False) -> Column:
    """[SYS], [Question] and [Answer] blocks; a system message counts in the first place only, other roles are left out."""
    block = lambda tag, x: F.concat(F.lit(f"[{tag}]\n"), strip(x), F.lit(f"\n[/{tag}]\n\n"))
    system = F.get(messages, F.lit(0))
    first = F.when(system["role"] == "system", block("SYS", system["content"])).otherwise("")
    rest = F.transform(messages, lambda m: F.when(m["role"] == "user", block("Question", m["content"])).when(m["role"] == "assistant", block("Answer", m["content"])).otherwise(""))
    text = F.concat(F.coalesce(first, F.lit("")), F.array_join(rest, ""))
    return F.concat(text, _opening(messages, F.lit("[Answer]\n"))) if generate else text


def _opening(messages: Column, text: Column) -> Column:
    last = F.get(messages, F.size(messages) - 1)["role"]
    return F.when(F.coalesce(last == "assistant", F.lit(False)), "").otherwise(text)


#: The markers above are fixed by the models that were trained with them.
TEMPLATES = {"headers": render_headers, "blocks": render_blocks}


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(0))


def word_id(word: Column, vocabulary: int = 50_000, first: int = 10) -> Column:
    """Stable ids by hash, after `first` reserved ones; no vocabulary has to be held anywhere."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % vocabulary + first).cast("int")


def token_ids(text: Column) -> Column:
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: word_id(w))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def bpe_ids(path: str, special: bool = False) -> Callable[[Column], Column]:
    """Ids of a public tokenizer's file, which workers read at `path`, as an Arrow UDF; null texts are empty. special adds the tokenizer's own marks."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = _tokenizer(path)
        out = []
        for at in range(0, len(texts), 256):
            coded = own.encode_batch_fast([t or "" for t in texts.iloc[at : at + 256]], add_special_tokens=special)
            out += [np.array(c.ids, dtype=np.int32) for c in coded]
        return pd.Series(out, index=texts.index)

    return encode


def bpe_text(path: str) -> Callable[[Column], Column]:
    """The text of ids, special tokens left out."""

    @F.pandas_udf("string")
    def decode_(ids: pd.Series) -> pd.Series:
        return pd.Series(_tokenizer(path).decode_batch([[int(i) for i in row] if row is not None else [] for row in ids]), index=ids.index)

    return decode_


def sft_map(df: DataFrame, messages: str = "messages", encode: Callable[[Column], Column] = token_ids, template: str = "headers", mask_prompt: bool = True) -> DataFrame:
    """Adds input_ids, labels and prompt_len of a chat whose last message is the answer.

    The whole chat is rendered and encoded, and so is all before the answer, with the header to go on from; labels of that
    prompt are ignored if mask_prompt.
    """
    from . import pack as P

    render, chat = TEMPLATES[template], F.col(messages)
    asked = F.slice(chat, 1, F.size(chat) - 1)
    rows = df.withColumns({"input_ids": encode(render(chat)), "_asked": encode(render(asked, True))}).withColumn("prompt_len", F.size("_asked")).drop("_asked")
    labels = P.sft_labels(F.col("input_ids"), F.col("prompt_len")) if mask_prompt else F.col("input_ids")
    return rows.withColumn("labels", labels)


def decode(df: DataFrame, key: str, ids: str, vocabulary: DataFrame) -> DataFrame:
    """(key, text): ids to words by a table (id, word); unknown ids are left out, rows without a known id are empty texts."""
    flat = df.select(key, F.posexplode(ids).alias("pos", "id")).join(vocabulary, "id")
    joined = flat.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    return df.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


#: Fixed pattern of the byte-level pre-tokenizer.
PRE_TOKENS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PRE_TOKENS})"), F.lit(1))
