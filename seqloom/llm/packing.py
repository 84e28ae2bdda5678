"""Best-fit packing with large-item matching.

Documents become token ids by a public tokenizer and an end id; only longer ones are cut. A piece above a
third of the capacity is large: a sequence holds two of them at most, so they are matched greedily, the
longest with the longest partner that fits. Smaller pieces then go, longest first, to the tightest gap.

Only the histogram of lengths decides, so it alone (at most `capacity` rows) comes to the driver, which
plans runs of equal sequences: (length, ranks) -> (sequences, offset). The plan's size depends on the
capacity and the lengths in use, not on the number of documents. It goes back as a broadcast, and each
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt
from .common import gapless_ranks, saved, table
from .words import segments

TOKENIZER = "word_bpe_49k.json"
#: A Latin-1 letter and the ASCII signs behind it, up to the end.
_STOP = r"([a-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)$"
#: Bytes of text whose chunks are looked up at once.
AT_ONCE = 8 << 20


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkIds(dict):
    """UTF-8 chunks without white space to their ids as little-endian uint32 bytes.

    The tokenizer's normaliser and pre-tokenizer never look across white space, so the ids of a text are
    those of its chunks; neither does it join ASCII signs at a chunk's end to the Latin-1 letter before them, and it
    lower-cases (its special tokens, which it does not, hold <|). Chunks of Latin letters alone are single words to it and go
    to its BPE model at once. At most `most` chunks are remembered, none above 64 bytes: the half seen last in this dictionary,
    which becomes `older` when it is full.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.older: dict[bytes, bytes] = {}
        self.model, self.bytes = self.tokenizer.model, byte_letters()

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of every text. Arrow finds the distinct chunks of all of them, so each is looked up once."""
        lowered = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_string())
        return joined(lowered, self.of_words).to_pylist()

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of words without white space, which may end in signs."""
        stopped = pc.replace_substring_regex(words, _STOP, r"\1 \2")
        return joined(pc.if_else(pc.match_substring(words, "<|"), words, stopped), self.of_chunks)

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks, of which the new ones are learnt."""
        names = chunks.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.get, names)]
        if None in found:
            missing = [c for c, ids in zip(names, found, strict=True) if ids is None]
            new = {c: self.older[c] for c in missing if c in self.older}
            new |= self.learn([c for c in missing if c not in new])
            if len(self) + len(new) > self.most // 2:
                self.older = {**self}
                self.clear()
            self.update(islice(((c, ids) for c, ids in new.items() if 0 < len(c) <= 64), self.most // 2 - len(self)))
            found = [new[c] if ids is None else ids for c, ids in zip(names, found, strict=True)]
        return pa.array(found, pa.large_binary())

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        out, odd = {}, []
        tokenize, letters = self.model.tokenize, self.bytes
        for chunk in new:
            if chunk.isalpha():
                word = chunk.lower().decode()
            elif (text := chunk.decode()).isalpha() and max(text) < "\u0130":
                word = text.lower().encode().decode("latin-1").translate(letters)
            else:
                odd.append(chunk)
                continue
            out[chunk] = array("I", [t.id for t in tokenize(word)]).tobytes()
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for chunk, coded in zip(some, self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False), strict=True):
                out[chunk] = np.array(coded.ids, dtype="<u4").tobytes()
        return out


def joined(texts: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The ids of every text: those of its parts between white space, which ids_of gives for the distinct ones."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.values.dictionary_encode()
    ids = ids_of(coded.dictionary).take(coded.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64)[parts.offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2] or pa.py_buffer(b"")])


@lru_cache(maxsize=1)
def chunk_ids(path: str, most: int) -> ChunkIds:
    """A Python worker's chunks, kept from task to task."""
    return ChunkIds(path, most)


def together(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (UTF-8, null: empty) of consecutive rows, AT_ONCE bytes of text at most or one longer text."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        body = text.as_buffer().to_pybytes() if text.is_valid else b""
        if docs and size + len(body) > AT_ONCE:
            yield docs, texts
            docs, texts, size = [], [], 0
        docs.append(doc)
        texts.append(body)
        size += len(body)
    if docs:
        yield docs, texts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = TOKENIZER, with_ids: bool = False, remembered: int = 500_000) -> DataFrame:
    """One row per piece of every document (doc_id, text): PIECES and, if asked for, ids (little-endian uint32).

    A null or empty text is the end id alone. Texts are read whole, in bounded parts. A worker remembers `remembered` chunks at most.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, end = chunk_ids(tokenizer_path(tokenizer), remembered), np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            for some, texts in together(batch):
                coded = known.encode_all(texts) if len(texts) > 1 else [b"".join(map(known.encode, segments(texts[0])))]
                cols: list[list] = [[], [], [], [], [], []]
                for doc, body in zip(some, coded, strict=True):
                    ids = body + end
                    for k, at in enumerate(range(0, len(ids), width)):
                        piece = ids[at : at + width]
                        for col, value in zip(cols, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=True):
                            col.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                take = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:take], kinds, strict=False)], names=names[:take])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): the piece of that length and rank goes to sequence first + rank - first rank."""
    left = {n: c for n, c in histogram.items() if c}
    out: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left in each of a run of sequences: (first sequence, count)
    order: list[int] = []
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        out.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        partner = large[at] if at >= 0 else None
        if partner == n and left[n] < 2:
            partner = large[at - 1] if at > 0 else None
        count = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
        put(n, count, sequences, 0)
        if partner is not None:
            put(partner, count, sequences, n)
        leave(capacity - n - (partner or 0), sequences, count)
        sequences += count
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                count = max(1, left[n] // each)
                leave(capacity, sequences, count)
                sequences += count
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = min(gap // n, left[n])
            full = min(count, left[n] // each)
            for k in range(each):
                put(n, full, first, capacity - gap + k * n)
            leave(gap - each * n, first, full)
            leave(gap, first + full, count - full)
    return out


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to saved pieces (PIECES, in which equal rows are interchangeable)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan_runs(histogram, capacity), "_length long, _rank long, _count long, _sequence long, offset long")
    ranked = gapless_ranks(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"])
    at = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_count"))
    placed = ranked.join(F.broadcast(runs), at)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("rank") - F.col("_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = TOKENIZER, remembered: int = 500_000) -> DataFrame:
    """Pieces of all documents with their sequences and places in them.

    Null and empty texts are pieces of the end id; null and repeated doc_ids are packed like others; an
    empty table gives no rows; columns other than doc_id and text are not used.
    """
    return pack(saved(pieces_of(docs, capacity, end_id, tokenizer, remembered=remembered), "pack-pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return pack_documents(dealt(table(spark, sf_dir, "documents")))
