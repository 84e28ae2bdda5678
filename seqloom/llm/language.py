"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from texts of that language. A text is compressed,
in pieces, with every dictionary; the language whose dictionary gives the fewest bytes in all wins. Pieces
are short and independent of each other, so that the dictionary, not the text itself, decides, however long
the text is. The score grows with the margin to the runner-up; narrow margins are marked as rejected.

Fitted on a bounded sample: at most `sample_texts` different texts of a language, `sample_chars` code points
of each (from a place that the text's hash names) and `dictionary_bytes` of these. Ties go to the language
with more training rows, then to the lesser name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dealt
from .common import crc_mod, hash_fraction, least_share, saved, table

UNKNOWN = "und"


def sample_by_label(rows: DataFrame, label: str, texts: int, chars: int, sizes: dict[str, int]) -> DataFrame:
    """(label, rank, text): of each label the `texts` different texts of least hash, cut to `chars` code points. No text is shuffled.

    sizes are the labels' numbers of different texts, within a tenth: a share of the hashes that holds the least ones
    is cut off before they are ranked, so no task gets a whole language.
    """
    hashed = rows.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.xxhash64("text").alias("h"), "text")
    counts = rows.sparkSession.createDataFrame([*sizes.items()], "kind string, n long")
    near = hashed.join(F.broadcast(counts), F.col("label") == F.col("kind")).where(hash_fraction(F.col("h")) < least_share(F.col("n"), texts, 0.2))
    order = Window.partitionBy("label").orderBy(hash_fraction(F.col("h")), "h")
    chosen = near.select("label", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts)
    chosen = saved(chosen.select("label", "h", "rank"), "language-sample")
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1) + 1
    cut = hashed.join(F.broadcast(chosen), ["label", "h"]).select("label", "rank", F.col("text").substr(start.cast("int"), F.lit(chars)).alias("text"))
    return cut.groupBy("label", "rank").agg(F.min("text").alias("text"))


def dictionaries(rows: DataFrame, label: str = "lang", sample_texts: int = 256, sample_chars: int = 2000, dictionary_bytes: int = 65_536, most_languages: int = 1000) -> dict[str, bytes]:
    """Raw dictionaries in order of preference at ties. rows: text and label.

    Of more than most_languages labels the most frequent ones are learnt, by name at ties. Each sampled text has an equal part of the dictionary: what short ones leave goes to the longer ones.
    """
    named = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    sizes = named.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).orderBy(F.desc("n"), "label").limit(most_languages).collect()
    counts = {r["label"]: r["n"] for r in sizes}
    if not counts:
        return {}
    if len(counts) == most_languages:
        rows = rows.where(F.col(label).isin(*counts))
    parts: dict[str, list[tuple[int, bytes]]] = {k: [] for k in counts}
    for r in sample_by_label(rows, label, sample_texts, sample_chars, {r["label"]: max(1, r["texts"]) for r in sizes}).collect():
        parts[r["label"]].append((r["rank"], normal(r["text"]).encode()))
    order = sorted(counts, key=lambda k: (-counts[k], k))
    return {k: b"\n".join(even_parts([t for _, t in sorted(parts[k])], dictionary_bytes)) for k in order}


def even_parts(texts: list[bytes], size: int) -> list[bytes]:
    """Beginnings of the texts, as long as each other where the texts reach, of `size` bytes in all with a line end after each but the last."""
    room, bound = size - len(texts) + 1, 0
    for k, n in enumerate(sorted(map(len, texts))):
        left = len(texts) - k
        bound = room // left
        if n > bound:
            break
        room, bound = room - n, n
    return [t[: max(0, bound)].decode("utf-8", "ignore").encode() for t in texts]


def normal(text: str) -> str:
    """Lower case; white space, digits and punctuation count as one space."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


class Sizes:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, raw: dict[str, bytes], level: int = 3, piece: int = 2048):
        self.names, self.piece = [*raw], piece
        self.coders = []
        for data in raw.values():
            kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
            if kept:
                kept.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str) -> list[int]:
        total = [0] * len(self.coders)
        for at in range(0, len(text), 1 << 20):
            data = normal(text[at : at + (1 << 20)]).encode()
            for lo in range(0, len(data), self.piece):
                part = data[lo : lo + self.piece]
                for k, coder in enumerate(self.coders):
                    total[k] += len(coder.compress(part))
        return total

    def best(self, text: str) -> tuple[str, float]:
        """(language, score from 0 to 1); no letters or nothing learnt give und and 0."""
        if not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self(text)
        first = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[first], 1.0
        second = min(s for k, s in enumerate(sizes) if k != first)
        margin = (second - sizes[first]) / second
        return self.names[first], margin / (margin + 0.05)


def identify(docs: DataFrame, raw: dict[str, bytes], reject_below: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row. Null texts and texts without a letter are und and rejected.

    Null or repeated ids are rows like others, an empty table gives none, other columns are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(raw)
        for batch in batches:
            found = [sizes.best(t.as_py() or "") for t in batch.column(1)]
            names, scores = [n for n, _ in found], [s for _, s in found]
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([s < reject_below for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learnt from those whose crc32(doc_id as text) mod 5 is not 0."""
    docs = dealt(table(spark, sf_dir, "documents"))
    raw = dictionaries(docs.where(crc_mod("doc_id", 5) != 0).select("text", "lang"))
    return identify(docs, raw).withColumn("held_out", crc_mod("doc_id", 5) == 0)
