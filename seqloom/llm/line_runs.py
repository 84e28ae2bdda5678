"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table (h, n) sorted by h within its files: h is the XXH64 of a line's key, n the
number of documents of the run's batches that hold it. A new batch is counted, merge-anti-joined
against the sealed runs (keys already known to be frequent need no more counting) and becomes a run of
level 0. `fanout` runs of a level are merged into one of the next; keys that reach the bound there
are moved to a sealed run. Runs cost 16 bytes per distinct line and no text. Parquet does not tell Spark
that a run is sorted, so a merge deals and sorts its 16 bytes a key again.

A key is the line without [\\x20\\x09-\\x0D] at either end and with A-Z lower-cased. Keys are told apart
by 64 bits: with 10^11 distinct lines and 10^7 frequent keys, 0.05 lines are expected to be dropped
wrongly. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, saved, stored, table


#: Parts of a hot text's rows where lists are joined.
SALTS = 16
#: Longer lists of a text's frequent keys are cut in so many parts by the key's hash, so that a line looks through one of them.
PARTS = 256


def lines_of(text: Column) -> Column:
    """Lines cut at \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def _hashes(text: Column, min_chars: int) -> Column:
    """Distinct key hashes of a text, without keys shorter than min_chars."""
    keys = F.transform(lines_of(ascii_lower(text)), lambda x: F.btrim(x, F.lit(SPACES)))
    if min_chars > 0:
        keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


RUNS = "kind string, level int, path string"


class LineRuns:
    """The levelled runs. add() takes one batch of documents; sealed() gives the frequent keys after all of them.

    A run is (kind, level, path): `raw` as counted, `merged` with the keys that reached the bound still in it (they are
    left out when it is read), `sealed` with those keys alone. write() stores the list, from which open() goes on, in the
    same or in another job.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be at least 1 and fanout at least 2")
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.runs: list[tuple[str, int, str]] = []

    def write(self, path: str) -> None:
        self.spark.createDataFrame(self.runs, RUNS).coalesce(1).write.parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: int) -> LineRuns:
        out = cls(spark, **options)
        out.runs = sorted(tuple(r) for r in spark.read.schema(RUNS).parquet(path).collect())
        return out

    def read(self, run: tuple[str, int, str]) -> DataFrame:
        kind, _, path = run
        if kind == "sealed":
            return self.spark.read.schema("h long").parquet(path)
        rows = self.spark.read.schema("h long, n long").parquet(path)
        return rows.where(F.col("n") < self.min_docs) if kind == "merged" else rows

    def all_of(self, runs: list[tuple[str, int, str]], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for run in runs:
            out = out.unionByName(self.read(run))
        return out

    def frequent(self) -> DataFrame:
        return self.all_of([r for r in self.runs if r[0] == "sealed"], "h long")

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Counts a batch's keys but the sealed ones (a merge anti join on the hash) as a run of level 0, and compacts what is due."""
        counted = docs.select(F.explode(_hashes(F.col(text), self.min_chars)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        if any(r[0] == "sealed" for r in self.runs):
            counted = counted.join(self.frequent().hint("merge"), "h", "left_anti")
        self.runs.append(("raw", 0, stored(counted.sortWithinPartitions("h"), "line-run")))
        level = 0
        while len(own := [r for r in self.runs if r[0] != "sealed" and r[1] == level]) >= self.fanout:
            self._merge(own, level + 1)
            level += 1

    def _merge(self, runs: list[tuple[str, int, str]], level: int) -> None:
        """One sorted run of several; keys that reach the bound go to a sealed run."""
        merged = self.all_of(runs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h")
        run = ("merged", level, stored(merged, "line-run"))
        sealed = self.spark.read.schema("h long, n long").parquet(run[2]).where(F.col("n") >= self.min_docs).select("h")
        self.runs = [r for r in self.runs if r not in runs] + [run, ("sealed", level, stored(sealed, "line-sealed"))]

    def sealed(self) -> DataFrame:
        """Keys found in at least min_docs documents of all batches. Runs that are left are compacted for that."""
        left = [r for r in self.runs if r[0] != "sealed"]
        if left and (len(left) > 1 or left[0][0] == "raw"):
            self._merge(left, max(r[1] for r in left) + 1)
        return self.frequent()


def batches_of(docs: DataFrame, first_bytes: int = 1 << 17, growth: int = 8) -> list[DataFrame]:
    """docs, if it is a plain scan of files, in batches of first_bytes, growth times as much, and so on, in the files' order; else docs as one batch.

    Bounds are bytes of the files, and fall between any two rows of a file: a row lies at its share of its file. Batches grow so
    that the most frequent keys are sealed early, on little data, and later batches count the others only, while
    there are but log(size) batches. A file is read by the batches that hold some of its rows.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.children().size() or not docs.inputFiles():
        return [docs]
    meta = docs.metadataColumn("_metadata")
    files = docs.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["row_index"].alias("row")).groupBy("path").agg(F.max("size").alias("size"), (F.max("row") + 1).alias("rows")).orderBy("path").collect()
    batches: list[list[tuple[str, int, int, int]]] = [[]]  # (path, first row, row behind the last, rows of the file)
    room, bound = float(first_bytes), first_bytes
    for path, size, rows in files:
        low = 0
        while low < rows:
            high = min(rows, max(low + 1, low + int(room * rows / size)))
            batches[-1].append((path, low, high, rows))
            room -= (high - low) * size / rows
            low = high
            if room * rows < size:
                bound *= growth
                room = float(bound)
                batches.append([])
    return [_part(docs, b) for b in batches if b] or [docs]


def _part(docs: DataFrame, segments: list[tuple[str, int, int, int]]) -> DataFrame:
    """The rows of docs in segments; at most the first and the last of them are parts of a file."""
    rows = docs.sparkSession.read.schema(docs.schema).parquet(*[s[0] for s in segments])
    meta, keep = rows.metadataColumn("_metadata"), F.lit(True)
    for path, low, high, n in segments:
        if (low, high) != (0, n):
            keep = keep & ((meta["file_path"] != path) | ((meta["row_index"] >= low) & (meta["row_index"] < high)))
    return rows.where(keep)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, fanout: int = 2, text: str = "text", batches: list[DataFrame] | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """All columns of docs, with text rebuilt from the lines that stay, plus _n_lines and _n_dropped.

    A line goes, in every document, if its key has at least min_chars code points and is found in at
    least min_docs documents (rows). A null or empty text is one empty line and gives an empty text.
    Rows with a null or repeated key are kept as they are and judged alike. An empty table gives an
    empty table. Other columns pass through whatever their names, but for _n_lines and _n_dropped,
    which are replaced. batches hold the rows of docs in parts; without them docs is cut by bytes if it is a plain scan.

    Texts find the frequent keys they hold by their hash, not by an id, so ids of any kind are no hot keys; two texts
    of one hash would only share keys that are frequent anyway. If these lists are at most broadcast_bytes they go to
    all and no text is shuffled; else they are joined, copies of a text being salted by the partition they are read in.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    for batch in batches or batches_of(docs):
        runs.add(batch, text)
    frequent = saved(runs.sealed(), "line-frequent")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.col(f"row.`{text}`")
    found = whole.select(F.xxhash64(body).alias("t"), F.explode(_hashes(body, min_chars)).alias("h"))
    lists = found.join(frequent, "h", "left_semi").groupBy("t").agg(F.collect_set("h").alias("all"))
    places = F.sequence(F.lit(0), F.lit(PARTS - 1))
    parted = F.when(F.size("all") > PARTS, F.transform(places, lambda p: F.filter("all", lambda h: F.pmod(h, F.lit(PARTS)) == p))).otherwise(F.array("all"))
    hits = saved(lists.select("t", parted.alias("hits")), "line-hits")
    size = hits.agg(F.sum(16 + 8 * F.size(F.flatten("hits")).cast("long"))).first()[0] or 0
    own = whole.withColumn("own", F.xxhash64(body))
    if size <= broadcast_bytes:
        joined = own.join(F.broadcast(hits), F.col("own") == F.col("t"), "left")
    else:
        copies = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = own.withColumn("own_salt", F.spark_partition_id() % SALTS)
        joined = dealt.join(copies, (F.col("own") == F.col("t")) & (F.col("own_salt") == F.col("salt")), "left")
    lines = joined.select("row", "hits", lines_of(body).alias("lines"))
    own_part = lambda h: F.get("hits", F.pmod(h, F.lit(PARTS)).cast("int"))
    hit = lambda x: F.when(F.size("hits") == 1, F.array_contains(F.get("hits", F.lit(0)), key_hash(ascii_lower(x)))).otherwise(F.array_contains(own_part(key_hash(ascii_lower(x))), key_hash(ascii_lower(x))))
    long_enough = lambda x: F.char_length(F.btrim(x, F.lit(SPACES))) >= min_chars
    kept = F.when(F.col("hits").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(long_enough(x) & hit(x))))
    out = lines.select("row", "lines", kept.alias("kept"))
    cols = [F.array_join("kept", "\n").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return out.select(*cols, F.size("lines").cast("long").alias("_n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("_n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least one code point found in ten or more documents go; digests per document."""
    docs = table(spark, sf_dir, "documents")
    out = drop_frequent_lines(docs.select("doc_id", "text"), batches=batches_of(docs))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT rid, doc_id, p, ls[p] AS line,
         translate(trim(ls[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM doc)),
frequent AS (SELECT k FROM line WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT line.*, frequent.k IS NOT NULL AS gone FROM line LEFT JOIN frequent USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
