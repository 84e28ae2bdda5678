"""Loading, uniting, cutting and splitting datasets. A dataset is a DataFrame with a `split` column and an `ord` that orders its rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from importlib import import_module

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType
from pyspark.sql.window import Window

from ..functions.rng import uniform
from ..storage import saved, shared_folder
from .specs import BASE_ENV, name_matches, resolve_path, split_specs

#: Named readers: (spark, path, options without split limits) -> DataFrame with split and ord.
Reader = Callable[[SparkSession, str, dict], DataFrame]


def read_auto(spark: SparkSession, path: str, config: str | None = None, fmt: str | None = None, schema: str | StructType | None = None) -> DataFrame:
    """Scans Parquet, JSON, CSV, ORC or text by the path's ending or fmt; config is a subfolder. Filters and columns reach the scan.

    A declared schema spares CSV and JSON a look at the data; without one it is found in the first file alone, by path, and holds for
    all. CSV has a header.
    """
    where = f"{path}/{config}" if config else path
    kind = fmt or next((k for k in ("json", "csv", "orc", "parquet", "txt", "text") if where.rstrip("/").split("?")[0].endswith(k)), "parquet")
    if kind in ("txt", "text"):
        return spark.read.text(where)
    if kind in ("csv", "json"):
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        if schema is None:
            first = min(spark.read.text(where).inputFiles(), default=where)
            schema = (reader.option("inferSchema", True) if kind == "csv" else reader).format(kind).load(first).schema
        return reader.format(kind).schema(schema).load(where)
    return (spark.read.schema(schema) if schema else spark.read).format(kind).load(where)


#: Up to so many files their places go to all tasks.
MANY_FILES = 200_000


def in_file_order(scan: DataFrame) -> DataFrame:
    """A bare scan with `ord`: rows counted from 0 through the files, by their paths, and down each file.

    A file's rows are counted from its footer (or block by block, where a format has no row index) and shifted by those of the files
    before it. No row is moved, and neither cores nor split sizes change the numbers.
    """
    meta = scan.metadataColumn("_metadata")
    indexed = "row_index" in {f.name for f in scan.select(meta.alias("m")).schema["m"].dataType.fields}
    rows = scan.withColumns({"_path": meta["file_path"], "_block": F.lit(0).cast("long") if indexed else meta["file_block_start"], "_row": meta["row_index"] if indexed else F.monotonically_increasing_id()})
    blocks = rows.groupBy("_path", "_block").agg(F.min("_row").alias("_low"), (F.max("_row") + 1).alias("_high"))
    low = F.lit(0).cast("long") if indexed else F.col("_low")
    order = Window.orderBy("_path", "_block")  # a row a file or block
    before = F.sum(F.col("_high") - low).over(order) - (F.col("_high") - low)
    shifts = saved(blocks.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), (before - low).alias("_shift")), "file-order")
    few = shifts.count() <= MANY_FILES
    joined = rows.join(F.broadcast(shifts) if few else shifts, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("ord", F.col("_row") + F.col("_shift")).drop("_path", "_block", "_row", "_p", "_b", "_shift")


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """df with `name`, gapless from 0 in that order; rows that are equal in it come by their hash.

    The rows are dealt by ranges, sorted and stored; a row's place is its own in its range, shifted by the ranges before. So
    one value that most rows share is dealt over many tasks. Twice as much as df is stored in the shared folder.
    """
    rows = saved(df, "unranked")
    last = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_tie")]
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.col(c) if isinstance(c, str) else c for c in order], *last]
    placed = saved(sorted_.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_p")).withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_at", "_p", "_before")


def with_split(df: DataFrame, split: str = "train", ord_: Column | None = None) -> DataFrame:
    """A bare dataset as the split dictionary's form."""
    out = df if "split" in df.columns else df.withColumn("split", F.lit(split))
    return out.withColumn("ord", ord_) if ord_ is not None else out


def rename_splits(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    out = F.col("split")
    for old, new in names.items():
        out = F.when(F.col("split") == old, F.lit(new)).otherwise(out)
    return df.withColumn("split", out)


def concat(parts: Sequence[DataFrame | None]) -> DataFrame:
    """UNION ALL in order; `source_ord` is the part's place. The same frame twice counts once, None is left out; nothing at all raises."""
    kept: list[DataFrame] = []
    for part in parts:
        if part is not None and all(part is not k for k in kept):
            kept.append(part)
    if not kept:
        raise ValueError("nothing to concatenate")
    marked = [p.withColumn("source_ord", F.lit(k)) for k, p in enumerate(kept)]
    out = marked[0]
    for part in marked[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def merge(parts: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Split dictionaries: all names, united where several have one."""
    if not parts:
        raise ValueError("nothing to merge")
    names = dict.fromkeys(n for p in parts for n in p)
    return {n: concat([p.get(n) for p in parts]) for n in names}


#: Up to so many rows a top-n is gathered in one task.
MANY = 100_000


def head(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first n rows by order, at most all; None keeps everything. Nulls come first.

    A large n by a number is a filter: values are counted in ranges, and in the boundary's range one by one. Else a top-n.
    """
    if n is None:
        return df
    kind = df.schema[order].dataType
    if n <= MANY or not isinstance(kind, NumericType):
        return df.orderBy(order).limit(max(0, n))
    low, high, known, total = df.agg(F.min(order), F.max(order), F.count(order), F.count(F.lit(1))).first()
    if total <= n:
        return df
    blank = df.where(F.col(order).isNull())
    if n <= total - known:
        return blank.limit(n)
    rows, want, df = blank, n - (total - known), df.where(F.col(order).isNotNull())
    x = F.col(order)
    bucket = F.floor((x - F.lit(low)).cast("double") / (float(high - low) or 1.0) * 65535)
    counts = sorted((r["b"], r["n"]) for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    edge, below = _boundary(counts, want)
    groups = df.where(bucket == edge).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    at = _reaching(groups, ["x"], want - below)
    last, take = F.lit(at["x"]).cast(kind), want - below - at["upto"] + at["n"]
    if take == at["n"]:
        return rows.unionByName(df.where(x <= last))
    return rows.unionByName(df.where(x < last)).unionByName(df.where(x == last).limit(take))


def _boundary(counts: list[tuple[int, int]], want: int) -> tuple[int, int]:
    """(bucket in which the rows counted reach want, rows below it)."""
    below = 0
    for b, n in counts:
        if below + n >= want:
            return b, below
        below += n
    return counts[-1][0], below - counts[-1][1]


def _reaching(groups: DataFrame, order: list[str], want: int) -> Row:
    """The group of (..., n), by order, at which the running sum `upto` reaches want. Groups are those of one bucket."""
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("upto", upto).where(F.col("upto") >= want).orderBy("upto").first()


def limit_splits(df: DataFrame, limits: Mapping[str, int], order: str = "ord") -> DataFrame:
    """Head of each named split. With one source split, each name is a head of the same rows, so splits overlap; unnamed splits go.

    With several source splits, limits cut those they name and the others stay.
    """
    if not limits:
        return df
    names = [r[0] for r in df.select("split").distinct().limit(2).collect()]
    if len(names) == 1:
        parts = [head(df, n, order).withColumn("split", F.lit(k)) for k, n in limits.items()]
    else:
        parts = [head(df.where(F.col("split") == k), n, order) for k, n in limits.items()]
        parts.append(df.where(~F.col("split").isin(*limits)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def limit_stream_splits(df: DataFrame, limits: Mapping[str, int], order: str = "ord") -> DataFrame:
    """Disjoint: the first `test` rows are test, the next `train` rows train. Several source splits need names; unnamed ones go."""
    names = [r[0] for r in df.select("split").distinct().limit(2).collect()]
    if len(names) == 1 and {"train", "test"} <= limits.keys():
        n_test, n_train = limits["test"], limits["train"]
        if n_test + n_train <= MANY:
            test, train = head(df, n_test, order), df.orderBy(order).offset(n_test).limit(n_train)
            return test.withColumn("split", F.lit("test")).unionByName(train.withColumn("split", F.lit("train")))
        placed = ranked(head(df, n_test + n_train, order), [order], "_place")
        return placed.withColumn("split", F.when(F.col("_place") < n_test, "test").otherwise("train")).drop("_place")
    parts = [head(df if len(names) == 1 else df.where(F.col("split") == k), n, order).withColumn("split", F.lit(k)) for k, n in limits.items()]
    if not parts:
        raise ValueError("limits need split names")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hash_split(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """`split` test for exactly ceil(share n) rows of least hash, else train; the order is (hash, key, hash of the whole row), null keys first.

    Rows are counted per 16-bit bucket of the hash; only the boundary's bucket is looked at closer. Keys may repeat: rows
    of one key are told apart by their content, and of equal rows at the boundary so many copies as are
    needed become test. A row is compared with the boundary, so nothing is joined.
    """
    k = F.col(f"`{key}`")
    u = uniform(F.coalesce(k.cast("string"), F.lit("")), seed)
    bucket, row = F.floor(u * 65536), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    counts = sorted((r["b"], r["n"]) for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    want = -int(-share * sum(n for _, n in counts) // 1)
    if not want:
        return df.withColumn("split", F.lit("train"))
    edge, below = _boundary(counts, want)
    groups = df.where(bucket == edge).groupBy(u.alias("u"), k.alias("k"), row.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    at = _reaching(groups, ["u", "k", "h"], want - below)
    own = F.lit(at["k"]).cast(df.schema[key].dataType)
    lesser = F.lit(False) if at["k"] is None else F.coalesce(k < own, F.lit(True))
    same = (u == at["u"]) & k.eqNullSafe(own) & (row == at["h"])
    less = (u < at["u"]) | ((u == at["u"]) & (lesser | (k.eqNullSafe(own) & (row < at["h"]))))
    take = want - below - at["upto"] + at["n"]
    if take == at["n"]:
        return df.withColumn("split", F.when(less | same, "test").otherwise("train"))
    rest = df.where(~same).withColumn("split", F.when(less, "test").otherwise("train"))
    one = F.broadcast(df.where(same).limit(1).withColumn("_one", F.lit(1)))
    copies = df.sparkSession.range(at["n"]).select(F.col("id").alias("_copy"), F.lit(1).alias("_one")).join(one, "_one").drop("_one")
    return rest.unionByName(copies.withColumn("split", F.when(F.col("_copy") < take, "test").otherwise("train")).drop("_copy"))


def shuffled(df: DataFrame, key: str, seed: int = 42, buffer: int | None = None) -> DataFrame:
    """Adds `shuffle_key`, by which rows come in a seeded random order; within `ord div buffer` windows if a buffer is given."""
    u = uniform(F.col(key), seed)
    return df.withColumn("shuffle_key", u if buffer is None else F.floor(F.col("ord") / buffer) + u)


def repeated(df: DataFrame, epochs: int, split: str = "train") -> DataFrame:
    """Rows of the split once per epoch, others in epoch 0: the bounded form of repeating forever."""
    n = F.when(F.col("split") == split, F.lit(epochs)).otherwise(F.lit(1))
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1)))


def batch_of(ord_: Column, size: int) -> Column:
    """Number of the fixed-size batch."""
    return F.floor(ord_ / size)


def length_batches(df: DataFrame, length: str, key: str, n: int) -> DataFrame:
    """`batch` from 0: n ranges of equal row counts by (length, key), so that batches hold like lengths; earlier ones get the rest."""
    rows = ranked(df, [length, key], "_rank")
    total = rows.count()
    each, rest = divmod(total, n)
    longer = rest * (each + 1)
    batch = F.when(F.col("_rank") < longer, F.floor(F.col("_rank") / (each + 1))).otherwise(rest + F.floor((F.col("_rank") - longer) / max(each, 1)))
    return rows.withColumn("batch", batch.cast("int")).select(*df.columns, "batch")


def length_grouped(df: DataFrame, length: str, key: str, batch: int, seed: int | str = 42, megabatches: int | None = None) -> DataFrame:
    """Adds `place`: the rows in an order for training in which neighbours have like lengths.

    A seeded permutation of the rows is cut into megabatches of `megabatches` batches (by default 50, or as many as make four of them,
    at least one); within each the longest come first, equal ones as in the permutation; and the longest row of all is
    swapped to the very first place. key tells rows apart.
    """
    rows = ranked(df, [uniform(F.col(key), seed), key], "_rank")
    total = rows.count()
    size = batch * (megabatches or max(1, min(50, total // (4 * batch))))
    mega = F.floor(F.col("_rank") / size)
    own = Window.partitionBy(mega).orderBy(F.desc(length), F.asc("_rank"))
    placed = rows.withColumn("place", mega * size + F.row_number().over(own) - 1)
    heads = placed.where(F.col("place") % size == 0)  # the first of each megabatch
    top = heads.agg(F.min_by("place", F.struct(-F.col(length), F.col("place"))).alias("top")).first()["top"] or 0
    swapped = F.when(F.col("place") == 0, top).when(F.col("place") == top, 0).otherwise(F.col("place"))
    return placed.withColumn("place", swapped).drop("_rank")


def load(spark: SparkSession, specs: str, readers: Mapping[str, Reader], streaming: bool = False, preprocessed: bool = False) -> DataFrame:
    """Loads every part of a specification, cuts it by its split limits and unites all in order.

    A relative path may lie below the folder in BASE_ENV. The reader is the one whose name the part's name matches. Keys `name`, `lang` and `config` are the reader's;
    the remaining ones are split limits. preprocessed reads columnar data as saved.
    """
    parts = []
    for name, options in split_specs(specs):
        if name is None:
            raise ValueError("a dataset needs a name")
        name = resolve_path(name, BASE_ENV)
        own = {k: options.pop(k) for k in ("name", "lang", "config") if k in options}
        found = None if preprocessed else next((r for k, r in readers.items() if name_matches(name, k)), None)
        if found is None and not preprocessed:
            raise ValueError(f"no reader for {name!r}")
        df = with_split(spark.read.parquet(name)) if preprocessed else found(spark, name, own)
        parts.append((limit_stream_splits if streaming and options else limit_splits)(df, options))
    return concat(parts)


def load_texts(spark: SparkSession, specs: str, readers: Mapping[str, Reader], streaming: bool = True, preprocessed: bool = False, position: str | None = None, rows: int = 100_000) -> DataFrame:
    """The pretraining loader: as load, but a name that no reader knows is a dataset of files (`name` is its config).

    Streaming cuts by disjoint rows, test first. With position, a file of the stream's own, train is repeated for ever: the cut
    rows are stored once, in order, and come as a stream of `rows` a trigger with their epoch; other splits are left out
    of it and loaded without position.
    """
    known = {k: r for k, r in readers.items() if any(name_matches(name or "", k) for name, _ in split_specs(specs))}
    out = load(spark, specs, {**known, "": lambda s, path, own: with_split(in_file_order(read_auto(s, path, own.get("name"))))}, streaming, preprocessed)
    if position is None:
        return out
    from ..streaming.epochs import repeat

    train = out.where("split = 'train'").drop("split")
    path = shared_folder(spark, "train")
    by = ["source_ord", "ord"]
    train.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema if f.name not in ("ord", "epoch", "stream_ord")]
    return repeat(spark, path, ", ".join([*fields, "epoch long", "stream_ord long"]), position, rows)


def all_configs(spark: SparkSession, configs: Sequence[str], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Every named config, united; none raises."""
    if not configs:
        raise ValueError("no configurations")
    return concat([read(spark, c) for c in configs])


KEEP_SFT = ("input_ids", "labels", "prompt_len", "attention_mask")
KEEP_PT = ("input_ids", "labels")


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of names that there are, and the split."""
    return df.select(*[c for c in (*names, "split") if c in df.columns])


def write_sft(df: DataFrame, path: str) -> None:
    keep_columns(df, KEEP_SFT).write.partitionBy("split").mode("overwrite").parquet(path)


def write_pt(df: DataFrame, folder: str, max_length: int, insert_eos: bool, drop_tail: bool) -> str:
    """The path names the options."""
    #: Fixed form of the folder's name.
    path = f"{folder}/max_length-{max_length}-insert_eos-{insert_eos}-drop_tail-{drop_tail}"
    keep_columns(df, KEEP_PT).write.partitionBy("split").mode("overwrite").parquet(path)
    return path


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str) -> Callable:
    """Registers a named map; use(name) finds it."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TRANSFORMS[name] = f
        return f

    return put


def use(name: str, **bound: object) -> Callable[[DataFrame], DataFrame]:
    """The registered map of this name, or the function at a dotted path, with its options bound."""
    if name in TRANSFORMS:
        found = TRANSFORMS[name]
    elif "." in name:
        module, _, own = name.rpartition(".")
        found = getattr(import_module(module), own)
    else:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(sorted(TRANSFORMS))}")
    return lambda df: found(df, **bound)


def cluster_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(tok, cluster) from JSON objects {token id: cluster id}: one a file or, with lines, one a line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,int>").alias("m"))
    return raw.select(F.explode("m").alias("tok", "cluster")).select(F.col("tok").cast("int"), "cluster")
