"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group, in order, are the bottom of a tree of `fanout`
children a node (the last node of a level may have fewer); the groups' roots, in order, are the bottom of the tree
above. Nodes are bucketed by index // fanout^k: one applyInPandas task collapses k levels of a bucket to its root, the
roots are nodes of the next round, and after log(n) / (k log(fanout)) rounds one is left.

Proofs come on the way back: a bucket meets its root's proof, is collapsed again, and every node's siblings inside
the bucket are put before that proof. So a proof is never shuffled, only 32 bytes a node and one upper proof a bucket.
No step holds more than one bucket.

Indices are places in a range-partitioned, sorted and stored table: counts by partition and group shift them, so one
group that holds most rows is dealt over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dealt
from .common import saved, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Hex digest of the values in their order."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(nodes: Sequence[bytes]) -> bytes:
    """A node over others: their digests are hashed as lower-case hex text."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def collapsed(nodes: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """The nodes and the levels above them; a lone node is hashed as well."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(tree: list[list[bytes]], fanout: int, upper: bytes) -> list[bytes]:
    """Per bottom node: the digests of the others in its run, level by level, and then upper."""
    proofs = [upper] * len(tree[-1])
    for nodes in reversed(tree[:-1]):
        own = []
        for k in range(0, len(nodes), fanout):
            run, above = nodes[k : k + fanout], proofs[k // fanout]
            own += [b"".join(run[:i] + run[i + 1 :]) + above for i in range(len(run))]
        proofs = own
    return proofs


def _levels(n: int, fanout: int, k: int) -> int:
    """Levels that a bucket of a tree of n nodes collapses: k, or all there are in the last round."""
    return k if n > fanout**k else depth(n, fanout)


def indexed(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds i, gapless from 0 in each group by order (nulls first), and the group's n. group must not be null.

    The rows are stored sorted; ties, which are equal in `order`, take any order. nodes should be a stored table.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("_tie")).sortWithinPartitions(*by, "_tie")
    placed = saved(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(one.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved(counts.select("_g", "_p", "_first", before.alias("_before"), F.sum("_n").over(one).alias("n")), "merkle-starts")
    joined = placed.join(starts, (F.col(group) == F.col("_g")) & (part == F.col("_p")))
    return joined.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_g", "_p", "_first", "_before")


NODE = "grp string, i long, n long, node binary"


def _bucket(fanout: int, k: int) -> Column:
    return F.floor(F.col("i") / fanout**k).alias("bucket")


def reduced(nodes: DataFrame, fanout: int, k: int) -> list[DataFrame]:
    """The rounds of nodes (grp, i, n, node): the given ones, their buckets' roots, and so on until each group has one."""

    def roots(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        tree = collapsed(rows.sort_values("i")["node"].tolist(), fanout, _levels(n, fanout, k))
        return pd.DataFrame({"grp": [key[0]], "i": [key[1]], "n": [-(-n // fanout**k)], "node": [tree[-1][0]]})

    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while True:
        above = rounds[-1].select("grp", "i", "n", "node").groupBy("grp", _bucket(fanout, k)).applyInPandas(roots, NODE)
        rounds.append(saved(above, "merkle-roots"))
        most = -(-most // fanout**k)
        if most <= 1:
            return rounds


def proven(nodes: DataFrame, uppers: DataFrame, fanout: int, k: int, kept: Sequence[str] = ()) -> DataFrame:
    """(grp, i, n, node, kept, proof, subroot, root) of nodes, given those of their buckets' roots (uppers)."""
    cols = ["grp", "i", "n", "node", *kept]
    kinds = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in cols]

    def under(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, above = rows.select(cols).sort_by("i"), upper.to_pylist()[0]
        tree = collapsed(rows["node"].to_pylist(), fanout, _levels(rows["n"][0].as_py(), fanout, k))
        rows = rows.append_column("proof", pa.array(siblings(tree, fanout, above["proof"]), pa.binary()))
        for c in ("subroot", "root"):
            rows = rows.append_column(c, pa.array([above[c]] * len(rows), pa.binary()))
        return rows

    left = nodes.select(*cols).groupBy("grp", _bucket(fanout, k))
    right = uppers.select("grp", F.col("i").alias("bucket"), "proof", "subroot", "root").groupBy("grp", "bucket")
    return left.cogroup(right).applyInArrow(under, ", ".join([*kinds, "proof binary, subroot binary, root binary"]))


def climbed(nodes: DataFrame, uppers: DataFrame | None, fanout: int, k: int, rounds: list[DataFrame], kept: Sequence[str] = ()) -> DataFrame:
    """Proofs of the bottom round, going down from the last; uppers are those of the groups' roots, None at the top of all."""
    if uppers is None:
        uppers = rounds[-1].select("grp", "i", F.lit(b"").alias("proof"), F.lit(b"").alias("subroot"), F.col("node").alias("root"))
    for k_th in range(len(rounds) - 2, 0, -1):
        uppers = saved(proven(rounds[k_th], uppers, fanout, k), "merkle-proofs")
    return proven(nodes, uppers, fanout, k, kept)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2, k: int = 10, kept: dict[str, Column] | None = None) -> DataFrame:
    """One row per document row: `order`, `group`, leaf, subroot, root (hex), proof (binary: the siblings' digests from the
    leaf's level to the root) and place and size of the leaf in its group (i, n) and of the group among all (group_i, group_n),
    with which verified_root folds the proof. kept are further expressions over docs' columns.

    Leaves ascend by `order`, nulls first, then by digest; equal rows are leaves of their own and their order is free. A null
    group is a group, the first. Null values differ from empty ones. A lone leaf is its group's subroot, a lone group's subroot
    the root, an empty table gives no rows. Columns that are not named take no part, whatever their names.
    """
    if fanout < 2 or k < 1:
        raise ValueError("fanout must be at least 2 and k at least 1")
    more = kept or {}
    col = lambda c: F.col(f"`{c}`")
    own = docs.select(F.when(col(group).isNull(), "").otherwise(F.concat(F.lit("="), col(group).cast("string"))).alias("grp"), col(order).alias("_order"), F.unhex(leaf([col(f) for f in fields])).alias("node"), *[c.alias(f"_{n}") for n, c in more.items()])
    names = ["_order", *[f"_{n}" for n in more]]
    leaves = indexed(saved(own, "merkle-rows"), "grp", ["_order", "node"])
    rounds = reduced(leaves, fanout, k)
    tops = indexed(rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("_name"), "node"), "grp", ["_name"])
    top_rounds = reduced(tops, fanout, k)
    groups = saved(climbed(tops, None, fanout, k, top_rounds, ["_name"]), "merkle-groups")
    uppers = groups.select(F.col("_name").alias("grp"), F.lit(0).cast("long").alias("i"), "proof", F.col("node").alias("subroot"), "root")
    rows = climbed(leaves, uppers, fanout, k, rounds, names)
    sizes = groups.select(F.col("_name").alias("grp"), F.col("i").alias("group_i"), F.col("n").alias("group_n"))
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return rows.join(sizes, "grp").select(
        F.col("_order").alias(order), F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group), hexed("node", "leaf"), hexed("subroot", "subroot"), hexed("root", "root"),
        "proof", "i", "n", "group_i", "group_n", *[F.col(f"_{n}").alias(n) for n in more],
    )


def path(i: Column, n: Column, fanout: int = 2) -> Column:
    """Of a node of n: (place, size) of its run, level by level until one node is left."""
    state = F.struct(i.alias("i"), n.alias("n"), F.array().cast("array<struct<place:long,size:long>>").alias("out"))
    #: As many levels as a table of 2^53 rows has; the steps past the root add nothing.
    levels = depth(1 << 53, fanout)

    def step(at: Column, _: Column) -> Column:
        place = at["i"] % fanout
        run = F.struct(place.alias("place"), F.least(F.lit(fanout).cast("long"), at["n"] - (at["i"] - place)).alias("size"))
        up = F.struct(F.floor(at["i"] / fanout).alias("i"), F.ceil(at["n"] / fanout).alias("n"), F.concat(at["out"], F.array(run)).alias("out"))
        return F.when(at["n"] > 1, up).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state, step, lambda at: at["out"])


def verified_root(own: Column, proof: Column, i: Column, n: Column, group_i: Column, group_n: Column, fanout: int = 2) -> Column:
    """The root (hex) that a leaf (hex) and its proof lead to; the leaf is proven if that is the known root."""
    zero = F.struct(own.alias("node"), F.lit(1).cast("long").alias("at"))

    def step(acc: Column, run: Column) -> Column:
        part = lambda first, count: F.lower(F.hex(F.substring(proof, (acc["at"] + 32 * first).cast("int"), (32 * count).cast("int"))))
        node = F.sha2(F.concat(part(F.lit(0), run["place"]), acc["node"], part(run["place"], run["size"] - 1 - run["place"])), 256)
        return F.struct(node.alias("node"), (acc["at"] + 32 * (run["size"] - 1)).alias("at"))

    return F.aggregate(F.concat(path(i, n, fanout), path(group_i, group_n, fanout)), zero, step, lambda acc: acc["node"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; where 7 divides the crc32 of the id, n_chars is tampered with and the proof has to fail.

    A null id has no decimal form and is not tampered with.
    """
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    rows = manifest(dealt(table(spark, sf_dir, "documents")), kept={"altered": altered})
    folded = verified_root(F.coalesce("altered", "leaf"), F.col("proof"), F.col("i"), F.col("n"), F.col("group_i"), F.col("group_n"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 by bits: a byte is XORed in, then eight shifts (-1) follow.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256({})"
_PLAIN_LEAF = _LEAF.format(" || ".join(_FIELD.format(f) for f in FIELDS))
_OTHER_LEAF = _LEAF.format(" || ".join(_FIELD.format("(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS))

OP11_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_PLAIN_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_OTHER_LEAF} ELSE {_PLAIN_LEAF} END AS used FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
low AS (
  SELECT 0 AS l, g, i, n, leaf AS node FROM ranked
  UNION ALL SELECT l + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, g, i // 2, n),
sub AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, i, n, subroot AS node FROM sub
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 2, n),
root AS (SELECT node AS root FROM high WHERE n = 1),
fold AS (
  SELECT doc_id, leaf, r.g, s.subroot, r.i, r.n, s.i AS gi, s.n AS gn, 0 AS l, false AS up, used AS node, ''::VARCHAR AS proof FROM ranked r JOIN sub s ON r.g = s.g
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.subroot,
    CASE WHEN up OR f.n > 1 THEN f.i // 2 ELSE gi END, CASE WHEN up OR f.n > 1 THEN (f.n + 1) // 2 ELSE gn END, gi, gn, CASE WHEN up OR f.n > 1 THEN f.l + 1 ELSE 0 END, up OR f.n = 1,
    CASE WHEN NOT up AND f.n = 1 THEN f.node ELSE sha256(CASE WHEN f.i % 2 = 1 THEN coalesce(a.node, b.node, '') || f.node ELSE f.node || coalesce(a.node, b.node, '') END) END,
    f.proof || CASE WHEN NOT up AND f.n = 1 THEN '' ELSE coalesce(a.node, b.node, '') END
  FROM fold f LEFT JOIN low a ON NOT up AND f.n > 1 AND a.l = f.l AND a.g = f.g AND a.i = xor(f.i, 1) LEFT JOIN high b ON up AND b.l = f.l AND b.i = xor(f.i, 1) WHERE NOT (up AND f.n = 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM fold, root WHERE up AND n = 1
"""
