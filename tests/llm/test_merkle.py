"""The Merkle manifest against a plain tree, over shapes, fanouts and odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes, fanout):
    """All levels of a tree, by the rule as it is written."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def others(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        out += [n for k, n in enumerate(nodes[first : first + fanout], first) if k != i]
        i //= fanout
    return out


def plain(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof hex)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in names}
    top = up([trees[g][-1][0] for g in names], fanout)
    out = []
    for at, g in enumerate(names):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            out.append((repr(x[2]), x[1], trees[g][-1][0], top[-1][0], "".join(others(trees[g], i, fanout) + others(top, at, fanout))))
    return sorted(out)


def found(docs, **options):
    rows = merkle.manifest(docs, **options)
    root = merkle.verified_root(F.col("leaf"), F.col("proof"), F.col("i"), F.col("n"), F.col("group_i"), F.col("group_n"), options.get("fanout", 2))
    rows = rows.withColumn("back", root).collect()
    assert all(r["back"] == r["root"] for r in rows)
    return sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in rows)


def some(n, lang):
    return [(3 * k, f"s{k % 3}", lang, k if k % 4 else None, f"tëxt {k}\n" * (k % 3)) for k in range(n)]


@pytest.mark.parametrize(("fanout", "k"), [(2, 1), (2, 3), (3, 2), (5, 1), (2, 10)])
def test_trees_of_all_shapes(spark, fanout, k):
    rows = some(41, "en") + some(1, "de") + some(16, "fr") + some(9, None) + some(2, "") + some(5, "é")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, fanout=fanout, k=k) == plain(rows, fanout)


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, long texts, clashing names, one lone leaf and no leaf at all."""
    rows = [(None, None, None, None, None), (None, "", "en", 0, ""), (7, "a", "en", 1, "x")] + [(7, "b", "en", 2, "x")] * 5 + [(2**60 + 1, "c", "en", 3, "word " * 400_000), (-5, "d", "en", 4, "-")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, k=2) == plain(rows, 2)
    extra = docs.withColumns({"i": F.lit("x"), "grp": F.lit(1), "node": F.lit(2), "_order": F.lit(3), "proof": F.lit(4)})
    assert found(extra, k=1) == plain(rows, 2)
    assert found(docs.where("doc_id = 2305"), k=2) == []
    assert found(docs.where("doc_id = -5")) == plain(rows[-1:], 2)


def test_many_groups(spark):
    """More groups than a bucket holds: the tree above the groups takes several rounds."""
    rows = [(k, "s", f"g{k % 37}", 1, "t") for k in range(100)]
    assert found(spark.createDataFrame(rows, SCHEMA), k=2) == plain(rows, 2)


def test_tampering_is_seen(spark):
    rows = spark.createDataFrame(some(30, "en"), SCHEMA)
    kept = {"other": F.sha2(F.lit("x"), 256)}
    out = merkle.manifest(rows, k=2, kept=kept)
    args = [F.col(c) for c in ("proof", "i", "n", "group_i", "group_n")]
    assert out.where(merkle.verified_root(F.col("other"), *args) == F.col("root")).count() == 0


def test_options():
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(None, fanout=1)
