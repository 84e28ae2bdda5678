"""Queries without SQL on whole texts."""

from seqloom.plans import registry
from tests.duck import connection

SF = "/root/testdata/sf0.001"


def test_align_blanks_takes_whole_texts(spark):
    clean = "regexp_replace({0}.text, '[^ -~]', '?', 'g')"
    a, b = clean.format("a"), clean.format("b")
    want = connection(SF).execute(f"SELECT a.item_id, {a}, {b}, levenshtein({a}, {b}) FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1").fetchall()
    text = lambda z: "".join(chr(c) for c in z if c >= 0)
    got = [(r["item_id"], text(r["z0"]), text(r["z1"]), r["cost"]) for r in registry.queries()["align_blanks"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(len(x[1]) for x in want) > 40
