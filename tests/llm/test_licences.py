"""The licence scan against its definition, tried at every start."""

import random
import re
from math import ceil, log

import pytest
from pyspark.sql import functions as F

from seqloom.llm import licences
from seqloom.llm.licences import BASE, NOTICES, Template

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, templates, rare=5, share=0.75):
    """Of each text (n words, matches): all starts of all templates, by the words' places alone."""
    split = [words(t) for t in texts]
    seen = [set(w) for w in split]
    idf = {w: 1 + log((len(texts) + 1) / (sum(w in s for s in seen) + 1)) for t in templates for w in words(t.notice)}
    out = []
    for text in split:
        found = []
        for t in templates:
            notice = words(t.notice)
            places = sorted(range(len(notice)), key=lambda j: (-idf[notice[j]], j))[: 1 if t.base else rare]
            keys = [(next(k for k in range(len(notice)) if notice[k : k + len(words(key))] == words(key)), words(key)) for key in t.keys]
            good = []
            for s in range(-len(notice) - t.slack, len(text)):
                near = lambda j: range(max(0, s + j), max(0, s + j + t.slack + 1))  # noqa: B023, E731
                voted = [j for j in places if any(p < len(text) and text[p] == notice[j] for p in near(j))]
                if len(voted) >= ceil(share * len(places)) and all(any(text[p : p + len(k)] == k for p in near(at)) for at, k in keys):
                    good.append((s, sum(idf[notice[j]] for j in voted) / sum(idf[notice[j]] for j in places)))
            groups = []
            for s, x in good:
                if groups and s - groups[-1][-1][0] <= t.slack:
                    groups[-1].append((s, x))
                else:
                    groups.append([(s, x)])
            for g in groups:
                most = max(x for _, x in g)
                found.append((t.label, max(s for s, x in g if x > most - 1e-9), round(most, 6), t.base))
        out.append((len(text), sorted(found)))
    return out


def found(spark, texts, templates, **options):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA)
    rows = sorted(licences.with_licences(docs, templates, **options).collect(), key=lambda r: r["row"]["doc_id"])
    return [(r["n_words"], sorted((m["label"], m["start"], round(m["score"], 6), m["base"]) for m in r["matches"])) for r in rows]


def noisy(rng):
    """Texts of the notices' words: whole, with words missing or added, cut off, shuffled; and phrases side by side."""
    fill = ["the", "work", "under", "by", "cc", "license", "general", "and", "é", "2"]
    for _ in range(60):
        out = []
        for _ in range(rng.randint(0, 4)):
            notice = re.findall(r"\S+", rng.choice([*NOTICES, *BASE]).notice)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(notice) + 1)
                notice[at : at + rng.randint(0, 1)] = [rng.choice(fill)] * rng.randint(0, 2)
            out += [rng.choice(fill) for _ in range(rng.randint(0, 3))] + notice[rng.choice([0, 0, 0, 2]) :]
        yield rng.choice([" ", "\n", " -- "]).join(out)


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_matches_are_those_of_the_definition(spark, monkeypatch, block):
    texts = [*noisy(random.Random(3)), None, "", "CC BY-cc by; All Rights\nReserved all rights reserved!", "by", "license"]
    templates = (*BASE, *NOTICES, Template("x", "a b a b a", ("a b",), 1), Template("y", "by by", ("by by",), 0, True))
    monkeypatch.setattr(licences, "BLOCK", block)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA)
    n, counts = licences.document_counts(docs, licences.vocabulary(templates))
    index = licences.Index(templates, n, counts)
    got = []
    for t in texts:
        codes = index.coded(t)
        got.append((len(codes), sorted((templates[k].label, s, round(x, 6), templates[k].base) for k, s, x in index.matches(codes))))
    assert got == plain(texts, templates)
    assert sum(len(m) for _, m in got) > 60


def test_rows(spark):
    texts = ["Licensed under CC BY-NC 4.0.", None, "", "Licensed under CC BY-NC 4.0.", "x " * 500_000 + "All rights reserved."]
    assert found(spark, texts[:4], (*BASE, *NOTICES)) == plain(texts[:4], (*BASE, *NOTICES))
    assert found(spark, texts, BASE)[4] == (500_003, [("reserved", 500_000, 1.0, True)])
    docs = spark.createDataFrame([(None, texts[0]), (1, texts[0]), (1, texts[0])], SCHEMA).withColumns({"matches": F.lit("mine"), "row": F.lit(1), "n_words": F.lit(2)})
    out = licences.with_licences(docs).collect()
    assert [r["row"]["matches"] for r in out] == ["mine"] * 3 and all({m["label"] for m in r["matches"]} == {"cc-by", "cc-by-nc"} for r in out)
    assert licences.with_licences(docs.where("doc_id > 9")).count() == 0
    with pytest.raises(ValueError, match="no phrase"):
        licences.Index([Template("x", "one two", ("three",))], 1, {})
    with pytest.raises(ValueError, match="must have words"):
        licences.Index([], 1, {})


def test_query_against_the_definition(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (n, matches) in zip(rows, plain([r["text"] for r in rows], (*BASE, *NOTICES)), strict=True):
        base = [m for m in matches if m[3]]
        starts = [m[1] for m in base]
        label = lambda found: ",".join(sorted({m[0] for m in found}))
        want[r["doc_id"]] = (n, len(base), min(starts, default=None), max(starts, default=None), label(base), label(matches), max((m[2] for m in matches), default=0.0))
    got = {r["doc_id"]: (*tuple(r)[1:-1], round(r["score"], 6)) for r in licences.op12_licence_index(spark, SF).collect()}
    assert got == want


def test_base_phrases_stand_where_a_plain_search_finds_them(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        text = words(r["text"])
        want[r["doc_id"]] = sorted((label, k) for p, label in licences.PHRASES for w in [words(p)] for k in range(len(text)) if text[k : k + len(w)] == w)
    got = licences.op12_licence_index(spark, sf).collect()
    assert {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {
        d: (len(m), min((k for _, k in m), default=None), max((k for _, k in m), default=None), ",".join(sorted({x for x, _ in m}))) for d, m in want.items()
    }
    assert sum(map(bool, want.values())) > 5
