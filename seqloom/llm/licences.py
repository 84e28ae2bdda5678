"""Licence scan by a positional index of rare words.

A template is a licence notice with mandatory key phrases. How rare a licence word is, is counted over all documents. Of
each template the `rare` places whose words are the rarest are indexed: a posting is (template, place). A file's licence
words are looked up there; a word at place p and a posting at place j put the template's start at p - j. Postings whose
starts agree within the template's slack are intersected: a start that at least `share` of the rare words vote for is kept
if every key phrase stands, whole, where that start puts it (up to slack words later).

A phrase that is its own key phrase, with no slack, is found at every place where it stands, since its rarest word is
always looked up. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z were lower-cased.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt
from .common import table
from .words import segments

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Starts that are voted on at once.
BLOCK = 1 << 17


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """A notice; its keys are phrases of it that must stand. With slack, words may be missing or added; base marks plain phrases."""

    label: str
    notice: str
    keys: tuple[str, ...]
    slack: int = 2
    base: bool = False


#: Fixed: the contract's phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE = tuple(Template(label, phrase, (phrase,), 0, True) for phrase, label in PHRASES)

#: Notices of public licences as they are commonly written, with what must stand in them.
NOTICES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("gnu-gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version")),
    Template("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl", "GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def phrase(text: str) -> list[bytes]:
    return words_of(text.encode())


def vocabulary(templates: Sequence[Template]) -> list[bytes]:
    return sorted({w for t in templates for w in phrase(t.notice)})


def document_counts(docs: DataFrame, vocab: Sequence[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each word of vocab). Summed in the workers first; what comes to the driver is one row a word."""
    wanted = frozenset(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for value in batch.column(0):
                seen: set[bytes] = set()
                for part in segments((value.as_py() or "").encode()):
                    seen |= wanted.intersection(words_of(part))
                found.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array([b"", *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    sums = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in sums.collect()}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, templates: Sequence[Template], documents: int, counts: dict[bytes, int], rare: int = 5, share: float = 0.75):
        if not templates or not all(phrase(t.notice) for t in templates):
            raise ValueError("templates must have words")
        self.templates = templates
        self.codes = {w: k for k, w in enumerate(vocabulary(templates))}
        idf = {w: 1 + log((documents + 1) / (counts.get(w, 0) + 1)) for w in self.codes}
        posts, self.rare, self.least, self.weights = [], [], [], np.zeros((len(templates), max(1, rare)))
        for t, template in enumerate(templates):
            words = phrase(template.notice)
            places = sorted(range(len(words)), key=lambda j: (-idf[words[j]], j))[: 1 if template.base else rare]
            total = sum(idf[words[j]] for j in places)
            self.rare.append(places)
            self.least.append(ceil(share * len(places)))
            for r, j in enumerate(places):
                posts.append((self.codes[words[j]], t, j, r))
                self.weights[t, r] = idf[words[j]] / total
        posts.sort()
        self.posts = np.array(posts, dtype=np.int64).reshape(-1, 4)
        self.first = np.searchsorted(self.posts[:, 0], np.arange(len(self.codes)))
        self.count = np.searchsorted(self.posts[:, 0], np.arange(len(self.codes)), "right") - self.first
        self.slack = np.array([t.slack for t in templates], dtype=np.int64)
        self.length = np.array([len(phrase(t.notice)) for t in templates], dtype=np.int64)
        self.keys = [[(at, [self.codes[w] for w in key]) for k in t.keys for at, key in [self._place(t, k)]] for t in templates]

    @staticmethod
    def _place(template: Template, key: str) -> tuple[int, list[bytes]]:
        words, part = phrase(template.notice), phrase(key)
        at = next((k for k in range(len(words) - len(part) + 1) if words[k : k + len(part)] == part), -1)
        if at < 0 or not part:
            raise ValueError(f"{key!r} is no phrase of {template.notice!r}")
        return at, part

    def coded(self, text: str | None) -> np.ndarray:
        """The text's words by their code; -1 for those of no template."""
        parts = []
        for part in segments((text or "").encode()):
            words = words_of(part)
            parts.append(np.fromiter((self.codes.get(w, -1) for w in words), np.int32, len(words)))
        return np.concatenate(parts)

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, start, score), score being the weight of the rare words found. Neighbouring starts, up to slack words apart, are one match: the best, then the last."""
        at = np.flatnonzero(codes >= 0)
        at = at[self.count[codes[at]] > 0]
        out, tests = [], {}
        far = int(self.length.max() + self.slack.max())
        for low in range(-far, len(codes), BLOCK):
            some = at[np.searchsorted(at, low) : np.searchsorted(at, low + BLOCK + far)]
            if len(some):
                out += self._block(codes, some, low, tests)
        return self._merged(out)

    def _block(self, codes: np.ndarray, at: np.ndarray, low: int, tests: dict) -> list[tuple[int, int, float]]:
        """Starts from low to low + BLOCK that qualify."""
        n = self.count[codes[at]]
        post = self.posts[self.first[codes[at]].repeat(n) + np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)]
        _, t, j, r = post.T
        n = self.slack[t] + 1
        later = np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)
        t, r, start = t.repeat(n), r.repeat(n), (at.repeat(self.count[codes[at]]) - j).repeat(n) - later
        own = (start >= low) & (start < low + BLOCK)
        width = self.weights.shape[1]
        votes = np.unique(((t[own] * BLOCK) + start[own] - low) * width + r[own])
        cell, first, n = np.unique(votes // width, return_index=True, return_counts=True)
        if not len(cell):
            return []
        t, start = cell // BLOCK, cell % BLOCK + low
        score = np.minimum(np.add.reduceat(self.weights[votes // width // BLOCK, votes % width], first), 1.0)
        good = n >= np.array(self.least)[t]
        out = []
        for k in np.unique(t[good]).tolist():
            mine = good & (t == k)
            s = start[mine]
            ok = np.ones(len(s), dtype=bool)
            for place, key in self.keys[k]:
                upto = tests.setdefault(tuple(key), None)
                if upto is None:
                    upto = tests[tuple(key)] = self._places(codes, key)
                a = np.clip(s + place, 0, len(codes))
                ok &= upto[np.clip(s + place + self.templates[k].slack + 1, 0, len(codes))] > upto[a]
            out += zip([k] * int(ok.sum()), s[ok].tolist(), score[mine][ok].tolist(), strict=True)
        return out

    @staticmethod
    def _places(codes: np.ndarray, key: list[int]) -> np.ndarray:
        """How many times the phrase begins before each place."""
        hit = np.zeros(len(codes), dtype=bool)
        n = len(codes) - len(key) + 1
        if n > 0:
            hit[:n] = True
            for k, code in enumerate(key):
                hit[:n] &= codes[k : k + n] == code
        return np.concatenate([[0], np.cumsum(hit)])

    def _merged(self, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        last = None
        for t, start, score in sorted(found):
            near = last is not None and last[0] == t and start - last[1] <= self.templates[t].slack
            if near and score >= out[-1][2] - 1e-12:
                out[-1] = (t, start, score)
            elif not near:
                out.append((t, start, score))
            last = (t, start)
        return out


MATCHES = "array<struct<label:string,start:long,length:long,score:double,base:boolean>>"


def with_licences(docs: DataFrame, templates: Sequence[Template] = (*BASE, *NOTICES), text: str = "text", rare: int = 5, share: float = 0.75) -> DataFrame:
    """docs' rows as `row` with n_words and matches (by template and start; start and length in words).

    A null or empty text has no words and no matches. Rows are judged alone, so null or repeated ids and equal texts do
    not matter, but every row counts for the words' rarity; equal rarity goes by place in the notice. Other columns stay in
    `row` whatever their names; an empty table stays empty. Long texts are cut into words in pieces and voted on in
    blocks of starts. Two passes over the texts, no shuffle but of the counts of licence words.
    """
    index = Index(templates, *document_counts(docs, vocabulary(templates), text), rare, share)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    entry = [("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for value in batch.column(0):
                codes = index.coded(value.as_py())
                sizes.append(len(codes))
                found.append([{"label": templates[t].label, "start": s, "length": int(index.length[t]), "score": x, "base": templates[t].base} for t, s, x in index.matches(codes)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.struct(entry)))], names=["row", "n_words", "matches"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, matches {MATCHES}")


def op12_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases and licences; score is the best match's, 0 without one."""
    rows = with_licences(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 9).alias("score"),
    )


def _listed(words: Sequence[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


_ALL = (*BASE, *NOTICES)
_TEMPLATES = ", ".join(f"({t}, '{x.label}', {x.base}, {x.slack}, {_listed(phrase(x.notice))})" for t, x in enumerate(_ALL))
_KEYS = ", ".join(f"({t}, {Index._place(x, k)[0]}, {_listed(phrase(k))})" for t, x in enumerate(_ALL) for k in x.keys)

OP12_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
template(t, label, base, slack, notice) AS (VALUES {_TEMPLATES}), key(t, place, words) AS (VALUES {_KEYS}),
own AS (SELECT t, base, slack, unnest(notice) AS word, generate_subscripts(notice, 1) - 1 AS j FROM template),
word AS (SELECT * FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM doc) WHERE word IN (SELECT word FROM own)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM word GROUP BY word),
idf AS (SELECT own.*, 1 + ln(((SELECT count(*) FROM doc) + 1) / (coalesce(n, 0) + 1)::DOUBLE) AS idf FROM own LEFT JOIN df USING (word)),
rare AS (SELECT *, idf / sum(idf) OVER (PARTITION BY t) AS weight, ceil(0.75 * count(*) OVER (PARTITION BY t)) AS least
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, j) AS r FROM idf) WHERE r <= CASE WHEN base THEN 1 ELSE 5 END),
vote AS (SELECT DISTINCT rid, t, slack, j, weight, least, s FROM (SELECT rid, t, slack, j, weight, least, unnest(range(p - j - slack, p - j + 1)) AS s FROM word JOIN rare USING (word))),
start AS (SELECT rid, t, slack, s, least(sum(weight), 1) AS score FROM vote GROUP BY rid, t, slack, s HAVING count(*) >= any_value(least)),
good AS (SELECT rid, t, s, any_value(score) AS score, any_value(slack) AS slack FROM (
    SELECT start.*, len(list_filter(range(slack + 1), lambda d: s + place + d >= 0 AND w[s + place + d + 1 : s + place + d + len(words)] = words)) > 0 AS stands
    FROM start JOIN key USING (t) JOIN doc USING (rid)) GROUP BY rid, t, s HAVING bool_and(stands)),
part AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY s) AS island FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY rid, t ORDER BY s) <= slack THEN 0 ELSE 1 END AS fresh FROM good)),
found AS (SELECT rid, t, island, max(score) AS score, max(s) FILTER (score >= top - 1e-12) AS s FROM (SELECT *, max(score) OVER (PARTITION BY rid, t, island) AS top FROM part) GROUP BY rid, t, island),
per AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found JOIN template USING (t) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score
FROM doc LEFT JOIN per USING (rid)
"""
