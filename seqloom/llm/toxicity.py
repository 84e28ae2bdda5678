"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

A unit of text is a word, a window of a very long word, a run of single characters taken as one word, or
such a word's letters alone, after a mark for its beginning. The kernel of two units compares their
3-character subsequences of span at most SPAN, weighted by DECAY to the power of the span, normalised and
squared, so gaps and inserted characters cost a little and not everything. A text's kernels with a landmark
are that of its best unit and the mean of its TOP best different units (units below FLOOR count as 0), so
text length does not matter. Landmarks are units of labelled texts or their beginnings: those that mark toxic
texts most, kept apart from each other, and common clean ones. The Nyström map of the kernel values goes into
a linear SVM (squared hinge loss, balanced classes), and its margin through a logistic curve into a score from 0 to 1.

Fitted on a bounded sample of labelled rows, at most `per_class` of each class, those of least id hash: on the
whole texts first, then also on the sentence of each toxic text that scores highest, so that one sentence
suffices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dealt
from .common import crc_mod, hash_fraction, least_share, saved, table
from .words import segments

SPAN, DECAY, FLOOR, LONGEST, TOP = 6, 0.7, 0.15, 16, 3
BEGIN = "^"
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SENTENCE = re.compile(rb"[.!?\n]+(?=\s|$)")
_OTHER = re.compile(r"[\W\d_]+")


def units(part: bytes) -> set[bytes]:
    """Units of at least 3 characters of lower-cased UTF-8 text."""
    found, single = set(), []
    for raw in part.split():
        word = raw.strip(_EDGES)
        if len(word) <= 1:
            single.append(word or raw[:1])
            continue
        if single:
            found.add(b"".join(single))
            single = []
        found.add(word)
    found.add(b"".join(single))
    return {w for w in found if len(w) >= 3}


def variants(unit: bytes) -> list[str]:
    """A unit as it is and as its letters alone, cut to windows of LONGEST characters."""
    text = unit.decode("utf-8", "replace").lower()
    forms = [text]
    if not text.isalpha():
        forms.append(_OTHER.sub("", text))
    out = []
    for form in dict.fromkeys(forms):
        if len(form) >= 3:
            out += [form[k : k + LONGEST] for k in range(0, max(1, len(form) - LONGEST // 2), LONGEST // 2)] if len(form) > LONGEST else [form]
    return [BEGIN + x for x in out if len(x) >= 3]


def codes(chars: np.ndarray) -> np.ndarray:
    """Characters as 1 to 63; 0 is no character."""
    return np.where(chars == 0, 0, np.where((chars >= 97) & (chars <= 122), chars - 96, 27 + chars % 37)).astype(np.int64)


def subsequences(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) per word and choice of 3 places within SPAN; 0 and 0 where a place is beyond the word."""
    chars = np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    c = codes(chars)
    picks = np.array([(i, j, k) for i, j, k in combinations(range(width), 3) if k - i < SPAN])
    real = c[:, picks[:, 2]] > 0
    code = np.where(real, c[:, picks[:, 0]] << 12 | c[:, picks[:, 1]] << 6 | c[:, picks[:, 2]], 0)
    return code, np.where(real, DECAY ** (picks[:, 2] - picks[:, 0] + 1.0), 0.0)


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernels of words with themselves; equal subsequences of a word add up first."""
    order = np.argsort(code, axis=1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    new = np.concatenate([np.ones((len(code), 1), dtype=bool), code[:, 1:] != code[:, :-1]], axis=1)
    sums = np.add.reduceat(weight.reshape(-1), np.flatnonzero(new.reshape(-1)))
    rows = np.repeat(np.arange(len(code)), code.shape[1])[new.reshape(-1)]
    return np.sqrt(np.maximum(np.bincount(rows, sums * sums, len(code)), 1e-12))


class Landmarks:
    """Kernel of any words with fixed landmarks."""

    def __init__(self, names: list[str]):
        self.names = names
        weights: dict[int, np.ndarray] = {}
        for k, name in enumerate(names):
            code, weight = subsequences([name], max(3, len(name)))
            norm = norms(code, weight)[0]
            for c, w in zip(code[0].tolist(), weight[0].tolist(), strict=True):
                if c:
                    weights.setdefault(c, np.zeros(len(names), dtype=np.float32))[k] += w / norm
        self.row = np.zeros(1 << 18, dtype=np.int32)
        self.rows = np.zeros((len(weights) + 1, len(names)), dtype=np.float32)
        for n, (c, w) in enumerate(weights.items(), 1):
            self.row[c], self.rows[n] = n, w

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.names)), dtype=np.float32)
        sizes = np.array([len(w) for w in words])
        low = 0
        for width in (5, 7, 9, 12, LONGEST + 1):
            for some in np.array_split(np.flatnonzero((sizes > low) & (sizes <= width)), 1 + len(words) // 2048):
                if len(some):
                    code, weight = subsequences([words[k] for k in some], width)
                    row = self.row[code]
                    total = np.zeros((len(some), len(self.names)), dtype=np.float32)
                    for p in range(code.shape[1]):
                        total += self.rows[row[:, p]] * weight[:, p, None].astype(np.float32)
                    out[some] = total / norms(code, weight)[:, None]
            low = width
        out *= out
        return np.where(out >= FLOOR, out, 0)


class TextKernel:
    """Best kernel of any unit of a text with each landmark. Remembers at most `most` units."""

    def __init__(self, landmarks: Landmarks, most: int = 200_000):
        self.landmarks, self.most = landmarks, most
        self.clean: set[bytes] = set()
        self.marked: dict[bytes, np.ndarray] = {}

    def learn(self, new: list[bytes]) -> None:
        if len(self.clean) + len(self.marked) + len(new) > self.most:
            self.clean.clear()
            self.marked.clear()
        forms = [variants(u) for u in new]
        flat = [f for some in forms for f in some]
        kernel = self.landmarks.kernel(flat) if flat else np.zeros((0, len(self.landmarks.names)), dtype=np.float32)
        at = 0
        hot = kernel.any(axis=1)
        for unit, some in zip(new, forms, strict=True):
            if hot[at : at + len(some)].any():
                self.marked[unit] = kernel[at : at + len(some)].max(axis=0)
            else:
                self.clean.add(unit)
            at += len(some)

    def rows(self, texts: list[bytes]) -> np.ndarray:
        """Per text: best kernels, then means of the TOP best."""
        best = np.zeros((len(texts), TOP, len(self.landmarks.names)), dtype=np.float32)
        own = [(k, units(part)) for k, t in enumerate(texts) for part in segments(t.lower())]
        step = self.most // 4
        for at in range(0, len(own), 100):
            usual = [x for x in own[at : at + 100] if len(x[1]) <= step]
            for group in [usual] if sum(len(u) for _, u in usual) <= step else [[x] for x in usual]:
                every = set().union(*[u for _, u in group])
                new = [u for u in every if u not in self.clean and u not in self.marked]
                if len(self.clean) + len(self.marked) + len(new) > self.most:
                    new = [*every]
                self.learn(new)
                for k, some in group:
                    best[k] = self.merge(best[k], [self.marked[u] for u in some if u in self.marked])
            for k, some in own[at : at + 100]:
                held = [*some] if len(some) > step else []
                for lo in range(0, len(held), step):  # a text with more units than are remembered
                    self.clean.clear()
                    self.marked.clear()
                    self.learn(held[lo : lo + step])
                    best[k] = self.merge(best[k], [*self.marked.values()])
        return np.concatenate([best[:, -1], best.mean(axis=1)], axis=1)

    def merge(self, held: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        return np.sort(np.concatenate([held, np.stack(rows)]), axis=0)[-TOP:] if rows else held


class Scorer:
    """score = 1 / (1 + exp(-(kernel . weights + bias)))."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def __call__(self, kernel: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(kernel @ self.weights + self.bias, -500, 500))) if self.names else np.full(len(kernel), 1 / (1 + np.exp(-self.bias)))


def fit(kernel: np.ndarray, labels: np.ndarray, names: list[str], penalty: float = 3e-4, rounds: int = 100) -> Scorer:
    """Nyström map, balanced linear SVM with squared hinge loss by Newton steps, logistic curve on its margins."""
    if not len(labels) or labels.min() == labels.max() or not names:
        return Scorer([], np.zeros(0), -4.0 if not len(labels) or labels.mean() < 0.5 else 4.0)
    blank = 1 + len(labels) // 5  # a text without units is clean: absence of clean words is no evidence
    kernel, labels = np.concatenate([kernel, np.zeros((blank, kernel.shape[1]))]), np.concatenate([labels, np.zeros(blank, dtype=labels.dtype)])
    value, vector = np.linalg.eigh(kernel_of(names))
    keep = value > 1e-4 * value.max()
    half = vector[:, keep] / np.sqrt(value[keep])
    back = np.kron(np.eye(2), half)
    z = np.concatenate([kernel @ back, np.ones((len(kernel), 1))], axis=1)
    sign = np.where(labels > 0, 1.0, -1.0)
    balance = np.where(labels > 0, 0.5 / (labels > 0).mean(), 0.5 / (labels <= 0).mean())
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        gap = 1 - sign * (z @ w)
        on = gap > 0
        active, weight = z[on], 2 * balance[on] / len(z)
        grad = penalty * w - active.T @ (weight * sign[on] * gap[on])
        move = np.linalg.solve(active.T @ (active * weight[:, None]) + penalty * np.eye(len(w)), grad)
        loss = lambda v: penalty / 2 * v @ v + (balance * np.maximum(1 - sign * (z @ v), 0) ** 2).mean()
        step = 1.0
        while step > 1e-6 and loss(w - step * move) > loss(w) - 1e-4 * step * grad @ move:
            step /= 2
        w = w - step * move
        if np.abs(step * move).max() < 1e-7:
            break
    margin = z @ w
    a, b = 1.0, 0.0
    target = np.where(labels > 0, ((labels > 0).sum() + 1) / ((labels > 0).sum() + 2), 1 / ((labels <= 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - target) * balance * margin).sum(), ((p - target) * balance).sum()])
        h = (p * (1 - p) + 1e-9) * balance
        hess = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 5 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Scorer(names, a * (back @ w[:-1]), a * w[-1] + b)


def kernel_of(names: list[str]) -> np.ndarray:
    """The landmarks' kernel with each other; symmetric with ones on the diagonal."""
    code, weight = zip(*[subsequences([n], max(3, len(n))) for n in names], strict=True)
    vectors = []
    for c, w in zip(code, weight, strict=True):
        one: dict[int, float] = {}
        for x, y in zip(c[0].tolist(), w[0].tolist(), strict=True):
            if x:
                one[x] = one.get(x, 0) + y
        size = sum(v * v for v in one.values()) ** 0.5
        vectors.append({x: v / size for x, v in one.items()})
    return np.array([[sum(v * b.get(x, 0) for x, v in a.items()) ** 2 for b in vectors] for a in vectors])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of at most per_class labelled ids of either class, one text an id. Ids choose the rows and go no further.

    A share of the hashes that holds the per_class least ones is cut off before they are ranked, so no task gets a whole
    class. Of repeated ids the text of least hash counts (null texts last), so a hot id is one row, too.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = known.groupBy(F.col("toxic").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("doc_id")
    near = known.join(F.broadcast(sizes), F.col("toxic") == F.col("kind")).where(hash_fraction(h) < least_share(F.col("n"), per_class))
    order = Window.partitionBy("toxic").orderBy(hash_fraction(h), h, "doc_id")
    some = saved(near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_class).select("doc_id", "toxic"), "toxicity-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    own = F.struct(F.col("text").isNull(), F.xxhash64("text"))
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", own).alias("text"))
    return saved(one.select("text", "toxic"), "toxicity-texts")


def choose_landmarks(sample: DataFrame, toxic: int, clean: int, candidates: int = 600) -> list[str]:
    """Units by the strength with which their presence marks toxic rows, kept apart, then the most common clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, flags = [], []
            for text, flag in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = {f for part in segments(text.as_buffer().to_pybytes().lower() if text.is_valid else b"") for u in units(part) for f in variants(u)}
                own |= {f[:n] for f in own for n in (5, 6, 7) if len(f) > n}
                words += own
                flags += [flag] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(flags, pa.int32())], names=["unit", "toxic"])

    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = totals["p"], totals["n"]
    if not p or p == n:
        return []
    counts = saved(sample.mapInArrow(run, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).where("n >= 3"), "toxicity-units")
    share = (F.col("n") + 1) / (n + 2)
    z = (F.col("p") / p - (F.col("n") - F.col("p")) / (n - p)) / F.sqrt(share * (1 - share) * (1 / p + 1 / (n - p)))
    ranked = counts.withColumn("z", z)
    marks = [r["unit"] for r in ranked.where("z >= 3").orderBy(F.desc("z"), F.desc(F.length("unit")), "unit").limit(candidates).collect()]
    plain = [r["unit"] for r in ranked.where("z < 1").orderBy(F.desc("n"), "unit").limit(clean).collect()]
    kept: list[str] = []
    for unit in marks:
        if len(kept) < toxic and (not kept or Landmarks(kept).kernel([unit]).max() < 0.5):
            kept.append(unit)
    return kept + plain


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, toxic_landmarks: int = 48, clean_landmarks: int = 16) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic); the driver gets kernel rows of the bounded sample only."""
    sample = labelled_sample(docs, labels, per_class)
    names = choose_landmarks(sample, toxic_landmarks, clean_landmarks)

    n_toxic = min(toxic_landmarks, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextKernel(Landmarks(names))
        for batch in batches:
            kinds, docs_, rows = [], [], []
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(0)]
                flags = part.column(1).to_pylist()
                rows += [*own.rows(texts)]
                kinds += flags
                docs_ += part.column(2).to_pylist()
                for text, flag, doc in zip(texts, flags, part.column(2).to_pylist(), strict=True):
                    best = top_sentences(own, text, n_toxic) if flag else []
                    rows += best
                    kinds += [2] * len(best)
                    docs_ += [doc] * len(best)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(docs_, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["kind", "doc", "kernel"])

    found = sample.select("text", "toxic", F.xxhash64("text").alias("doc")).mapInArrow(run, "kind int, doc long, kernel binary").collect() if names else []
    kernel = np.array([np.frombuffer(r["kernel"], np.float32) for r in found]).reshape(len(found), 2 * len(names)).astype(np.float64)
    kinds = np.array([r["kind"] for r in found], dtype=np.int64)
    whole = kinds < 2
    first = fit(kernel[whole], kinds[whole], names)
    scores, best = first(kernel), {}
    for k in np.flatnonzero(~whole):
        if scores[k] > scores[best.setdefault(found[k]["doc"], k)]:
            best[found[k]["doc"]] = k
    use = np.concatenate([np.flatnonzero(whole), np.array([*best.values()], dtype=np.int64)])
    return fit(kernel[use], (kinds[use] > 0).astype(np.int64), names)


def top_sentences(own: TextKernel, text: bytes, n_toxic: int, most: int = 3) -> list[np.ndarray]:
    """Kernel rows of the sentences nearest to a toxic landmark."""
    sentences = [x for x in _SENTENCE.split(text) if x.strip()]
    rows = own.rows(sentences)
    near = rows[:, :n_toxic].max(axis=1) if n_toxic else np.zeros(len(rows))
    return [rows[k] for k in np.argsort(-near, kind="stable")[:most] if near[k] > 0]


def score_documents(docs: DataFrame, scorer: Scorer, columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (doc_id if none are named) and score of every row, read whole. Null and empty texts have no unit and get the bias's score.

    Null and repeated ids are rows like others, and an empty table gives none.
    """
    keep = columns or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextKernel(Landmarks(scorer.names))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(0)]
                kernel = own.rows(texts) if scorer.names else np.zeros((len(texts), 0), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scorer(kernel.astype(np.float64)))], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double"
    return docs.select(F.col("text").alias("_body"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op3_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels only of rows whose crc32(doc_id as text) mod 3 is not 1."""
    docs, labels = dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    scorer = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    out = score_documents(docs, scorer)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
