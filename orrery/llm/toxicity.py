"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the features of its words, a document's the
noisy-or of its sentences' scores, and the weights are trained from the documents' labels alone: a clean label pushes
every sentence down, a toxic one pushes up the sentences that are likeliest to have earned it. The same sentence
scores then locate the offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spare

#: Training takes at most SAMPLE labelled ids of each label (by hash of id) and, in hash order of id and text, rows of
#: them until CHARS characters are reached, each text whole; rows of over LONGEST characters are not drawn. It keeps
#: FEATURES features. A document is predicted toxic from THRESHOLD on, a sentence is offending from half on.
SAMPLE, CHARS, LONGEST, FEATURES, THRESHOLD, MEMORY = 1500, 16_000_000, 1_000_000, 10_000, 0.7, 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, its beginnings and its end: inflected and compound insults share those."""
    n = len(word)
    return ["=" + word, *(f"^{i}" + word[:i] for i in (2, 3, 4, 5) if n > i), *(f"${i}" + word[-i:] for i in (3, 4) if n > i)]


def lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(first, end, distinct words) of each sentence that has any."""
    for s in SENTENCE.finditer(lowered(text)):
        if w := WORDS.findall(s[0]):
            yield s.start(), s.end(), set(w)


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        v = sum(self.weights.get(f, 0.0) for f in features(w))
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known[w] = v
        return v

    def logits(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Of each sentence, with its place in the text."""
        known, word = self.known, self.word
        z, at = [], []
        for first, end, ws in sentences(text):
            z.append(self.bias + sum([known[w] if w in known else word(w) for w in ws]))
            at.append((first, end))
        return np.array(z), at

    def score(self, text: str | None) -> tuple[float, list[int], list[tuple[int, int]]]:
        """(noisy-or of the sentences, the offending ones' indices and places); no sentence: 0 and none."""
        z, at = self.logits(text) if text else (np.zeros(0), [])
        if not len(z):
            return 0.0, [], []
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        bad = np.nonzero(p >= 0.5)[0].tolist()
        return float(np.clip(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), 0, 1)), bad, [at[i] for i in bad]


@dataclass
class Bags:
    """Training documents as numbers, not texts: words of sentences, sentences of documents."""

    label: np.ndarray  # of each document
    bag: np.ndarray  # of each sentence, its document
    inst: np.ndarray  # of each word, its sentence
    word: np.ndarray  # of each word, its number
    words: list[str]


def bags_of(rows: list[tuple[str, int]]) -> Bags:
    """Documents that have a sentence."""
    numbers: dict[str, int] = {}
    label, bag, inst, word = [], array("q"), array("q"), array("q")
    for text, y in rows:
        some = False
        for _, _, ws in sentences(text):
            some = True
            for w in sorted(ws):
                inst.append(len(bag))
                word.append(numbers.setdefault(w, len(numbers)))
            bag.append(len(label))
        if some:
            label.append(y)
    return Bags(np.array(label, float), np.array(bag, np.int64), np.array(inst, np.int64), np.array(word, np.int64), list(numbers))


def loss(w: np.ndarray, b: Bags, inst: np.ndarray, col: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Negative noisy-or log-likelihood, labels weighed alike, with its gradient by the weights (the bias is the last)."""
    y, n = b.label, len(b.label)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    z = np.bincount(inst, w[col], len(b.bag)) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    log_clean = np.bincount(b.bag, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
    doc = np.clip(-np.expm1(log_clean), 1e-9, 1)
    pull = np.where(y == 1, -(1 - doc) / doc, 1.0) * weight  # of the loss, by a sentence's logit, over its score
    g = pull[b.bag] * p
    value = -(weight * np.where(y == 1, np.log(doc), log_clean)).sum() + decay * (w[:-1] @ w[:-1]) / 2
    return float(value), np.append(np.bincount(col, g[inst], len(w) - 1) + decay * w[:-1], g.sum())


def pick(b: Bags) -> list[str]:
    """The FEATURES features whose shares of documents differ most between the labels, of those in four or more."""
    numbers: dict[str, int] = {}
    of = [[numbers.setdefault(f, len(numbers)) for f in features(w)] for w in b.words]
    counts = np.zeros((2, len(numbers)), np.int64)
    ends = np.searchsorted(b.bag[b.inst], np.arange(len(b.label) + 1))
    for d, y in enumerate(b.label):
        mine = np.unique(b.word[ends[d] : ends[d + 1]])
        counts[int(y), list({f for w in mine.tolist() for f in of[w]})] += 1
    n0, n1 = (b.label == 0).sum(), (b.label == 1).sum()
    told = np.abs(np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))) * np.sqrt(counts.sum(0))
    often = np.nonzero(counts.sum(0) >= 4)[0]
    names = np.array(list(numbers), object)[often]
    best = sorted(range(len(often)), key=lambda i: (-told[often[i]], names[i]))[:FEATURES]
    return names[best].tolist()


def train(rows: list[tuple[str, int]], steps: int = 200, rate: float = 0.12, decay: float = 2e-4) -> Model:
    """Weights by Adam on the noisy-or likelihood, classes weighed alike; without both labels nothing is toxic."""
    b = bags_of(rows)
    if not len(b.label) or b.label.min() == b.label.max():
        return Model(-30.0, {})
    kept = pick(b)
    at = {f: i for i, f in enumerate(kept)}
    of = [[at[f] for f in features(w) if f in at] for w in b.words]
    many = np.array([len(x) for x in of], np.int64)
    first = np.append(0, np.cumsum(many))
    flat = np.array([i for x in of for i in x], np.int64)
    times = many[b.word]
    inst = np.repeat(b.inst, times)
    col = flat[np.repeat(first[b.word], times) + np.arange(len(inst)) - np.repeat(np.cumsum(times) - times, times)]
    w = np.zeros(len(kept) + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, grad = loss(w, b, inst, col, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(kept, w, strict=False) if abs(x) > 1e-4})


def fold(col) -> F.Column:
    """Whether crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of labelled rows, none held out, their texts whole.

    At most SAMPLE ids of each label; rows that repeat id and text count once; where an id has several texts, and as
    long as the label's CHARS characters last, rows are taken in hash order.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(f"toxic = {y}").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).filter(F.length("_t") <= LONGEST)
    rows = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).withColumn("_h", F.xxhash64("_id", "_t"))
    # a label's hash order: at most 2 * SAMPLE rows a task go on, so the running sum is over a bounded table
    order = Window.partitionBy("_y").orderBy("_h", "_id")
    rows = rows.dropDuplicates(["_id", "_h"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 2 * SAMPLE)
    rows = rows.withColumn("_c", F.sum(F.length("_t")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    taken = rows.filter(F.coalesce("_c", F.lit(0)) < CHARS).select("_t", "_y").collect()
    return train(sorted((r._t, int(r._y)) for r in taken))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "_tox") -> DataFrame:
    """``docs`` with struct ``out_col`` (score, offending, spans) added; whole texts, null as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    @F.pandas_udf("score double, offending array<int>, spans array<array<int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            yield pd.DataFrame([m.score(t) for t in batch], columns=["score", "offending", "spans"])

    return docs.withColumn(out_col, run(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, offending, spans) of every row.

    Labels of ids whose crc32 mod 3 is 1 are never learnt from. Null and empty texts score 0. ``offending`` holds the
    indices, among the sentences that have words, of those that alone score half or more; ``spans`` their first and end
    characters in the text, from 0. Repeated rows are kept, repeated labels count once (toxic wins); null ids are
    scored; very long texts are scored whole; without labels of both kinds every score is near 0; an empty table gives
    no rows. Columns other than id and text are not looked at.
    """
    model = fit(docs, labels, id_col, text_col)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), model, "doc_id", "_text")
    out = out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), F.col("_tox.score").alias("score"), F.col("_tox.offending").alias("offending"), F.col("_tox.spans").alias("spans"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "offending", "spans")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; columns as they are, whatever their names.

    Each row is judged alone, by its text: null and empty texts score 0 and stay, repeated rows stay or go together,
    null ids are judged like others, very long texts are read whole. Without labels of both kinds all rows stay; an
    empty table gives none.
    """
    kept = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, at := spare(docs, "_tox"))
    return kept.filter(F.col(f"{at}.score") < THRESHOLD).select(*docs.columns)
