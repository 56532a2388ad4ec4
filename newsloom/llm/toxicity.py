"""Toxicity classifier with counterfactual regularisation.

A logistic regression over the words of a text and their beginnings. Each labelled text that names a
group is paired with copies that name another group of the same kind instead, and
the squared difference of their scores is part of the loss, so that the mention of
a group by itself tells nothing. Fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows
from newsloom.sources.workspace import write_through

# Labelled rows the model is fitted on, the first by the hash of their id.
TRAIN_ROWS = 12_000
# A word is a feature if its shares in the two classes differ by so many standard errors.
LEAST_Z = 3.0
COUNTERFACTUAL = 1.0
L1 = 1e-4
L2 = 1e-4
ROUNDS = 400
PREFIX = 5
THRESHOLD = 0.7

# Words for groups, by kind; a swap stays within one line.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "foreigner"), ("immigrants", "natives", "foreigners"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "nativos"),
)
_KIND = {term: line for line in IDENTITY_TERMS for term in line}
_TOKEN = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """Words of a text, and the beginnings of its longer words with how many words share them.

    ``^abcde`` stands for a word that begins so, ``^^abcde`` and ``^^^abcde`` for two and
    three different ones.
    """
    return _with_beginnings(set(_TOKEN.findall((text or "").lower())))


def _with_beginnings(words: set[str]) -> set[str]:
    begun = Counter(w[:PREFIX] for w in words if len(w) > PREFIX)
    return words | {"^" * k + p for p, n in begun.items() for k in range(1, min(n, 3) + 1)}


def swaps(found: set[str]) -> list[set[str]]:
    """Feature sets in which one named group is another of its kind."""
    words = {w for w in found if w[0] != "^"}
    return [
        _with_beginnings((words - {a}) | {b})
        for a in sorted(words & _KIND.keys()) for b in _KIND[a] if b not in words
    ]


class _Rows:
    """Sparse rows of word sets over a vocabulary."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.width = width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.column = np.array([c for r in rows for c, _ in r], np.int64)
        self.value = np.array([v for r in rows for _, v in r], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.sizes))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)

    def bound(self) -> np.ndarray:
        """Diagonal bound of the rows' Gram matrix."""
        return np.bincount(self.column, np.abs(self.value) * self.sizes[self.row], self.width)


Example = tuple[set[str], int, list[set[str]]]


def example(text: str | None, label: int) -> Example:
    """Features, label, and the features of the swapped copies of a labelled text."""
    found = features(text)
    return found, label, swaps(found)


def fit(rows: list[Example], counterfactual: float = COUNTERFACTUAL,
        l1: float = L1, l2: float = L2, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Weights of features and the bias. Without rows of both classes no feature has a weight."""
    n, positive = len(rows), sum(y for _, y, _ in rows)
    prior = (positive + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < positive < n:
        return {}, bias
    column = {w: i for i, w in enumerate(sorted({w for ws, _, others in rows for s in (ws, *others) for w in s}))}
    x = _Rows([[(column[w], 1.0) for w in sorted(ws)] for ws, _, _ in rows], len(column))
    y = np.array([y for _, y, _ in rows], float)
    pairs = [
        [(column[w], 1.0) for w in sorted(ws - other)] + [(column[w], -1.0) for w in sorted(other - ws)]
        for ws, _, others in rows for other in others
    ]
    d = _Rows(pairs or [[]], len(column))
    each = 2 * counterfactual / max(1, len(pairs))
    # Accelerated proximal gradient with a step per feature.
    step = 1 / (0.25 * (x.bound() + x.back(np.ones(n))) / n + each * d.bound() + l2 + 1e-9)
    bias_step = 1 / (0.25 * (1 + x.sizes.mean()) + 1e-9)
    w = z = np.zeros(len(column))
    b = c = bias
    t = 1.0
    for _ in range(rounds):
        residual = (1 / (1 + np.exp(-np.clip(x.dot(z) + c, -40, 40))) - y) / n
        moved = z - step * (x.back(residual) + each * d.back(d.dot(z)) + l2 * z)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = c - bias_step * residual.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return {word: float(w[i]) for word, i in column.items() if w[i]}, float(b)


def score(words: set[str], weights: dict[str, float], bias: float) -> float:
    # In a fixed order, so that equal texts get equal bits.
    at = bias + sum(weights[w] for w in sorted(words & weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(at, -40, 40))))


def training_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, words and swapped of at most ``limit`` labelled documents that ``may_learn`` (on doc_id) allows.

    Labels are chosen by the hash of the id before any text is read. A null label counts
    as none; a document that is labelled twice has the larger label.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_learn)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch):
        found = [features(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([sorted(f) for f in found], pa.list_(pa.string())),
            pa.array([[sorted(s) for s in swaps(f)] for f in found], pa.list_(pa.list_(pa.string()))),
        ], ["doc_id", "toxic", "words", "swapped"])

    # At most ``limit`` ids: bounded, so the texts need not move.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    schema = "doc_id bigint, toxic int, words array<string>, swapped array<array<string>>"
    return write_through(map_rows(found, per_batch, schema), "toxicity-sample")


def telling_features(sample: DataFrame, least_z: float = LEAST_Z) -> set[str]:
    """Features whose shares in the two classes differ enough, and the names of groups."""
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return set(_KIND)
    counts = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if(F.col("toxic") == 0).alias("without"), F.count_if(F.col("toxic") == 1).alias("with"))
    share = (F.col("without") + F.col("with") + 1) / F.lit(n + 2)
    error = F.sqrt(share * (1 - share) * (1 / positive + 1 / (n - positive)))
    apart = F.abs(F.col("with") / positive - F.col("without") / (n - positive)) >= least_z * error
    return {r[0] for r in counts.filter(apart).select("word").collect()} | _KIND.keys()


def training_rows(sample: DataFrame, wanted: set[str]) -> list[Example]:
    """The sample with the ``wanted`` features alone, in the order of the ids."""

    def per_batch(batch: pa.RecordBatch):
        words = [[w for w in ws if w in wanted] for ws in batch.column(2).to_pylist()]
        swapped = [[[w for w in ws if w in wanted] for ws in s] for s in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(swapped, pa.list_(pa.list_(pa.string()))),
        ], batch.schema.names)

    rows = map_rows(sample, per_batch, sample.schema).collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"], r["words"]))
    return [(set(r["words"]), r["toxic"], [set(s) for s in r["swapped"]]) for r in ordered]


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, limit: int = TRAIN_ROWS,
          **options) -> tuple[dict[str, float], float]:
    """``fit`` on the sample: its features are counted and chosen by Spark, only these reach the driver."""
    sample = training_sample(docs, labels, may_learn, limit)
    return fit(training_rows(sample, telling_features(sample)), **options)


def score_toxicity(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc_id and score per row of ``docs``, from the text alone.

    Null and empty texts have no words and get the score of the bias; a null id stays null;
    repeated rows give repeated results.
    """

    def per_batch(batch: pa.RecordBatch):
        scores = [score(features(t), weights, bias) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_rows(rows, per_batch, "doc_id bigint, score double")
