"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them, and only documents carry labels.

The score of a sentence is a logistic function of the learned features it holds (words and their beginnings); a sentence without
any scores 0. A document scores 1 - product(1 - sentence score), so one offending sentence is enough, and the sentence scores
that training never saw a label for tell where it stands.

Null and empty texts have no sentence and score 0. Repeated rows score alike. Without labels of both kinds every score is 0.
Columns besides the id, the text and the label are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import map_rows, need

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
REMEMBERED = 300_000


def word_features(word: str) -> list[str]:
    """The word, and its beginnings for words that are longer."""
    return [word] + [f"{word[:k]}-" for k in BEGINNINGS if len(word) > k]


@dataclass
class Scorer:
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def sentence(self, active: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[active].sum()))))


class Matcher:
    """Finds the learned features of texts, sentence by sentence; remembers words."""

    def __init__(self, features: dict[str, int]):
        self.features, self.seen = features, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
        return found

    def sentences(self, text: str) -> list[tuple[int, int, list[int]]]:
        """Start, end and distinct features of the sentences that hold any."""
        low = text.lower()
        seen, out = self.seen, []
        hits = [w for w in set(WORD.findall(low)) if (seen[w] if w in seen else self.of_word(w))]
        if not hits:
            return out
        if len(low) != len(text):  # rare letters change their length in lower case; fold them one by one
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(low):
            active = {f for w in WORD.findall(m.group()) for f in self.of_word(w)}
            if active:
                out.append((m.start(), m.end(), sorted(active)))
        return out


def train(bags: list[list[list[int]]], y: np.ndarray, n_features: int, rounds: int = 300, rate: float = 0.1,
          penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that fit noisy-or scores to document labels, by Adam on the log likelihood."""
    doc = np.array([i for i, bag in enumerate(bags) for s in bag for _ in s], np.int64)
    sent = np.array([k for k, s in enumerate(s for bag in bags for s in bag) for _ in s], np.int64)
    feat = np.array([f for bag in bags for s in bag for f in s], np.int64)
    if not feat.size:
        return np.zeros(n_features), -4.0
    n_sent = int(sent[-1]) + 1
    doc_of = np.zeros(n_sent, np.int64)
    doc_of[sent] = doc
    n_docs = len(bags)
    w, b = np.zeros(n_features), -2.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(sent, w[feat], n_sent) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs))  # no sentence offends
        score = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p * (label 1: -(1 - score) / score, label 0: +1)
        pull = np.where(y == 1, -(1 - score) / score, 1.0)[doc_of] * p / n_docs
        g = np.append(np.bincount(feat, pull[sent], n_features) + penalty * w / n_docs, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        learn: Column | None = None, sample: int = 15_000, features: int = 3_000, least: int = 4) -> Scorer:
    """Learn from at most ``sample`` labelled documents where ``learn`` (a condition on the id) holds.

    The labelled ids with the smallest hash are taken; that bounded list may be broadcast. Features are those of the sample that
    occur in ``least`` documents or more and tell the labels best (chi-square), at most ``features`` of them.
    """
    need(docs, id_col, text)
    need(labels, id_col, label)
    known = labels.where(F.lit(True) if learn is None else learn).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return Scorer({}, np.zeros(0), -4.0)

    def distinct():
        def function(texts):
            for t in texts:
                words = set(WORD.findall((t or b"").decode().lower()))
                yield (sorted({f for w in words for f in word_features(w)}),)
        return function

    listed = map_rows(rows, ["_y"], "_text", distinct, T.StructType([T.StructField("feature", T.ArrayType(T.StringType()))]))
    p, q = F.col("pos") / sizes[1], F.col("neg") / sizes[0]
    mean = (F.col("pos") + F.col("neg")) / (sizes[0] + sizes[1])
    best = (
        listed.select(F.explode("feature").alias("feature"), "_y").groupBy("feature")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
        .where((F.col("pos") + F.col("neg") >= least) & (p > 2 * q))
        .withColumn("_tells", (p - q) ** 2 / (mean * (1 - mean) + 1e-9))
        .orderBy(F.desc("_tells"), "feature").limit(features).collect()
    )
    names = {r["feature"]: i for i, r in enumerate(sorted(best, key=lambda r: r["feature"]))}

    def bags():
        matcher = Matcher(names)

        def function(texts):
            for t in texts:
                yield ([s[2] for s in matcher.sentences((t or b"").decode())],)
        return function

    found = map_rows(rows, ["_id", "_y"], "_text", bags,
                     T.StructType([T.StructField("bag", T.ArrayType(T.ArrayType(T.IntegerType())))])).collect()
    found.sort(key=lambda r: (r["_id"], r["_y"]))
    weights, bias = train([r["bag"] for r in found], np.array([r["_y"] for r in found]), len(names))
    return Scorer(names, weights, bias)


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text: str = "text", offending: float = 0.5) -> DataFrame:
    """``keep``, score, predicted (1 from 0.5 on), and sentences: start, end (code points) and score from ``offending`` on."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("score", T.DoubleType())]))

    def make():
        matcher = Matcher(scorer.features)

        def function(texts):
            for t in texts:
                clean, located = 1.0, []
                for a, b, active in matcher.sentences((t or b"").decode()):
                    p = scorer.sentence(active)
                    clean *= 1 - p
                    if p >= offending:
                        located.append({"start": a, "end": b, "score": p})
                yield (1 - clean, int(1 - clean >= 0.5), located)

        return function

    return map_rows(docs, keep, text, make, T.StructType([
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("sentences", spans)]))
