"""Toxicity by multiple-instance learning.

Only documents carry labels. A document is taken for toxic if at least one of its sentences is, so the
sentences' probabilities are combined by noisy-or: 1 - (1 - leak) * product(1 - p). The leak takes the labels
that no sentence explains. A sentence's probability is logistic in the weighted words it holds, and 0 without
any, so that long clean documents stay clean; the weights are fitted to document labels alone, and then tell
which sentences offend.

The words with weights are those that lean significantly to either label in a bounded sample of labelled
documents (``SAMPLE`` of them at most), counted by Spark; ``WORDS`` of them at most. The fit is numpy on that
sample; scoring is one pass over all documents.

Defined results: null and empty texts have no sentences and score the leak; without labels, or with labels of
one kind only, no word gets a weight and all scores are zero; repeated rows score alike; further columns are
kept by ``reject`` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.llm.labelled import sample

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 20_000
#: Words that may have weights, at most, and how strongly (likelihood ratio) and how often they must lean.
WORDS = 4_000
LEAST_RATIO = 12.0
LEAST_DOCS = 4
#: Score from which a document is toxic, and from which a sentence offends.
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
#: Log odds of a sentence before any evidence.
PRIOR = -6.0

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = PRIOR
    leak: float = 0.0

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(first character, end, probability) of each sentence that holds a weighted word."""
        out = []
        for m in _SENTENCE.finditer(text):
            known = {w for w in _WORD.findall(m[0].lower()) if w in self.weights}
            if known:
                z = self.bias + sum(self.weights[w] for w in known)
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, text: str) -> float:
        log_clean = float(np.log1p(-self.leak))
        if not self.weights.keys().isdisjoint(_WORD.findall(text.lower())):
            for _, _, p in self.sentences(text):
                log_clean += np.log1p(-min(p, 1 - 1e-12))
        return float(-np.expm1(log_clean))


def _leaning(labelled: DataFrame, most: int) -> list[str]:
    """Words whose share of documents differs between the labels."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(set(_WORD.findall(text.lower())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32())], names=["word", "y"])

    total = labelled.groupBy("y").count().collect()
    size = {r["y"]: float(r["count"]) for r in total}
    if len(size) < 2:
        return []
    n1, n0 = size[1], size[0]
    counts = labelled.select("y", "text").mapInArrow(words, "word string, y int").groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("a"), share * n1) + term(F.col("b"), share * n0) + term(n1 - F.col("a"), (1 - share) * n1) + term(n0 - F.col("b"), (1 - share) * n0))
    found = counts.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [r["word"] for r in found.orderBy(F.desc("ratio"), "word").limit(most).select("word").collect()]


def _fit(docs: list[tuple[int, list[list[int]]]], n_words: int, rounds: int = 400) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the noisy-or likelihood; docs: (label, word ids of each sentence)."""
    y = np.array([d[0] for d in docs], float)
    doc = np.array([k for k, d in enumerate(docs) for _ in d[1]], np.int64)
    size = np.array([len(s) for d in docs for s in d[1]], np.int64)
    word = np.array([w for d in docs for s in d[1] for w in s], np.int64)
    sentence = np.repeat(np.arange(len(size)), size)
    theta = np.zeros(n_words + 2)
    theta[-2], theta[-1] = PRIOR, -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    prior = np.zeros_like(theta)
    prior[-2] = PRIOR
    strength = np.full(len(theta), 0.02)
    strength[-2], strength[-1] = 0.5, 0.0
    for t in range(1, rounds + 1):
        w, bias, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
        z = bias + np.bincount(sentence, w[word], len(size))
        sigma = 1 / (1 + np.exp(-z))
        log_clean = np.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), len(y))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        pull = np.where(y > 0, -clean / (1 - clean), 1.0)  # by which each sentence's probability acts on the loss
        dz = sigma * pull[doc] if len(doc) else np.zeros(0)
        grad = np.empty_like(theta)
        grad[:-2] = np.bincount(word, dz[sentence], n_words)
        grad[-2] = dz.sum()
        grad[-1] = leak * pull.sum()
        grad += strength * (theta - prior)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, words: int = WORDS) -> Model:
    """A model of ``labels`` (doc_id, toxic), learnt from ``most`` of the labelled documents at most."""
    labelled = sample(docs, labels, "toxic", most)
    vocabulary = _leaning(labelled, words)
    if not vocabulary:
        return Model()
    place = {w: k for k, w in enumerate(vocabulary)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                held = []
                for m in _SENTENCE.finditer(text):
                    known = sorted({place[w] for w in _WORD.findall(m[0].lower()) if w in place})
                    if known:
                        held.append(known)
                rows.append(held)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["y", "held"])

    rows = labelled.select("y", "text").mapInArrow(reduce, "y int, held array<array<int>>").toArrow()
    docs_in = list(zip(rows.column("y").to_pylist(), rows.column("held").to_pylist(), strict=True))
    w, bias, leak = _fit(sorted(docs_in), len(vocabulary))
    return Model({v: round(float(x), 6) for v, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-3}, bias, leak)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending sentences (first character, end, probability) of each document."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = [model.score(t) for t in texts]
            found = [[{"first": a, "last": b, "score": p} for a, b, p in model.sentences(t) if p >= SENTENCE_THRESHOLD] if s >= SENTENCE_THRESHOLD else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, spans)], names=["doc_id", "score", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double, sentences array<struct<first:int,last:int,score:double>>")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without those whose score reaches the threshold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
