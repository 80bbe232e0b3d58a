"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives each word a fixed sparse vector of a few +1 and -1; a word's context vector is the sum of
the fixed vectors of the words around it and of their shapes, over all documents of the corpus. A word that two
documents or more of the labelled sample hold has vectors of its own (``VOCABULARY`` words at most, those of most
documents first); all other words share ``PLACES`` vectors by their hash. Beside words stand their shapes (upper,
lower, digit, punctuation and other bytes, and whether the word before is repeated) and their first and last
bytes, which share the same places. A document is the mean of its words', shapes' and ends' fixed vectors, and
of its words' context vectors. A network with one hidden layer is fitted in numpy on a bounded sample of labelled
documents (``SAMPLE`` at most); a fifth of the sample sets the temperature of its probabilities.

The context sums are made where the text is read: a task sends a row of a known word or place that it met, so
what is gathered grows with the input by a fixed share of it, and the driver gets ``VOCABULARY`` and ``PLACES``
rows at most. All else is one pass over the documents.

Defined results: null, empty and blank texts have the zero vector and get the network's score of it; without
labels of both kinds all scores are the share of the label there is (or 1); repeated rows score alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import SPACES, Words, chunks, mix
from pathrank.llm.labelled import sample

SAMPLE = 20_000
#: Words of the sample with vectors of their own, at most, and vectors that all other words share.
VOCABULARY = 32_768
PLACES = 4096
DIMENSIONS = 64
#: Non-zero entries of a fixed vector, and words around a word that are its context.
NONZERO = 4
CONTEXT = 2
HIDDEN = 32
THRESHOLD = 0.7

#: Classes of bytes: upper, lower, digit, other ASCII, beyond ASCII.
_CLASS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 4 if b >= 128 else 3 for b in range(256)])


def fixed_vectors(known: int) -> np.ndarray:
    """The fixed vectors of all places and then of so many known words."""
    rng = np.random.default_rng(12345)
    out = np.zeros((PLACES + known, DIMENSIONS), np.int8)
    held = np.argpartition(rng.random(out.shape, np.float32), NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, held, rng.choice(np.array([-1, 1], np.int8), held.shape), axis=1)
    return out


def _place(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values.astype(np.uint64) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(52)).astype(np.int64)


def _rows(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The row of each word's vectors: its own behind the places if the word is among ``known``, or a shared place."""
    places = _place(hashes, 1)
    if not len(known):
        return places
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, PLACES + at, places)


def tokens(words: Words, known: np.ndarray) -> np.ndarray:
    """Rows of the vectors of every word, its shape and its ends: an array of three columns."""
    if not len(words.begin):
        return np.empty((0, 3), np.int64)
    shape = np.zeros(len(words.begin), np.int64)
    kind = _CLASS[words.data]
    edges = np.stack([words.begin, words.end], 1).ravel()
    edges[-1] = min(edges[-1], len(kind) - 1)
    for c in range(5):
        n = np.add.reduceat((kind == c).astype(np.int32), edges)[::2]
        shape = shape * 4 + np.minimum(n, 3)
    again = np.concatenate(([False], (words.hashes[0][1:] == words.hashes[0][:-1]) & (words.doc[1:] == words.doc[:-1])))
    ends = words.data[words.begin].astype(np.int64) << 8 | words.data[words.end - 1]
    return np.stack([_rows(words.hashes[0], known), _place(shape * 2 + again, 2), _place(ends, 3)], 1)


def _summed(rows: np.ndarray, places: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(places, kind="stable")
    held = places[order]
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    into[held[first]] += np.add.reduceat(rows[order], first, axis=0, dtype=np.int32)


def vocabulary(labelled: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """The hashes, in order, of the words of two documents of the sample or more; of more than ``most`` those of most documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks((t,) for t in batch.column("text").cast(pa.binary()).to_pylist() if t):
                words = Words([t for (t,) in part], SPACES)
                own = np.lexsort((words.hashes[0], words.doc))
                doc, word = words.doc[own], words.hashes[0][own]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))[: len(own)]
                distinct, n = np.unique(word[new].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = labelled.select("text").mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def context_vectors(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """The context vector of each place and known word, over all documents, scaled to unit length."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = fixed_vectors(len(shared.value))
        sums = np.zeros((len(fixed), DIMENSIONS), np.int64)
        for batch in batches:
            for part in chunks((t,) for t in batch.column("text").cast(pa.binary()).to_pylist() if t):
                words = Words([t for (t,) in part], SPACES)
                own = tokens(words, shared.value)
                if not len(own):
                    continue
                # rows of zeros part the documents
                at = np.arange(len(own)) + CONTEXT * (words.doc + 1)
                vectors = np.zeros((at[-1] + CONTEXT + 1, DIMENSIONS), np.int8)
                vectors[at] = fixed[own[:, 0]] + fixed[own[:, 1]]
                around = np.zeros_like(vectors)
                for d in range(1, CONTEXT + 1):
                    around[d:] += vectors[:-d]
                    around[:-d] += vectors[d:]
                _summed(around[at], own[:, 0], sums)
        some = np.flatnonzero(np.abs(sums).sum(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * DIMENSIONS), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["row", "v"])

    parts = docs.select("text").mapInArrow(scan, "row int, v array<long>")
    total = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[k]).cast("float") for k in range(DIMENSIONS)]).alias("v"))
    rows = total.toArrow()  # PLACES and VOCABULARY rows at most
    out = np.zeros((PLACES + len(known), DIMENSIONS), np.float32)
    if rows.num_rows:
        out[rows.column("row").to_numpy()] = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[bytes], fixed: np.ndarray, context: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The document vectors of some texts."""
    out = np.zeros((len(texts), 4 * DIMENSIONS + 1), np.float32)
    at = 0
    for part in chunks((t,) for t in texts):
        words = Words([t for (t,) in part], SPACES)
        own = tokens(words, known)
        some = np.flatnonzero(words.counts)
        if len(some):
            n = words.counts[some][:, None]
            blocks = [np.add.reduceat(m[own[:, k]], words.first[some], axis=0, dtype=np.float32) / n for m, k in ((fixed, 0), (fixed, 1), (fixed, 2), (context, 0))]
            out[at + some] = np.concatenate([*blocks, np.log1p(n) / 10], axis=1)
        at += len(part)
    return out


@dataclass
class Model:
    known: np.ndarray
    context: np.ndarray
    share: float = 1.0
    layers: tuple[np.ndarray, ...] = ()
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _network(x: np.ndarray, y: np.ndarray, epochs: int = 40) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 128):
            xb, yb = x[order[low : low + 128]], y[order[low : low + 128]]
            hidden = np.maximum(xb @ layers[0] + layers[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - yb) / len(xb)
            back = np.outer(error, layers[2]) * (hidden > 0)
            grads = [xb.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
            t += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - 2e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, quality), learnt from ``most`` of the labelled documents at most."""
    labelled = sample(docs, labels, "quality", most).select("doc_id", "y", "text")
    known = vocabulary(labelled)
    model = Model(known, context_vectors(docs, known))
    rows = _vectors(labelled, model, "doc_id long, y int").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    y = rows.column("y").to_numpy()[order].astype(float)
    if not len(y) or y.min() == y.max():
        model.share = float(y[0]) if len(y) else 1.0
        return model
    x = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float32).reshape(len(y), -1)[order].astype(float)
    order = np.random.default_rng(3).permutation(len(y))
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    x_all = (x - model.mean) / model.scale
    held = max(1, len(y) // 5)
    model.layers = _network(x_all[held:], y[held:])
    z = model.logits(x[:held])
    losses = {t: float(np.mean(np.logaddexp(0, np.where(y[:held] > 0, -1, 1) * z / t))) for t in np.geomspace(0.3, 10, 60)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def _vectors(docs: DataFrame, model: Model, kept: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.context))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, context = shared.value
        fixed = fixed_vectors(len(known))
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            vectors = [v.tobytes() for v in pooled(texts, fixed, context, known)]
            out = batch.drop_columns(["text"])
            yield out.append_column("v", pa.array(vectors, pa.binary()))

    return docs.mapInArrow(scan, f"{kept}, v binary")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the calibrated probability of good quality, of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        fixed = fixed_vectors(len(held.known))
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            scores = held.probabilities(pooled(texts, fixed, held.context, held.known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
