"""How document filters overlap, for every order in which they may be applied.

A table-driven byte transducer reads each text once as UTF-8. Its table has a row for each state (between words,
inside a word) and a column for each byte; a cell holds the next state and what is put out: a word opens, a word
closes, a capital, a code point, a symbol. The next state depends on the byte alone, so the state before a byte is
known from the byte before it, and a batch of texts runs through the table as two array lookups. Word spans go
into an open-addressed hash table of the batch, keyed by document and hash; a span that meets a taken place is
compared with its owner byte by byte, so that the number of different words is exact.

Five conditions come from these counts and from equal texts in documents with smaller ids. They make a mask for
each document; masks are counted by part, and all orders of the filters are read off the counts of the 32 masks.

Skew: texts are compared by 256-bit keys; a key's smallest id is aggregated before it is shuffled, and the join that
carries it back is an ordinary one, which Spark splits where a text has many copies. A part sends 128 rows a task.

Defined results: null texts are empty (no words, 0 code points); a null part is the empty string; rows without an id
have no smaller id than any other and never repeat one, and have no labels; rows of one id are documents each, and do
not repeat each other; a label of several rows counts if any of them has it; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import CHUNK_BYTES, byte_values, mix, sliced, stretches, text_key

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Shares of different words and of capitals, in hundredths.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3

_GAP, _WORD = 0, 1
_OPEN, _CLOSE, _CAPITAL, _POINT, _SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state by byte, output by state and byte)."""
    byte = np.arange(256)
    state = np.where((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)), _GAP, _WORD).astype(np.uint8)
    plain = _CAPITAL * ((byte >= ord("A")) & (byte <= ord("Z"))) + _POINT * ((byte & 0xC0) != 0x80) + _SYMBOL * np.isin(byte, list(b"#$%&*|"))
    out = np.stack([plain + _OPEN * (state == _WORD), plain + _CLOSE * (state == _GAP)]).astype(np.uint8)
    return state, out


_NEXT, _OUT = _tables()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


class Spans:
    """Byte spans of a buffer, compared eight bytes at a time."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.begin, self.length = begin, end - begin
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        self.head = self._load(np.arange(len(begin)), 0)

    def _load(self, which: np.ndarray, at: int) -> np.ndarray:
        return self.eight[self.begin[which] + at] & _MASKS[np.minimum(self.length[which] - at, 8)]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = (self.length[a] == self.length[b]) & (self.head[a] == self.head[b])
        left, at = np.flatnonzero(equal & (a != b) & (self.length[a] > 8)), 8
        while len(left):
            alike = self._load(a[left], at) == self._load(b[left], at)
            equal[left[~alike]] = False
            at += 8
            left = left[alike & (self.length[a[left]] > at)]
        return equal


def distinct(spans: Spans, doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """The number of different spans of each document, by a verified hash table with linear probing."""
    mask = (1 << max(4, (2 * len(doc)).bit_length())) - 1
    slots = np.full(mask + 1, -1, np.int64)
    place = (mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))) & np.uint64(mask)).astype(np.int64)
    found, left = np.zeros(n_docs, np.int64), np.arange(len(doc))
    while len(left):
        free = left[slots[place[left]] < 0]
        slots[place[free][::-1]] = free[::-1]  # of the spans that meet at a free place the first one takes it
        owner = slots[place[left]]
        found += np.bincount(doc[left[owner == left]], minlength=n_docs)
        settled = (doc[owner] == doc[left]) & spans.same(owner, left)
        left = left[~settled]
        place[left] = (place[left] + 1) & mask
    return found


def transduce(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words, different words, capitals, code points and symbols of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bases = np.cumsum(lengths + 1) - lengths - 1
    state = _NEXT[data]
    out = _OUT[np.concatenate((np.zeros(1, np.uint8), state[:-1])), data]
    begin, end = np.flatnonzero(out & _OPEN), np.flatnonzero(out & _CLOSE)  # the line end after each text closes its last word
    doc = np.searchsorted(bases, begin, side="right") - 1
    sums = lambda bit: np.add.reduceat((out & bit != 0).astype(np.int64), bases)
    return {
        "n_words": np.bincount(doc, minlength=len(texts)).astype(np.int64),
        "n_distinct": distinct(Spans(data, begin, end), doc, stretches(byte_values(data), begin, end), len(texts)),
        "n_capitals": sums(_CAPITAL),
        "n_chars": sums(_POINT) - 1,
        "n_symbols": sums(_SYMBOL),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ``key`` of the text, and the transducer's counts, for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_key(text).alias("key"), text.alias("text"))
    counts = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, CHUNK_BYTES):
            found = transduce(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found[c]) for c in counts]], names=["doc_id", "lang", "key", *counts])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, lang string, key binary, " + ", ".join(f"{c} long" for c in counts))


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(0)


def failing(docs: DataFrame) -> DataFrame:
    """doc_id, lang and ``mask`` of the conditions that each row of ``docs`` fails: bit 0 for A up to bit 4 for E."""
    rows = measured(docs)
    alone = (
        _bit("A", F.col("n_words") < LEAST_WORDS)
        + _bit("B", 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"))
        + _bit("C", 100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"))
        + _bit("D", F.col("n_symbols") > 0)
    )
    rows = rows.select("doc_id", "lang", "key", alone.alias("alone"))
    firsts = docs.where("doc_id is not null").groupBy(text_key(F.coalesce("text", F.lit(""))).alias("key")).agg(F.min("doc_id").alias("first"))
    return rows.join(firsts, "key", "left").select("doc_id", "lang", (F.col("alone") + _bit("E", F.col("doc_id") > F.col("first"))).alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part the counts of documents by mask, also of those labelled good and toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    counted = failing(docs).join(marks, "doc_id", "left").groupBy(F.col("lang").alias("part"), "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))  # 32 cells a part at most


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step's filter removes, repeats and costs."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = histogram(docs, labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    earlier = sum((F.when(F.instr("filter_order", letter) < F.col("step"), 1 << k).otherwise(0) for k, letter in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("own", F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), place)).withColumn("earlier", earlier)

    def total(column: str, holds, weight=lambda mask: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(holds(c["mask"]), c[column] * weight(c["mask"])).otherwise(0))

    own, before = F.col("own"), F.col("earlier")
    fails = lambda m: m.bitwiseAND(own) != 0
    fresh = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & fresh(m)
    # of the orders of all filters, a document's k failing ones come first equally often each
    share = lambda m: F.element_at(F.array(*[F.lit(len(orders) // k) for k in range(1, len(FILTERS) + 1)]), F.bit_count(m))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: fresh(m) & ~fails(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~fresh(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("bad", removed).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )
