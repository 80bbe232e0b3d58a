"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a slice of a partition. The alphabet of its index is the vocabulary of the benchmark: the words that
the benchmark has too are indexed (runs of them too short for any window are not), and one symbol stands for
whatever lies between. The index is a suffix
array, its Burrows-Wheeler transform, a wavelet matrix for ranks, and every eighth suffix position. All
benchmark windows are searched backwards at once, their rows walked to a sampled position, and the found
places merged into spans of words to remove.

The benchmark reaches the tasks in blocks of bounded size, of which the driver and a task hold one at a time
(the broadcast itself spills to disk), and a vocabulary of all blocks, eight bytes a distinct word. Each shard is
indexed once, as it came, and searched for block after block; the spans of all blocks are merged and cut once.

Defined results: null and empty texts have no words and no spans; an item without words has no windows;
equal items are all reported; an empty benchmark hits nothing; repeated rows and rows without an id are
documents of their own; an empty table gives no rows; columns besides the id and the text are kept by
``clean`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import PUNCTUATION, Words, chunks, sliced

WINDOW = 10
#: Bytes of benchmark text that the tasks hold at once.
BLOCK_BYTES = 4 << 20
#: Every so many suffix positions one is kept.
SAMPLED = 8
SHARD_BYTES = 8 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative numbers by prefix doubling; suffixes that have a place of their own are sorted no more."""
    n, span = len(text), 1
    order = np.argsort(text, kind="stable")
    key = text[order]
    rank, tied = np.zeros(n, np.int64), np.arange(n)
    while len(tied):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = order[tied]
        rank[place] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]  # the first place of those alike
        tied = tied[~(new & np.append(new[1:], True))]
        place = order[tied]
        after = np.where(place + span < n, rank[np.minimum(place + span, n - 1)] + 1, 0)
        key = rank[place] * (n + 1) + after
        sort = np.argsort(key)
        order[tied], key = place[sort], key[sort]
        span *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, a level for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(upto), upto
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low


class FMIndex:
    """Full-text index of a sequence of positive symbols; 0 separates stretches."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.concatenate((text + 1, [0])).astype(np.int64)  # only the end is 0: it comes before all else
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 2))))
        self.ranks = WaveletMatrix(self.last, max(1, int(symbols + 1).bit_length()))
        self.kept = order % SAMPLED == 0
        self.at = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, from and to, of each pattern (a row of ``patterns``)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k] + 1
            low[alive] = self.before[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        gone = high <= low
        low[gone] = high[gone] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, walked back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.kept[rows])
        while len(going):
            here = rows[going]
            symbol = self.last[here]
            rows[going] = self.before[symbol] + self.ranks.rank(symbol, here)
            steps[going] += 1
            going = going[~self.kept[rows[going]]]
        return self.positions[self.at[rows]] + steps


class Phrases:
    """The windows of a block of items, as symbols of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = Words([(text or "").encode("utf-8", "surrogatepass").lower() for _, text in items], PUNCTUATION)
        self.vocabulary = np.unique(words.hashes[0])
        symbols = np.searchsorted(self.vocabulary, words.hashes[0]) + 1
        found: dict[int, dict[bytes, set[str]]] = {}
        for (item, _), start, n in zip(items, words.first, words.counts, strict=True):
            size = min(window, n)
            for k in range(start, start + n - size + 1) if n else ():
                found.setdefault(int(size), {}).setdefault(symbols[k : k + size].tobytes(), set()).add(str(item))
        self.windows = {size: np.frombuffer(b"".join(w), np.int64).reshape(-1, size) for size, w in found.items()}
        self.items = {size: [sorted(x) for x in w.values()] for size, w in found.items()}
        self.least = min(found, default=0)


class Vocabulary:
    """The words of all blocks of items, and the length of the shortest window: what of a text is worth an index."""

    def __init__(self, words: np.ndarray, least: int) -> None:
        self.words, self.least = words, least
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[words >> np.uint64(48)] = True

    def stretches(self, words: Words) -> np.ndarray:
        """The words of the vocabulary, in runs that are long enough for the shortest window."""
        near = np.flatnonzero(self.sieve[words.hashes[0] >> np.uint64(48)])
        if not self.least or not len(near):
            return near[:0]
        place = np.minimum(np.searchsorted(self.words, words.hashes[0][near]), len(self.words) - 1)
        near = near[self.words[place] == words.hashes[0][near]]
        if not len(near):
            return near
        breaks = np.flatnonzero((np.diff(near) != 1) | (words.doc[near[1:]] != words.doc[near[:-1]])) + 1
        size = np.diff(np.concatenate(([0], breaks, [len(near)])))
        return near[np.repeat(size >= self.least, size)]


def _hits(texts: list[bytes], shared: Shared) -> Iterator[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """For each text of a shard: number of words, merged spans (first word, last word, first byte, last byte) and items.

    The shard's index is made once, over the words of all blocks; their windows are searched in it block after block.
    """
    vocabulary = shared.vocabulary.value
    parts, counts, owner, place, begins, ends, n = [], [], [], [], [], [], 0
    for part in chunks((t,) for t in texts):
        words = Words([t.lower() for (t,) in part], PUNCTUATION)
        counts.append(words.counts)
        chosen = vocabulary.stretches(words)
        if len(chosen):
            symbols = np.searchsorted(vocabulary.words, words.hashes[0][chosen]) + 1
            breaks = np.flatnonzero((np.diff(chosen) != 1) | (words.doc[chosen[1:]] != words.doc[chosen[:-1]])) + 1
            own = words.doc[chosen]
            for out, x in ((parts, symbols), (owner, own + n), (place, chosen - words.first[own]), (begins, words.begin[chosen] - words.bases[own]), (ends, words.end[chosen] - words.bases[own])):
                out.append(np.insert(x, breaks, 0))
                out.append(np.zeros(1, np.int64))
        n += len(part)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    found: dict[int, set[str]] = {}
    if parts:
        index = FMIndex(np.concatenate(parts), len(vocabulary.words))
        owner, place, begins, ends = (np.concatenate(x) for x in (owner, place, begins, ends))
        hit = np.zeros(len(owner) + 1, np.int64)
        for block in shared.blocks:
            phrases = block.value
            own = np.searchsorted(vocabulary.words, phrases.vocabulary) + 1  # the block's words in the common vocabulary
            for size, windows in phrases.windows.items():
                low, high = index.search(own[windows - 1])
                some = np.flatnonzero(high > low)
                n_rows = (high - low)[some]
                rows = np.repeat(low[some] - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
                at = index.locate(rows)
                np.add.at(hit, at, 1)
                np.add.at(hit, at + size, -1)
                pairs = np.unique(owner[at] * len(windows) + np.repeat(some, n_rows))
                for doc, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist(), strict=True):
                    found.setdefault(doc, set()).update(phrases.items[size][w])
            if len(shared.blocks) > 1:
                del phrases
                vars(block).pop("_value", None)  # read again when it is needed: a task holds one block
        covered = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
        if len(covered):
            breaks = np.flatnonzero((np.diff(place[covered]) != 1) | (owner[covered[1:]] != owner[covered[:-1]])) + 1
            first, last = covered[np.concatenate(([0], breaks))], covered[np.concatenate((breaks - 1, [len(covered) - 1]))]
            spans: dict[int, list] = {}
            for doc, a, b, x, y in zip(owner[first].tolist(), place[first].tolist(), place[last].tolist(), begins[first].tolist(), ends[last].tolist(), strict=True):
                spans.setdefault(doc, []).append((a, b + 1, x, y))
    for doc, words_in in enumerate(counts.tolist()):
        if doc in found:
            yield words_in, sorted(spans[doc]), sorted(found[doc])
        else:
            yield words_in, [], []


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's windows, in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        yield Phrases([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()], window)


class Shared(NamedTuple):
    """The benchmark as it is sent to the executors: the vocabulary of all blocks, and each block."""

    vocabulary: Broadcast
    blocks: list[Broadcast]


def _shared(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Shared:
    sc, words, least, blocks = docs.sparkSession.sparkContext, np.empty(0, np.uint64), 0, []
    for phrases in _blocks(benchmark, window, block_bytes):
        words = np.union1d(words, phrases.vocabulary)
        least = min(x for x in (least, phrases.least) if x) if least or phrases.least else 0
        blocks.append(sc.broadcast(phrases))
    return Shared(sc.broadcast(Vocabulary(words, least)), blocks)


_SPANS = "array<struct<first:bigint,last:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words (from word ``first`` to before ``last``) and items of each document."""
    shared = _shared(docs, benchmark, window, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, SHARD_BYTES):
            n, spans, items = zip(*_hits(_texts(part), shared), strict=True)
            spans = [[{"first": a, "last": b} for a, b, _, _ in s] for s in spans]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, n_words long, spans {_SPANS}, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns; hit words, and what stands between them, are cut from the text."""
    shared = _shared(docs, benchmark, window, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, SHARD_BYTES):
            texts = _texts(part)
            for k, (_, spans, _) in enumerate(_hits(list(texts), shared)):
                if spans:
                    edges = [0, *(x for *_, begin, end in spans for x in (begin, end)), len(texts[k])]
                    texts[k] = b"".join(texts[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            column = pc.if_else(part.column("text").is_null(), None, pa.array(texts, pa.binary()).cast(pa.string()))
            yield part.set_column(part.schema.get_field_index("text"), "text", column)

    return docs.mapInArrow(scan, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The asked columns of ``find``'s result."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The digest computed plainly; for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for item, text in benchmark:
        words = split(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if words else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        words, hit, items = split(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    items |= windows[w]
        out.append((doc, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
