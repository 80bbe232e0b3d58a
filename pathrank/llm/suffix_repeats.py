"""Repeated byte strings through interval trees of enhanced suffix arrays.

Suffixes that can share a string of ``LEAST`` bytes have to meet in one suffix array. Every window of that many
bytes is represented by an anchor, the leftmost smallest hash of its runs of ``ANCHOR`` bytes, so that equal
windows have equal anchors at the same place. An anchor stands for a segment of its document: the windows it
represents. Anchors that occur once in the corpus are dropped. Equal segments are leaves of the tree with the same
string: they are folded into their first occurrence (aggregated before the shuffle, so a hot passage is one row a
task), and their places are an interval of the tree. The distinct segments of an anchor are joined in one suffix
array with its longest common prefixes. A stack scan gives the intervals of its common-prefix tree; one whose
occurrences are preceded by different bytes is a maximal repeat.

An anchor of more than ``HOT_SEGMENTS`` distinct segments is not put into one array: its windows are compared
each by its digest, which gives the same repeats in pieces of ``LEAST`` bytes, in groups that Spark aggregates.

``digest`` removes a byte if it lies in an occurrence of a repeat that is not the repeat's first (smaller id, then
smaller start), which covers exactly the bytes of windows that start earlier too. ``repeats`` gives the groups
with all their occurrences; pieces of neighbouring segments that have the same occurrences are joined to one repeat,
so it ends where the set of its occurrences changes.

Anchor and segment hashes have 64 bits; the bytes themselves are compared in the suffix arrays, while folded
segments are equal in 64 bits of their bytes and 64 of their anchor, and so are windows of hot anchors.

Defined results: null and empty texts and those shorter than ``LEAST`` lose nothing; rows without an id lose
nothing; repeated rows (the same id) count as one document; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathrank.llm.common import byte_values, chunks, cut, leftmost_minima, mix, rolling, stored, stretches

LEAST = 100
ANCHOR = 24
#: Bytes of segments that one suffix array holds, besides those of its last anchor.
ARRAY_BYTES = 400_000
#: Distinct segments (of 176 bytes at most) of an anchor that share a suffix array, at most: some 3.5 MB, which take 0.4 GB.
HOT_SEGMENTS = 20_000
#: So many documents with segments of hot anchors are broadcast to the texts at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def _segments(texts: list[bytes], least: int, which: int = 0) -> tuple[np.ndarray, ...]:
    """(text's index, anchor's hash, first window, last window's end, segment's hash) for each run of windows with one anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size) - size
    grams = rolling(byte_values(data), ANCHOR)
    place = leftmost_minima(grams, least - ANCHOR + 1)
    doc = np.repeat(np.arange(len(texts)), size)
    start = np.flatnonzero(doc[: len(place)] == doc[least - 1 :][: len(place)])
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    place = place[start]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last = start[new], start[np.concatenate((new[1:] - 1, [len(start) - 1]))] + least
    own, anchor = doc[first], grams[place[new]]
    return own, anchor.view(np.int64), first - base[own], last - base[own], stretches(byte_values(data, 1), first, last, 1).view(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    return ((i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True) if t and i is not None)


def anchors(docs: DataFrame, least: int) -> DataFrame:
    """(h, doc_id, n): the anchors of each document and how often it has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(_rows(batch)):
                own, anchor, *_ = _segments_anchors([t for _, t in part], least)
                pairs = np.empty(len(own), [("doc", np.int64), ("h", np.int64)])
                pairs["doc"], pairs["h"] = own, anchor
                pairs, n = np.unique(pairs, return_counts=True)
                ids = np.array([i for i, _ in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs["h"])), pa.array(ids[pairs["doc"]]), pa.array(n.astype(np.int32))], names=["h", "doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(scan, "h long, doc_id long, n int")


def _segments_anchors(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, anchor's hash) as in ``_segments``, without the hashes of the segments."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    grams = rolling(byte_values(data), ANCHOR)
    place = leftmost_minima(grams, least - ANCHOR + 1)
    doc = np.repeat(np.arange(len(texts)), size)
    start = np.flatnonzero(doc[: len(place)] == doc[least - 1 :][: len(place)])
    place = np.unique(place[start])
    return doc[place], grams[place].view(np.int64)


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h, s, doc_id, first, last): the segments of anchors that occur more than once; s is the segment's hash."""
    own = anchors(docs, least)
    shared = own.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    wanted = own.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("anchors"), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for part in chunks((i, a.values.to_numpy(), t) for i, a, t in rows if a.is_valid and t):
                doc, anchor, first, last, segment = _segments([t for *_, t in part], least)
                some = np.isin(anchor, np.unique(np.concatenate([a for _, a, _ in part])))
                doc, anchor, first, last, segment = (x[some] for x in (doc, anchor, first, last, segment))
                ids = np.array([i for i, _, _ in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(segment), pa.array(ids[doc]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["h", "s", "doc_id", "first", "last"])

    found = docs.select("doc_id", "text").join(wanted, "doc_id", "left").select("doc_id", "anchors", "text").mapInArrow(scan, "h long, s long, doc_id long, first int, last int")
    return stored(found)


def distinct_segments(found: DataFrame) -> DataFrame:
    """(h, s, doc_id, first, last, n): each distinct segment at its first occurrence, and how often it occurs."""
    head = F.min(F.struct("doc_id", "first", "last")).alias("head")
    return stored(found.groupBy("h", "s").agg(head, F.count("*").alias("n")).select("h", "s", "head.doc_id", "head.first", "head.last", "n"))


def suffix_array(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of numbers, and the common prefixes of neighbours up to ``reach``, by prefix doubling."""
    n = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    span = 1
    while span < reach:
        rank = levels[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        held = key[order]
        new = np.empty(n, np.int32)
        new[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1])))
        levels.append(new)
        span *= 2
    order = np.argsort(levels[-1])  # all differ: each segment ends in a number of its own
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def _with_repeats(segments: list[bytes], least: int) -> list[int]:
    """The segments that hold a string of ``least`` bytes which stands elsewhere too, by its hash; no other has repeats."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    data = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(segments)), size)
    hashes = rolling(byte_values(data), least)
    inside = np.flatnonzero(owner[: len(hashes)] == owner[least - 1 :][: len(hashes)])
    order = inside[np.argsort(hashes[inside])]
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    return np.unique(np.concatenate((owner[order[same]], owner[order[same + 1]]))).tolist()


def maximal_repeats(segments: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(segment, start)]) of the maximal repeats of ``least`` bytes or more, with all occurrences.

    The beginning of a segment differs from every other byte before it, as what precedes it is not known.
    """
    chosen = _with_repeats(segments, least)
    if len(chosen) < 2:
        return
    segments = [segments[k] for k in chosen]
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    data = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64)
    end = np.cumsum(size)
    text = np.insert(data, end, 256 + np.arange(len(segments)))  # each segment ends in a number of its own
    owner = np.repeat(np.arange(len(segments)), size + 1)
    begin = end - size + np.arange(len(segments))
    order, common = suffix_array(text, int(size.max()) + 1)
    before = np.concatenate(([-1], text[:-1]))[order]
    before[np.isin(order, begin)] = -1 - np.arange(len(segments))[owner[order[np.isin(order, begin)]]]
    place, who = order.tolist(), owner[order].tolist()
    starts = begin.tolist()
    left = before.tolist()
    stack: list[list] = []  # [length, first row, kinds of bytes before (two suffice)]
    values = np.where(common >= least, common, 0)
    rows = np.flatnonzero(values)
    for low, high in _runs(rows):
        for row in range(low, high + 1):
            length = int(values[row]) if row < high else 0
            begins, kinds = row, {left[row]}
            while stack and stack[-1][0] > length:
                found, begins, own = stack.pop()
                own = own | kinds
                if len(own) > 1:
                    yield found, [(chosen[who[r]], place[r] - starts[who[r]]) for r in range(begins, row + 1)]
                kinds = own if len(own) < 3 else set(list(own)[:2])
            if length and stack and stack[-1][0] == length:
                stack[-1][2] = set(list(stack[-1][2] | kinds)[:2])
            elif length:
                stack.append([length, begins, kinds])
            elif not stack:
                break
        stack.clear()


def _runs(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and one after the last of each run of successive numbers."""
    if len(rows):
        breaks = np.flatnonzero(np.diff(rows) != 1) + 1
        yield from zip(rows[np.concatenate(([0], breaks))].tolist(), (rows[np.concatenate((breaks - 1, [len(rows) - 1]))] + 1).tolist(), strict=True)


def _held(segments: DataFrame) -> DataFrame:
    """(doc_id, held): the segments (h, first, last) by document."""
    return segments.groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "last")).alias("held"))


def _texts_with(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    ids, held, texts = batch.column("doc_id").to_pylist(), batch.column("held"), batch.column("text").cast(pa.binary())
    for k in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
        yield ids[k], texts[k].as_py(), held[k].as_py()


def _arrays(docs: DataFrame, segments: DataFrame, report, schema: str) -> DataFrame:
    """What ``report`` (segments as (h, doc_id, first, bytes) to a batch of ``schema``) gives for each suffix array."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in _texts_with(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o["h"] for o in own], pa.int64()), pa.array([doc] * len(own), pa.int64()), pa.array([o["first"] for o in own], pa.int32()), pa.array([text[o["first"] : o["last"]] for o in own], pa.binary())],
                    names=["h", "doc_id", "first", "segment"],
                )

    cut_out = docs.select("doc_id", "text").join(_held(segments), "doc_id", "left").select("doc_id", "held", "text").mapInArrow(slices, "h long, doc_id long, first int, segment binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "first", "segment")), strict=True):
                if held >= ARRAY_BYTES and row[0] != group[-1][0]:
                    yield report(group)
                    group, held = [], 0
                group.append(row)
                held += len(row[3])
        if group:
            yield report(group)

    return cut_out.repartition(F.col("h")).sortWithinPartitions("h", "doc_id", "first").mapInArrow(scan, schema)


def _nodes(group: list[tuple], least: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(h, length, sorted [(doc_id, segment's start, place in it)]) of each maximal repeat of some segments."""
    for length, places in maximal_repeats([g[3] for g in group], least):
        yield group[places[0][0]][0], length, sorted((group[segment][1], group[segment][2], at) for segment, at in places)


def _hot_windows(docs: DataFrame, segments: DataFrame, least: int) -> DataFrame:
    """(g, h, doc_id, first, place): digest, anchor and place of each window of the segments of hot anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in _texts_with(batch):
                data = byte_values(np.frombuffer(text, np.uint8), 1)
                for o in own:
                    windows = rolling(data[o["first"] : o["last"]], least, 1)
                    n = len(windows)
                    g = mix(windows + mix(np.array([o["h"]], np.int64).view(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(n, o["h"])), pa.array(np.full(n, doc)), pa.array(np.full(n, o["first"], np.int32)), pa.array(np.arange(n, dtype=np.int32))], names=["g", "h", "doc_id", "first", "place"])

    held = cut(_held(segments))
    held = F.broadcast(held) if held.count() <= MOST_BROADCAST else held
    return stored(docs.select("doc_id", "text").join(held, "doc_id").select("doc_id", "held", "text").mapInArrow(scan, "g long, h long, doc_id long, first int, place int"))


def _hot_nodes(docs: DataFrame, segments: DataFrame, least: int) -> DataFrame:
    """The windows of hot anchors that occur in several segments, with the first such as ``least``: (doc_id, at)."""
    rows = _hot_windows(docs, segments, least).withColumn("at", F.col("first") + F.col("place"))
    several = cut(rows.groupBy("g").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.count("*").alias("n")).where("n > 1").select("g", "least"))
    return rows.join(F.broadcast(several) if several.count() <= MOST_BROADCAST else several, "g")


def _dealt(segments: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The segments of anchors that have several: those for suffix arrays, and those of hot anchors if there are any."""
    sizes = cut(segments.groupBy("h").agg(F.count("*").alias("segments")).where("segments > 1"))
    arrays = segments.join(sizes.where(F.col("segments") <= hot).select("h"), "h")
    hottest = sizes.where(F.col("segments") > hot).select("h")
    return arrays, segments.join(hottest, "h") if hottest.limit(1).count() else None


def repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(head_id, head_start, n, length, doc_id, start): the repeats with all their occurrences, one a row.

    The first occurrence and the number of occurrences name a repeat. Every window of ``least`` bytes that occurs
    more than once lies in a repeat with exactly the window's occurrences.
    """

    def report(group: list[tuple]) -> pa.RecordBatch:
        out = [(h, k, length, doc, first, at) for k, (h, length, places) in enumerate(_nodes(group, least)) for doc, first, at in places]
        types = {"h": pa.int64(), "k": pa.int64(), "length": pa.int32(), "doc_id": pa.int64(), "first": pa.int32(), "place": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], t) for c, t in enumerate(types.values())], names=list(types))

    found = occurrences(docs, least).distinct()
    segments = distinct_segments(found)
    arrays, hottest = _dealt(segments, hot)
    nodes = _arrays(docs, arrays, report, "h long, k long, length int, doc_id long, first int, place int").withColumn("kind", F.lit("array"))
    if hottest is not None:
        nodes = nodes.unionByName(_hot_windows(docs, hottest, least).select("h", F.col("g").alias("k"), F.lit(least).alias("length"), "doc_id", "first", "place", F.lit("window").alias("kind")))
    nodes = stored(nodes)
    # folded segments, but for those that lie in others, whose repeat has more occurrences, and those of hot anchors
    whole = nodes.where("place = 0").select("h", "doc_id", "first", (F.col("first") + F.col("length")).alias("last"))
    folded = segments.where("n > 1").join(whole, ["h", "doc_id", "first", "last"], "left_anti")
    folded = folded if hottest is None else folded.join(hottest.select("h").distinct(), "h", "left_anti")
    nodes = nodes.unionByName(folded.select("h", F.col("s").alias("k"), (F.col("last") - F.col("first")).alias("length"), "doc_id", "first", F.lit(0).alias("place"), F.lit("segment").alias("kind")))
    named = nodes.join(segments.select("h", "doc_id", "first", "s"), ["h", "doc_id", "first"]).select("kind", "h", "k", "length", "place", "s")
    places = stored(named.join(found.select("h", "s", "doc_id", "first"), ["h", "s"]).select("kind", "h", "k", "length", "doc_id", (F.col("first") + F.col("place")).alias("start")))
    node = ["kind", "h", "k"]
    heads = places.groupBy(*node).agg(F.min(F.struct("doc_id", "start")).alias("head"), F.count("*").alias("n")).where("n > 1")
    placed = places.join(heads, node)
    shape = F.bit_xor(F.xxhash64("doc_id", F.col("start") - F.col("head.start")))
    groups = placed.groupBy(*node, "length", "head", "n").agg(shape.alias("shape"))
    # pieces with the same occurrences that overlap are one repeat
    same = Window.partitionBy("head.doc_id", "n", "shape").orderBy("head.start", F.desc("length"), *node)
    end = F.col("head.start") + F.col("length")
    groups = groups.withColumn("reached", F.max(end).over(same.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.coalesce((F.col("head.start") > F.col("reached")).cast("int"), F.lit(1)))
    groups = groups.withColumn("island", F.sum("new").over(same))
    island = Window.partitionBy("head.doc_id", "n", "shape", "island")
    joined = groups.withColumn("length", F.max(end).over(island) - F.col("head.start")).where("new = 1").select(*node, "head", "n", "length")
    return joined.join(places.drop("length"), node).select(F.col("head.doc_id").alias("head_id"), F.col("head.start").alias("head_start"), "n", "length", "doc_id", "start")


def later(docs: DataFrame, segments: DataFrame, least: int = LEAST, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, first, last): what occurrences but the first cover among the distinct segments, joined within each suffix array."""

    def report(group: list[tuple]) -> pa.RecordBatch:
        spans: dict[int, list[tuple[int, int]]] = {}
        for _, length, places in _nodes(group, least):
            head = min((doc, first + at) for doc, first, at in places)
            for doc, first, at in places:
                if (doc, first + at) != head:
                    spans.setdefault(doc, []).append((first + at, first + at + length))
        out = [(doc, a, b) for doc, own in spans.items() for a, b in merged(own)]
        return pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "first", "last"])

    arrays, hottest = _dealt(segments, hot)
    found = _arrays(docs, arrays, report, "doc_id long, first int, last int")
    if hottest is None:
        return found
    windows = _hot_nodes(docs, hottest, least).where(F.struct("doc_id", "at") > F.col("least"))
    return found.unionByName(windows.select("doc_id", F.col("at").alias("first"), (F.col("at") + least).alias("last")))


def removals(docs: DataFrame, least: int = LEAST, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, spans): the byte spans of later occurrences, unmerged."""
    found = occurrences(docs, least)
    segments = distinct_segments(found)
    heads = segments.where("n > 1").select("h", "s", F.col("doc_id").alias("head_id"), F.col("first").alias("head_start"))
    folded = found.join(heads, ["h", "s"]).where("doc_id > head_id or first > head_start").select("doc_id", "first", "last")
    return folded.unionByName(later(docs, segments, least, hot)).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def digest(docs: DataFrame, least: int = LEAST, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, spans, text in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text, held, at, gone, n = text or b"", [], 0, 0, 0
                for a, b in merged((s["first"], s["last"]) for s in spans or []):
                    held.append(text[at:a])
                    at, gone, n = b, gone + b - a, n + 1
                out.append((doc, len(text), gone, n, hashlib.sha256(b"".join([*held, text[at:]])).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    return docs.join(removals(docs, least, hot), "doc_id", "left").select("doc_id", "spans", "text").mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
