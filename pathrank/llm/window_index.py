"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Every window of successive words is represented by a winnowed fingerprint, its anchor: the smallest of the hashes
of its runs of four words, so that equal windows have equal anchors and neighbouring windows mostly share one.
The index keeps, for each anchor, the first document that has it, in immutable runs: tables bucketed and sorted
by the hash. A new batch of documents is aggregated by anchor, merge-joined with each run (the runs are not
shuffled), and its new anchors become a further run; runs of like size are compacted into one. The anchors that
a batch shares with the index, or that two of its documents share, are candidates.

Candidates are verified over the texts: the windows that they stand for are compared by 64-bit digests of
all their words, and a window is removed if its digest also occurs in a document with a smaller id. (Two
different windows of candidate anchors are taken for equal with a chance of 2^-64 a pair.) A task first folds
the windows of a slice of its documents: those that also occur in a document of the slice with a smaller id are
settled there, as runs of windows, so that a hot window sends one row a slice, and copies mostly a row each.

All windows' own hashes in the runs, instead of one of five or six, would take the disk of some 10 bytes a
word and copy, about 2.6 times the input each for the shuffle, the runs and their compaction.

Batches must come in the order of their ids. Hot anchors are aggregated before each shuffle; the join that
carries a row for each document and anchor is an ordinary one, which Spark splits where it is skewed.

Defined results: null, empty and short texts have no windows and lose nothing; repeated rows (the same id)
are one document's and do not remove each other; rows without an id lose nothing; an empty table gives no
rows; further columns, whatever their names, are kept by ``clean`` and ignored by ``removals``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathrank.llm.common import SPACES, Words, chunks, delete, free_name, leftmost_minima, mix, rolling, shared_folder, temporary

WINDOW = 13
#: Words whose hash an anchor is.
ANCHOR = 4
BATCHES = 3
#: As many runs of a level make one of the next.
FANOUT = 2
#: Windows of candidates that are folded together in a task.
SLICE_WINDOWS = 1 << 20


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its anchor's place, all hashes of runs of words)."""
    hashes = rolling(words.hashes[0], ANCHOR)
    place = leftmost_minima(hashes, window - ANCHOR + 1)
    start = np.flatnonzero(words.doc[: len(place)] == words.doc[window - 1 :][: len(place)])
    return start, place[start], hashes


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, doc_id): the distinct anchors of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for part in chunks((i, t) for i, t in rows if t and i is not None):
                words = Words([t for _, t in part], SPACES)
                _, place, hashes = _anchors(words, window)
                place = np.unique(place)
                pairs = np.empty(len(place), [("doc", np.int64), ("h", np.int64)])
                pairs["doc"], pairs["h"] = words.doc[place], hashes[place].view(np.int64)
                pairs = np.unique(pairs)
                ids = np.array([i for i, _ in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs["h"])), pa.array(ids[pairs["doc"]])], names=["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(scan, "h long, doc_id long")


class FingerprintIndex:
    """Runs of (h, first document), each a bucketed table, newest last.

    An index with a ``name`` outlives its session: opened again under that name (in the same folder), it goes on with the
    runs that it had, so that a new batch is compared with all earlier ones. Which runs it has is a small table that is written
    anew, under the next number, after each change; the newest one counts, and runs that it does not name are deleted.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, name: str | None = None, folder: str | None = None) -> None:
        self.spark, self.window, self.kept = spark, window, name is not None
        self.name = f"window_index_{name or uuid.uuid4().hex}"
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # level, table
        self.made = self.state = 0
        if self.kept:
            self._open()

    def _states(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        done = [int(n.removeprefix("state-")) for n in names if n.startswith("state-")]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in done if files.exists(hadoop(f"{self.folder}/state-{n}/_SUCCESS")))

    def _open(self) -> None:
        """Takes up the runs of the newest state."""
        states = self._states()
        if not states:
            return
        self.state = states[-1]
        rows = self.spark.read.parquet(f"{self.folder}/state-{self.state}").orderBy("place").collect()  # a row for each run
        self.made = max(r["made"] for r in rows)
        for r in rows:
            if r["window"] != self.window:
                raise ValueError(f"{self.name} indexes windows of {r['window']} words")
            self.buckets = r["buckets"]
            if r["table"]:
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r['table']} (h BIGINT, first BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {r['buckets']} BUCKETS LOCATION '{self.folder}/{r['table']}'")
                self.runs.append((r["level"], r["table"]))

    def _save(self, gone: Iterable[str] = ()) -> None:
        """Makes the runs, as they are now, those of the index; then ``gone`` can be deleted."""
        if self.kept:
            rows = [(k, level, table, self.buckets, self.window, self.made) for k, (level, table) in enumerate(self.runs or [(0, "")])]
            self.state += 1
            self.spark.createDataFrame(rows, "place int, level int, table string, buckets int, window int, made int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state-{self.state}")
            for old in self._states()[:-1]:
                delete(self.spark, f"{self.folder}/state-{old}")
        for table in gone:
            self._drop(table)

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        path = f"{self.folder}/{table}"
        delete(self.spark, path)  # what a session that was lost may have left
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(table))
        self.runs.append((level, table))

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, f"{self.folder}/{table}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch whose ids follow those before; (doc_id, h) of the candidates it brings, old documents' too."""
        own = anchors(docs, self.window)
        found = own.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("old", F.lit(None).cast("long"))
        for _, table in self.runs:
            run = self.spark.table(table).select("h", F.col("first").alias("held"))
            found = found.join(run.hint("merge"), "h", "left").select("h", "first", "n", F.coalesce("old", "held").alias("old"))
        run = uuid.uuid4().hex
        stored = f"{self.folder}/found-{run}"
        found.write.parquet(stored)
        found = self.spark.read.parquet(stored)
        shared = found.where("old is not null or n > 1")
        candidates = own.join(shared.select("h"), "h").select("doc_id", "h").union(shared.where("old is not null").select(F.col("old").alias("doc_id"), "h"))
        kept = temporary(f"{self.folder}/candidates-{run}")
        candidates.write.option("compression", "zstd").parquet(kept)
        self._write(found.where("old is null").select("h", "first"), 0)
        delete(self.spark, stored)
        self.compact()
        return self.spark.read.parquet(kept)

    def compact(self) -> None:
        """Merges the newest runs while as many as FANOUT are of one level."""
        gone = []
        while len(last := self.runs[-FANOUT:]) == FANOUT and len({level for level, _ in last}) == 1:
            merged = self.spark.table(last[0][1])
            for _, table in last[1:]:
                merged = merged.unionByName(self.spark.table(table))
            del self.runs[-FANOUT:]
            self._write(merged.repartition(self.buckets, "h"), last[0][0] + 1)
            if self.kept:
                gone += [table for _, table in last]
                continue
            for _, table in last:
                self._drop(table)
        self._save(gone)

    def removals(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Indexes a batch; (doc_id, spans) of its documents that have windows to remove, as ``verified`` gives them.

        ``history``: the documents of earlier batches, as they were indexed; of these only those that share an anchor are compared.
        """
        candidates = self.add(docs)
        every = docs.select("doc_id", "text") if history is None else docs.select("doc_id", "text").unionByName(history.select("doc_id", "text"))
        some = every.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
        return verified(some, candidates, self.window).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")

    def close(self) -> None:
        """Ends the session: an index without a name is deleted, one with a name stays."""
        if not self.kept:
            self.drop()

    def drop(self) -> None:
        """Deletes the index."""
        for _, table in self.runs:
            self._drop(table)
        if self.kept:
            delete(self.spark, self.folder)
        self.runs = []


def _folded(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Windows (digest, document, first word) of a slice as rows: those settled in the slice as runs, the others one by one."""
    digest, doc, word = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, digest))
    d = digest[order]
    group = np.cumsum(np.concatenate(([True], d[1:] != d[:-1]))) - 1
    first = doc[order][np.flatnonzero(np.diff(group, prepend=-1))]
    known = np.empty(len(order), bool)
    known[order] = doc[order] > first[group]
    open_ = ~known
    yield _batch(digest[open_], doc[open_], word[open_], word[open_] + 1, False)
    doc, word = doc[known], word[known]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + 1))))[: len(doc)]
    end = word[np.concatenate((begin[1:] - 1, [len(doc) - 1]))] + 1 if len(doc) else word
    # runs take part in the shuffle by a number of their own, so that no task gets all of them
    yield _batch(mix(doc[begin].astype(np.uint64) + (word[begin].astype(np.uint64) << np.uint64(40))).view(np.int64), doc[begin], word[begin], end, True)


def _batch(digest: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, known: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.full(len(doc), known))], names=["d", "doc_id", "first", "last", "known"])


def _windows(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """(d, doc_id, first, last, known): digest and first word of the windows that candidates stand for.

    A row that is known stands for the windows that start from ``first`` to before ``last``, and are to be removed.
    """
    by_doc = candidates.groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("anchors"), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for part in chunks((i, a.values.to_numpy(), t) for i, a, t in rows if a.is_valid and t):
                words = Words([t for _, _, t in part], SPACES, 2)
                start, place, hashes = _anchors(words, window)
                wanted = np.unique(np.concatenate([a for _, a, _ in part]))
                start = start[np.isin(hashes[place].view(np.int64), wanted)]
                own = words.doc[start]
                held.append((rolling(words.hashes[1], window, 1)[start].view(np.int64), np.array([i for i, _, _ in part], np.int64)[own], start - words.first[own]))
                n += len(start)
                if n >= SLICE_WINDOWS:
                    yield from _folded(held)
                    held, n = [], 0
        if n:
            yield from _folded(held)

    # the join is a left one, so that the shuffled texts are the same as those of the last join, and are shuffled once
    return docs.select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", "anchors", "text").mapInArrow(scan, "d long, doc_id long, first int, last int, known boolean")


def removals(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, spans): for each document that has any, the windows to remove, as runs of their first words."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window)
    edges = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(x) for x in edges})
    candidates = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs.where("doc_id is not null")
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        new = index.add(part)
        candidates = new if candidates is None else candidates.unionByName(new)
    index.close()
    return verified(docs, candidates, window)


def verified(docs: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): the windows of candidates (doc_id, h) that also start in a document with a smaller id."""
    first = F.min(F.when(~F.col("known"), F.col("doc_id"))).over(Window.partitionBy("d"))
    later = _windows(docs, candidates, window).withColumn("least", first).where(F.col("known") | (F.col("doc_id") > F.col("least")))
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _kept(texts: list[bytes], spans: list[tuple[np.ndarray, np.ndarray] | None], window: int) -> Iterator[tuple[int, np.ndarray, Words, int]]:
    """For each text: number of words, flags of removed words, the words' arrays and the text's index."""
    words = Words(texts, SPACES)
    for k, own in enumerate(spans):
        n = int(words.counts[k])
        gone = np.zeros(n + 1, np.int64)
        if own is not None:
            np.add.at(gone, own[0], 1)
            np.add.at(gone, np.minimum(own[1] - 1 + window, n), -1)
        yield n, np.cumsum(gone)[:-1] > 0, words, k


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    for own in column:
        yield (own.values.field("first").to_numpy(), own.values.field("last").to_numpy()) if own.is_valid else None


def _pieces(words: Words, k: int, gone: np.ndarray, text: bytes) -> list[bytes]:
    a = words.first[k]
    begin, end = (words.begin[a : a + len(gone)] - words.bases[k])[~gone], (words.end[a : a + len(gone)] - words.bases[k])[~gone]
    return [text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]


def digest(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    import hashlib

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = zip(batch.column("doc_id").to_pylist(), _spans(batch.column("spans")), (t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()), strict=True)
            for part in chunks(rows):
                out = []
                texts = [t for *_, t in part]
                for (doc, _, text), (n, gone, words, k) in zip(part, _kept(texts, [s for _, s, _ in part], window), strict=True):
                    kept = b" ".join(_pieces(words, k, gone, text)) if gone.any() else b" ".join(text.split())
                    out.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    joined = docs.join(removals(docs, window, batches), "doc_id", "left").select("doc_id", "spans", "text")
    return joined.mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """``docs`` with all its columns; removed words, and the white space after them, are cut from the text."""
    name = free_name(docs, "spans")

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for j, (own, t) in enumerate(zip(_spans(batch.column(name)), texts, strict=True)):
                if own is None or not t:
                    continue
                ((_, gone, words, _),) = _kept([t], [own], window)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                held, at = [], 0
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    held.append(t[at : words.begin[a]])
                    at = words.begin[b] if b < len(gone) else len(t)
                texts[j] = b"".join([*held, t[at:]])
            out = batch.drop_columns([name])
            yield out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))

    found = removals(docs.select("doc_id", "text"), window, batches).withColumnRenamed("spans", name)
    return docs.join(found, "doc_id", "left").select(*docs.columns, name).mapInArrow(scan, docs.schema)
