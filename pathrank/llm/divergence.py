"""How far the word frequencies of sources diverge, by run-length coded columns of counts.

Terms are counted by language and source. A language keeps the terms of enough of its documents. Each source is a
column of counts over the kept terms of its language. The vocabulary is reordered so that equal counts cluster: by
the term's total count and then by the list of its sources' counts, so that terms that a source lacks, or has as
often, stand together. Blocks of successive terms are run-length encoded for each source, and for each pair of sources
the boundaries of their runs are intersected: between two boundaries the difference of the smoothed frequencies is
one number, multiplied by the length. All numbers are integers; sums are exact.

Sources are dealt into chunks of some 32, and a task compares the columns of two chunks over one block, so memory is
bounded by the block and two chunks, and columns are sent as often as there are chunks instead of sources. What comes
out is a row for each pair, as asked for.

Skew: counts are aggregated in each batch and task before they are shuffled; a hot source is a third of the texts but,
then, no more than its vocabulary in a task's output. Ranks of terms are limited inside each task first.

Defined results: null texts have no terms, but their language and source still occur; null languages and sources are
the empty string; every row is a document, also if its id repeats or is null; a language that keeps no terms has pairs
of value 0; a source alone in its language has no pairs; an empty table gives no rows; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathrank.llm.common import byte_values, cut, separators, sliced, stretches

#: Documents of a language that a term has to be in.
LEAST_DOCS = 30
SMOOTHING, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
#: Terms of a block, and sources of a chunk on average.
BLOCK_TERMS, CHUNK_SOURCES = 4096, 32
#: Bytes of text whose terms are counted together before they leave Python.
COUNT_BYTES = 1 << 22

#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of lower-cased text.
_GAPS = separators(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _counted(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(group, occurrences, documents, term) of each term in each group of the texts."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = _GAPS[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    begin, end = edge[::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lengths + 1) - lengths - 1, begin, side="right") - 1
    pairs = np.empty(len(begin), [("group", np.int64), ("h", np.uint64), ("doc", np.int64)])
    pairs["group"], pairs["h"], pairs["doc"] = group[doc], stretches(byte_values(data), begin, end), doc
    order = np.lexsort((pairs["doc"], pairs["h"], pairs["group"]))
    pairs = pairs[order]
    term = np.flatnonzero(np.r_[True, (pairs["group"][1:] != pairs["group"][:-1]) | (pairs["h"][1:] != pairs["h"][:-1])]) if len(pairs) else np.empty(0, np.int64)
    fresh = np.r_[True, (pairs["doc"][1:] != pairs["doc"][:-1])] if len(pairs) else np.empty(0, bool)
    fresh[term] = True
    occurrences = np.diff(np.r_[term, len(pairs)])
    documents = np.add.reduceat(fresh.astype(np.int64), term) if len(term) else np.empty(0, np.int64)
    first, held = order[term], data.tobytes()
    return pairs["group"][term], occurrences, documents, [held[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in a source of a language, and the documents that have it."""
    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, COUNT_BYTES):
            keys: dict[tuple[str, str], int] = {}
            group = np.array([keys.setdefault(x, len(keys)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            group, n, df, terms = _counted(batch.column("text").cast(pa.binary()).to_pylist(), group)
            langs, sources = ([x[k] for x in keys] for k in (0, 1))
            take = lambda values, group=group: pa.array(values, pa.string()).take(pa.array(group))
            yield pa.RecordBatch.from_arrays([take(langs), take(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(df)], names=["lang", "source", "term", "n", "df"])

    counted = rows.mapInArrow(scan, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, cells): the kept terms, with an array of (source, n) of the sources that have them."""
    cells = F.array_sort(F.collect_list(F.struct("source", "n")))  # one for each source of the language at most
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("_df"), cells.alias("cells"))
    return cut(found.where(F.col("_df") >= least_docs).drop("_df"))


def _smoothed(n: Column, below: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / below), exactly."""
    above = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below.cast("decimal(22,0)"))


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, below, lang_below, chunks, chunk) of every group that occurs; ``below`` is N + 5 V."""
    groups = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(F.lit(1).alias("_one")).drop("_one")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    chunks = groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK_SOURCES).cast("int").alias("chunks"))
    found = groups.join(chunks, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    smooth = SMOOTHING * F.coalesce("v", F.lit(0))
    return cut(
        found.select("lang", "source", (F.coalesce("n", F.lit(0)) + smooth).alias("below"), (F.coalesce("lang_n", F.lit(0)) + smooth).alias("lang_below"), "chunks", F.pmod(F.xxhash64("source"), "chunks").cast("int").alias("chunk"))
    )


def run_columns(kept: DataFrame) -> DataFrame:
    """(lang, block, n_terms, source, lengths, counts): the runs of each block's column of a source that has a term there.

    The vocabulary is range-partitioned by total and number of sources (their lists would make the sample of keys that the
    driver sees large) and put into its new order in each partition. A block never leaves a partition; its first term names it.
    """
    counts = F.transform("cells", lambda c: c["n"])
    names = F.transform("cells", lambda c: c["source"])
    dealt = kept.select("lang", "total", F.size("cells").alias("spread"), names.alias("names"), counts.alias("counts"), "term").repartitionByRange("lang", "total", "spread", "term").sortWithinPartitions("lang", "total", "spread", "names", "counts", "term")

    def encode(lang: str, terms: list[tuple]) -> pa.RecordBatch:
        columns: dict[str, tuple[list[int], list[int]]] = {}
        for at, (_, names, counts) in enumerate(terms):
            for source, n in zip(names, counts, strict=True):
                ends, values = columns.setdefault(source, ([], []))
                done = ends[-1] if ends else 0
                if done < at:  # terms that the source lacks
                    ends.append(at)
                    values.append(0)
                if values and values[-1] == n and ends[-1] == at:
                    ends[-1] = at + 1
                else:
                    ends.append(at + 1)
                    values.append(n)
        for ends, values in columns.values():
            if ends[-1] < len(terms):
                ends.append(len(terms))
                values.append(0)
        lengths = [np.diff(ends, prepend=0).tolist() for ends, _ in columns.values()]
        n = len(columns)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([terms[0][0]] * n), pa.array([len(terms)] * n, pa.int32()), pa.array(list(columns)), pa.array(lengths, pa.list_(pa.int32())), pa.array([v for _, v in columns.values()], pa.list_(pa.int64()))], names=["lang", "block", "n_terms", "source", "lengths", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []
        for batch in batches:
            for own, names, counts, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "names", "counts", "term")), strict=True):
                if held and (own != lang or len(held) >= BLOCK_TERMS):
                    yield encode(lang, held)
                    held = []
                lang = own
                held.append((term, names, counts))
        if held:
            yield encode(lang, held)

    return cut(dealt.mapInArrow(scan, "lang string, block string, n_terms int, source string, lengths array<int>, counts array<long>"))


def _compared(key, table):
    """The sums of differences of each pair of sources of two chunks over one block."""
    low, high = key[2].as_py(), key[3].as_py()
    sources, chunks = table.column("source").to_pylist(), table.column("chunk").to_pylist()
    ends = [np.cumsum(x) for x in table.column("lengths").to_pylist()]
    values = [np.array(x, np.int64) for x in table.column("ps").to_pylist()]
    out: list[tuple[str, str, int]] = []
    for i in range(len(sources)):
        for j in range(len(sources)):
            if (chunks[i], chunks[j]) == (low, high) and (low < high or sources[i] < sources[j]):
                edges = np.union1d(ends[i], ends[j])
                apart = np.abs(values[i][np.searchsorted(ends[i], edges)] - values[j][np.searchsorted(ends[j], edges)])
                out.append((sources[i], sources[j], int((apart * np.diff(edges, prepend=0)).sum())))
    n = len(out)
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": pa.array([x[0] for x in out], pa.string()), "b": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language, in both directions, the sum of differences."""
    runs = run_columns(kept)
    blocks = runs.groupBy("lang", "block").agg(F.first("n_terms").alias("n_terms"))
    columns = blocks.join(groups.select("lang", "source", "below", "chunks", "chunk"), "lang").join(runs.drop("n_terms"), ["lang", "block", "source"], "left")
    columns = columns.select(
        "lang",
        "block",
        "source",
        "chunks",
        "chunk",
        F.coalesce("lengths", F.array("n_terms")).alias("lengths"),  # a source without any term of the block is one run of zeros
        F.transform(F.coalesce("counts", F.array(F.lit(0).cast("long"))), lambda n: _smoothed(n, F.col("below"))).alias("ps"),
    )
    met = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("lang", "block", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "source", "chunk", "lengths", "ps")
    sums = met.groupBy("lang", "block", "low", "high").applyInArrow(_compared, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")  # the pairs that are asked for
    return pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the kept terms that a source has more often than its language."""
    cells = kept.select("lang", F.col("term").alias("item"), "total", F.explode("cells").alias("c")).select("lang", "item", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    apart = cells.join(groups, ["lang", "source"]).withColumn("value", _smoothed(F.col("n"), F.col("below")) - _smoothed(F.col("total"), F.col("lang_below")))
    return apart.where("value > 0").select("lang", "source", "item", "value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources and each source's foremost terms."""
    docs = docs.select("lang", "source", "text")
    kept = kept_terms(docs, least_docs)
    groups = source_groups(docs, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
