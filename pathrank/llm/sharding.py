"""Sharding by balanced label propagation.

Documents are linked through keys that they share: their text, and every line of ``LEAST_LINE`` characters or
more. Each round every key names the shard that most of its documents are in, and each document moves to the
shard that its keys name with the most neighbours in all. Capacities then hold: linked documents take a shard's
places first, those beyond its quota move, neighbours together, to the shards that have places left. Shards
start as a hash of the text, so equal texts begin together.

Law ``rows``: after every round the numbers of documents of any two shards differ by one at most. A group of
copies larger than a shard is cut into as few parts as the places allow.

A key's documents are never paired: votes and uncut links are counts by key and shard, aggregated before the
shuffle, so a hot key gives a row for each shard; numbering works in cells of bounded size (hot groups are
salted), and only sizes of cells are added up over a shard.

Defined results: null texts have no bytes and count as equal to empty ones; repeated rows are documents of
their own; an empty table gives no rows; further columns are ignored. All is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import cut
from pathrank.llm.ranks import ROWS_A_WINDOW, numbered

SHARDS = 24
ROUNDS = 3
#: Bytes that a document counts beside its text.
OVERHEAD = 8
#: Lines of fewer characters link nothing.
LEAST_LINE = 60


def describe(docs: DataFrame) -> DataFrame:
    """A row for each document: id, size, checksum and the keys it has."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(line) >= LEAST_LINE)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_key"),
        F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line, F.lit(1)))).alias("line_keys"),
        F.monotonically_increasing_id().alias("row"),
    )


def links(rows: DataFrame) -> DataFrame:
    """(row, key, size): the keys that at least two documents share, and how many do."""
    long = rows.select("row", F.explode(F.array_append("line_keys", F.xxhash64("text_key", F.lit(2)))).alias("key"))
    shared = cut(long.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))  # cut, so that Spark can split a hot key's join
    return long.join(shared, "key").select("row", "key", "size")


def spread(linked: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, shard, n): how many of a key's documents are in a shard."""
    return linked.select("row", "key").join(placed.select("row", "shard"), "row").groupBy("key", "shard").agg(F.count("*").alias("n"))


def votes(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, wanted): the shard in which a document's keys have the most documents, itself included; of equals the first.

    Every shard of a key counts, not only its fullest: a key has a row for each shard, 24 at most, and is read whole.
    """
    each = linked.select("row", "key").join(counts, "key").groupBy("row", "shard").agg(F.sum("n").alias("n"))
    return each.groupBy("row").agg(F.max(F.struct("n", (-F.col("shard")).alias("to"))).alias("best")).select("row", (-F.col("best.to")).alias("wanted"))


def neighbours(linked: DataFrame, counts: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """(row, ``name``): the documents with which each linked one shares a key and its shard, counted by key."""
    here = linked.select("row", "key").join(placed.select("row", "shard"), "row")
    return here.join(cut(counts), ["key", "shard"]).groupBy("row").agg(F.sum(F.col("n") - 1).alias(name))


_CELLS = ["cell", "salt"]


def _fitted(rows: DataFrame, limits: list[int]) -> tuple[DataFrame, list[int]]:
    """``rows`` with no more than ``limits`` in a shard, and how many each then has.

    Those beyond a limit go, in the order of their groups, to the shards that have the most room.
    """
    limit = F.element_at(F.array(*[F.lit(n) for n in limits]), F.col("shard") + 1)
    ranked = cut(numbered(rows, "shard", _CELLS, ["group_key", "row"], "rank"))
    counts = dict(ranked.groupBy("shard").count().collect())  # a number for each shard
    held = [min(counts.get(s, 0), n) for s, n in enumerate(limits)]
    left = sum(counts.values()) - sum(held)
    if not left:
        return ranked.drop("rank"), held
    place, at = F.lit(None), 0
    for s in sorted(range(len(limits)), key=lambda s: (held[s] - limits[s], s)):
        room = min(limits[s] - held[s], left - at)
        if room > 0:
            place = F.when(F.col("rank") >= at, F.lit(s)).otherwise(place)
            held[s] += room
            at += room
    stay = ranked.where(F.col("rank") < limit).drop("rank")
    over = numbered(ranked.where(F.col("rank") >= limit).drop("rank").withColumn("_all", F.lit(0)), "_all", _CELLS, ["group_key", "row"], "rank")
    return stay.unionByName(over.withColumn("shard", place.cast("int")).select(*stay.columns)), held


def balanced(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``placed`` with shards of equal numbers of rows: linked documents take their places first."""
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked, held = _fitted(placed.where("loose = 0"), quota)
    loose, _ = _fitted(placed.where("loose = 1"), [q - h for q, h in zip(quota, held, strict=True)])
    return linked.unionByName(loose)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its number in the shard) of each document.

    Also linked, and links, links_before and links_after: how many documents share a key with it (counted by key),
    and how many of those are in its shard before the first round and in the end.
    """
    rows = cut(describe(docs))
    total = rows.count()
    linked = cut(links(rows))
    quota = max(1, total // shards)
    # a document stands beside those of its largest key that fits into a shard
    fits = F.when(F.col("size") <= quota, F.col("size")).otherwise(-F.col("size"))
    near = linked.groupBy("row").agg(F.max(F.struct(fits.alias("fits"), "key", "size")).alias("hub"), F.sum(F.col("size") - 1).alias("links"))
    cells = max(1, total // (shards * ROWS_A_WINDOW))
    placed = rows.join(near, "row", "left").select(
        "row",
        "doc_id",
        "size",
        "text_crc32",
        F.coalesce("hub.key", "text_key").alias("group_key"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.col("links").isNull().cast("int").alias("loose"),
        F.floor(F.pmod(F.shiftrightunsigned(F.coalesce("hub.key", "text_key"), 16), F.lit(1 << 40)) / F.lit((1 << 40) / cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("row"), F.ceil(F.coalesce("hub.size", F.lit(1)) / ROWS_A_WINDOW)).cast("int").alias("salt"),
        F.pmod(F.xxhash64("text_key"), F.lit(shards)).cast("int").alias("shard"),
    )
    placed = cut(balanced(placed, shards, total))
    counts = cut(spread(linked, placed))
    before = neighbours(linked, counts, placed, "links_before")
    for _ in range(rounds):
        moved = placed.join(votes(linked, counts), "row", "left").withColumn("shard", F.coalesce("wanted", "shard")).drop("wanted")
        placed = cut(balanced(moved, shards, total))
        counts = cut(spread(linked, placed))
    after = neighbours(linked, counts, placed, "links_after")
    both = before.join(after, "row")
    found = numbered(placed, "shard", ["loose", "cell", "salt"], ["group_key", "row"], "slot").join(both, "row", "left")
    return found.select(
        "doc_id", "size", "text_crc32", "shard", "slot", (F.col("loose") == 0).alias("linked"), "links", F.coalesce("links_before", F.lit(0)).alias("links_before"), F.coalesce("links_after", F.lit(0)).alias("links_after")
    )
