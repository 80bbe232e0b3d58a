"""Document fingerprints by spot signatures.

A spot is a common word (of the four languages' commonest) followed by a content word; its signature is the
chain of the two next words, hashed. The beginning of a text counts as a spot, so that every text has one. A
document's fingerprint is the sorted set of its signatures. Two sets are compared by Jaccard likeness.

``similar`` finds all pairs of distinct fingerprints of a likeness of ``THRESHOLD`` or more: fingerprints are
partitioned by set length, as sets whose lengths differ by more than the threshold cannot be that alike; within
neighbouring partitions those sharing one of their rarest signatures (a prefix that any alike set must
share in part) are candidates, and are compared.

Defined results: null and empty texts have the one signature of an empty beginning, so they are alike;
repeated rows give a row each, and of several texts of the next id the one that begins smallest counts; rows
without an id have no next document; an empty table gives no rows; further columns are ignored. All is
DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.llm.ranks import followers

# Common words that open a spot.
ANCHORS = (
    "the a an of and to in is was be it that this for with by on as at from or are "
    "der die das und den von mit zu ist sich ein eine im auf "
    "le la les des et un une en du que qui dans pour par "
    "el los las y por con su para del es"
).split()
THRESHOLD = 0.8

_MARK = "\x01"


def signatures(text: Column) -> Column:
    """The sorted set of a text's spot signatures, as 64-bit numbers."""
    words = F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # a repeated group would take a stack frame for each common word of a run
    marked = F.regexp_replace(F.regexp_replace(words, f"(?<![^ ])(?:{'|'.join(sorted(set(ANCHORS)))}) ", _MARK), f"{_MARK}+", _MARK)
    chains = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?=([^ {_MARK}]+ {_MARK}?[^ {_MARK}]+ ))"), F.lit(1))
    head = F.concat(F.lit("^"), F.substring_index(words, " ", 2))
    return F.array_sort(F.array_distinct(F.transform(F.array_append(chains, head), lambda c: F.xxhash64(c))))


def fingerprint(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, both texts' signatures and those of the next document.

    The last third of a text is replaced by the beginning of the next document, in descending order of ids.
    Texts are signed and shuffled once, by id; of the next document only the needed beginning and its signatures move.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("signatures", signatures(F.col("text")))
    texts = every.where("doc_id is not null")  # in both joins the same rows, which Spark then shuffles once
    third = F.floor(F.length(F.coalesce("text", F.lit(""))) / 3).cast("int")
    thirds = docs.select("doc_id", third.alias("third")).groupBy("doc_id").agg(F.max("third").alias("third"))
    wanted = followers(docs).join(thirds, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), "third")
    after = texts.join(wanted, "doc_id").select(F.col("to").alias("doc_id"), F.struct(F.expr("left(text, third)").alias("beginning"), "signatures").alias("next"))
    joined = texts.join(after.groupBy("doc_id").agg(F.min("next").alias("next")), "doc_id", "left")
    joined = joined.unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    new = F.expr("concat(left(text, cast(length(text) - floor(length(text) / 3) as int)), left(coalesce(next.beginning, ''), cast(floor(length(text) / 3) as int)))")
    return joined.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), new.alias("edited"), "signatures", F.coalesce("next.signatures", F.array().cast("array<bigint>")).alias("next_signatures")
    ).withColumn("edited_signatures", signatures(F.col("edited")))


def similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) for pairs of distinct fingerprints, named by their smallest ids, a < b."""
    signs = docs.select("doc_id", signatures(F.col("text")).alias("s")).groupBy("s").agg(F.min("doc_id").alias("id"))
    signs = signs.select("id", "s", F.size("s").alias("n"))
    # lengths of one partition lie within a factor of 1 / threshold: alike sets are in the same or the next one
    part = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9)
    frequency = signs.select(F.explode("s").alias("sign")).groupBy("sign").agg(F.count("*").alias("df"))
    ranked = signs.select("id", "n", F.explode("s").alias("sign")).join(frequency, "sign").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sign"))).alias("ranked"))
    prefix = ranked.withColumn("part", part).select("id", "n", "part", F.explode(F.expr(f"slice(ranked, 1, cast(n - ceil(n * {threshold} - 1e-9) + 1 as int))")).alias("x"))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("x.sign").alias("sign"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("x.sign").alias("sign"), "part")
    close = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    pairs = left.join(right, ["sign", "part"]).where((F.col("a") != F.col("b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = signs.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    y = signs.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
