"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into four segments of 16. By the pigeonhole principle three differing bits or
fewer leave one segment equal and two more that differ in a bit or none each; the choices of ``TRIPLES`` have
such a one in every case. The binary Golay code is perfect: every 23-bit word decodes to one codeword at a
distance of three or less. Of two segments that differ in a bit or none, the one's own codeword is among the
codewords to which the other, with one of its bits flipped or none, decodes: at most six. Two fingerprints
therefore meet in a key of the equal segment, the own codeword of one segment and a neighbouring codeword of
another, and of the same on the other side. An equi-join on such keys of 40 bits gives the candidates, each of
which is verified by counting the differing bits; two random fingerprints meet with a chance of some 2.5e-10.

Equal fingerprints are joined as one. Links go through connected components.

Three bits of 64 find but a quarter of the pairs whose sets of five-word shingles are alike by 0.8 or more.
``near_copies``, which the pipeline uses, therefore compares what the fingerprints link (one of each distinct
text, or more from differently mixed hashes) by the shingle sets themselves, and finds the rest by an exact
join: two sets that are alike share one of their rarest shingles (a prefix of each set in one order of all
shingles). Of texts in different groups yet that share one, each is first compared with one least text; then
all pairs that are still in different groups and share one early enough in both orders. Sketches of 512 bits,
which differ in no more bits than the sets in shingles, pass over most of the others inside the join. Groups
are thus those of all pairs, while the texts of a large group are not compared with each other again.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; texts of
fewer words than a shingle are one shingle; repeated rows are repeated in the result; an empty table gives
no rows; further columns are ignored by ``groups``. ``deduplicate`` keeps all columns, rows without an id, and
every row of an id that it keeps; null, empty and blank texts are copies of each other for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import SPACES, Words, chunks, cut, mix, rolling, stored, stretches, temporaries, text_key
from pathrank.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Of near copies: fingerprints of a text, words of a shingle and least likeness.
PRINTS = 1
#: So many ids are broadcast to the texts at most; more of them are joined by a shuffle.
MOST_BROADCAST = 2_000_000
WORDS = 5
THRESHOLD = 0.8
#: A shingle of so many texts of one slice or more counts as common, and so many of all are told apart; both only order shingles.
COMMON = 3
MOST_COMMON = 200_000
#: Texts of a block, of the texts that share a shingle.
BLOCK_TEXTS = 2000
#: Words of 64 bits of a set's sketch: bit i tells whether an odd number of shingles hash to i.
SKETCH = 8
WIDTH = 16
#: (equal segment, the two others of a key): without any one segment, that of several bits, either of two may be the equal one.
TRIPLES = tuple((equal, *sorted({0, 1, 2, 3} - {bad, equal})) for bad in range(4) for equal in ((bad + 1) % 4, (bad + 2) % 4))
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """A text's runs of ``size`` words, or all its words if they are fewer; none of a blank text."""
    words = text.lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin, end = ([0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist())
    return [joined[a:b] for a, b in zip(begin, end, strict=True)]


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    places = hashes.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((counts * 2 > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """Bit i is set if it is set in over half of the shingles' hashes; further prints mix the hashes anew."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, shingle)], "<u8")
    if not len(hashes):
        return [0] * prints
    return [_majority(hashes if m == 0 else mix(hashes + np.uint64(m * 0x9E3779B97F4A7C15 % (1 << 64)))) for m in range(prints)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, prints: int = 1) -> DataFrame:
    """doc_id and fps, its fingerprints (signed 64-bit numbers), of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist())
            values = np.array([fingerprint(t, shingle, prints) for t in texts], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(values), pa.list_(pa.int64()))], names=["doc_id", "fps"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fps array<long>")


class Golay:
    """Decoding of 23-bit words to the 12-bit numbers of their codewords."""

    def __init__(self) -> None:
        self.low = self._syndromes(np.arange(1 << 12))
        self.high = self._syndromes(np.arange(1 << 11) << 12)
        bits = 1 << np.arange(23)
        one = bits
        two = (bits[:, None] | bits[None, :])[np.triu_indices(23, 1)]
        three = np.array([a | b for a in two.tolist() for b in bits.tolist() if b > a])
        errors = np.concatenate(([0], one, two, three))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self._syndromes(errors)] = errors

    @staticmethod
    def _syndromes(words: np.ndarray) -> np.ndarray:
        rest = words.astype(np.int64)
        for k in range(22, 10, -1):
            rest = np.where((rest >> k) & 1, rest ^ (GENERATOR << (k - 11)), rest)
        return rest

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.high[words >> 12] ^ self.low[words & 0xFFF]]) >> 11

    def nearby(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of word, codeword) for the distinct codewords of each word with a bit flipped or none."""
        flipped = words[:, None] ^ np.concatenate(([0], 1 << np.arange(width)))[None, :]
        code = np.sort(self.decode(flipped), axis=1)
        new = np.concatenate((np.ones((len(words), 1), bool), code[:, 1:] != code[:, :-1]), axis=1)
        return np.nonzero(new)[0], code[new]


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(key, own_first, fp): the keys of each fingerprint of print m; one with own_first meets one without."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for low in range(0, batch.num_rows, 20_000):
                part = batch.slice(low, 20_000)
                m, fp = part.column("m").to_numpy(), part.column("fp").to_numpy()
                segments = [(fp.view(np.uint64) >> np.uint64(WIDTH * k)).astype(np.int64) & ((1 << WIDTH) - 1) for k in range(4)]
                own = [golay.decode(s) for s in segments]
                near = [golay.nearby(s, WIDTH) for s in segments]
                for tag, (equal, i, j) in enumerate(TRIPLES):
                    for own_first in (True, False):
                        row, code = near[j if own_first else i]
                        codes = own[i][row] << 12 | code if own_first else code << 12 | own[j][row]
                        key = m[row].astype(np.int64) << 43 | tag << 40 | segments[equal][row] << 24 | codes
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(row), own_first)), pa.array(fp[row])], names=["key", "own_first", "fp"])

    return distinct.select("m", "fp").mapInArrow(scan, "key long, own_first boolean, fp long")


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(m, x, y), x < y: distinct fingerprints (m, fp) of one print that differ in ``most_bits`` (three at most) or fewer."""
    if most_bits > MOST_BITS:
        raise ValueError(f"the keys find {MOST_BITS} differing bits at most")
    keys = golay_keys(distinct)
    left = keys.where("own_first").select("key", F.col("fp").alias("x"))
    right = keys.where("not own_first").select("key", F.col("fp").alias("y"))
    return left.join(right, "key").where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_bits)).select(F.shiftright("key", 43).cast("int").alias("m"), "x", "y").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that can be reached over links."""
    found = cut(fingerprints(docs, shingle).select("doc_id", F.col("fps")[0].alias("fp")))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = links(distinct.withColumn("m", F.lit(0)), most_bits)
    a = distinct.select(F.col("fp").alias("x"), F.col("least").alias("a"))
    b = distinct.select(F.col("fp").alias("y"), F.col("least").alias("b"))
    rooted = components(pairs.join(a, "x").join(b, "y").select("a", "b"))
    classes = distinct.join(rooted, distinct["least"] == rooted["node"], "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash), in order: the set of each text's runs of ``size`` words, as in ``shingles``; a blank text has 0."""
    words = Words([t.lower() for t in texts], SPACES)
    hashes = rolling(words.hashes[0], size)
    inside = np.flatnonzero(words.doc[: len(hashes)] == words.doc[size - 1 :][: len(hashes)])
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    blank = np.flatnonzero(words.counts == 0)
    owner = np.concatenate((words.doc[inside], short, blank))
    value = np.concatenate((hashes[inside], stretches(words.hashes[0], words.first[short], words.first[short] + words.counts[short]), np.zeros(len(blank), np.uint64)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order].view(np.int64)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))[: len(owner)]
    return owner[new], value[new]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        for part in chunks(zip(batch.column("doc_id").to_pylist(), (t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()), strict=True)):
            yield [i for i, _ in part], [t for _, t in part]


def _listed(ids: list[int], owner: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    n = np.bincount(owner, minlength=len(ids))
    return pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values)), n


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted set of hashes of its runs of ``words`` words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            yield pa.RecordBatch.from_arrays(list(_listed(ids, *_sets(texts, words))[:2]), names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, set array<long>")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in order, that many texts have, and about how many have them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_sets(texts, words)[1] for _, texts in _parts([batch])]
            shingle, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(shingle[n >= COMMON]), pa.array(n[n >= COMMON].astype(np.int64))], names=["shingle", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(scan, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    shingle, n = found.column("shingle").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _sketches(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A row of words for each set; two sets differ in as many shingles at least as their sketches in bits."""
    bits = (mix(values.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH)
    odd = np.bincount(owner * (64 * SKETCH) + bits, minlength=n * 64 * SKETCH).reshape(n, -1) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def prefixes(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, n, the size of its shingle set, so many of its rarest shingles, in order, that an alike set shares one of its own, and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        for ids, texts in _parts(batches):
            owner, value = _sets(texts, words)
            weight = np.zeros(len(value), np.int64)
            if len(common):
                place = np.minimum(np.searchsorted(common, value), len(common) - 1)
                weight = np.where(common[place] == value, count[place], 0)
            order = np.lexsort((value, weight, owner))  # by text; in it the rarest first, in one order of all shingles
            n = np.bincount(owner, minlength=len(ids))
            rank = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            kept = rank < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[owner]
            doc, prefix, _ = _listed(ids, owner[kept], value[order][kept])
            sketch = pa.array(list(_sketches(owner, value, len(ids))), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(n.astype(np.int32)), prefix, sketch], names=["doc_id", "n", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n int, prefix array<long>, sketch array<long>")


def _alike(docs: DataFrame, candidates: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets are alike."""
    ends = cut(candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct())
    ends = F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends
    sets = stored(shingle_sets(docs.join(ends, "doc_id", "left_semi"), words))
    compared = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return compared.where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _least_linked(edges: DataFrame) -> DataFrame:
    """(node, root): the least text that each is linked to, or the least that one is linked to; it is in the same group."""
    least = edges.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    further = least.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return least.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def _compared(rare: DataFrame, threshold: float, side: Callable[[DataFrame, str], DataFrame], alike: Column) -> DataFrame:
    """(a, b), a > b, of different groups that share a key and may be ``alike``.

    Sizes of alike sets lie in the same class or in neighbouring ones (a class spans a factor of 1 / threshold), so only
    these are compared; a key that many texts have is cut into blocks of some BLOCK_TEXTS of them, and each text meets a
    block in a task of its own.
    """
    blocks = rare.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks"))
    rows = rare.join(cut(blocks), "key").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9).cast("int"))
    there = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    here = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    here = here.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("class", F.col("class") + F.col("up"))
    once = (F.col("up") == 1) | (F.col("a") > F.col("b"))
    met = side(here, "a").join(side(there, "b"), ["key", "class", "block"]).where((F.col("a") != F.col("b")) & (F.col("ra") != F.col("rb")) & once & alike)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, prints: int = PRINTS, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) for each document that is no group's first: root is the smallest id of its group.

    Groups are linked by equal texts and by sets of ``words``-word shingles of a likeness of ``threshold`` or more. What
    is stored on the way is deleted again: the groups are materialised when they are returned.
    """
    with temporaries(docs.sparkSession):
        return _near_copies(docs, prints, words, threshold)


def _near_copies(docs: DataFrame, prints: int, words: int, threshold: float) -> DataFrame:
    texts = docs.where("doc_id is not null").select("doc_id", "text", text_key(F.coalesce("text", F.lit(""))).alias("key"))
    keys = texts.select("doc_id", "key")
    least = keys.groupBy("key").agg(F.min("doc_id").alias("least"))
    copies = keys.join(least, "key").where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    one = cut(least.select(F.col("least").alias("doc_id")))
    found = cut(fingerprints(docs, SHINGLE, prints).join(one, "doc_id", "left_semi").select("doc_id", F.posexplode("fps").alias("m", "fp")))
    distinct = cut(found.groupBy("m", "fp").agg(F.min("doc_id").alias("least")))
    same = found.join(distinct, ["m", "fp"]).where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    x = distinct.select("m", F.col("fp").alias("x"), F.col("least").alias("a"))
    y = distinct.select("m", F.col("fp").alias("y"), F.col("least").alias("b"))
    near = links(distinct).join(x, ["m", "x"]).join(y, ["m", "y"]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    candidates = cut(same.union(near).where("a <> b").distinct())
    edges = cut(_alike(docs, candidates, words, threshold).union(copies))
    grouped = cut(_least_linked(edges))

    def mixed(held: DataFrame) -> DataFrame:
        """The rows (key, place, doc_id, n, root) of shingles whose texts are in several groups, with the least text and its group."""
        by_key = held.groupBy("key").agg(F.min(F.struct("doc_id", "root", "n")).alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
        # cut before the join, which Spark can split only between shuffles: a shingle may stand in a third of all texts
        return stored(held.join(cut(by_key.where("low < high").select("key", "least")), "key"))

    def placed(held: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
        return held.join(roots, held["doc_id"] == roots["node"], "left").select("doc_id", "n", *columns, F.coalesce("root", "doc_id").alias("root"))

    # sizes and sketches allow that two sets are alike
    differing = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH)), F.lit(0))
    possible = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9) & (differing <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-6)

    def side(held: DataFrame, x: str) -> DataFrame:
        return held.withColumnsRenamed({"doc_id": x, "n": f"n{x}", "sketch": f"s{x}", "place": f"p{x}", "root": f"r{x}"})

    rare = stored(placed(prefixes(docs, words, threshold).join(one, "doc_id", "left_semi"), grouped, "prefix", "sketch"))
    sets = rare.select("doc_id", "n", "sketch")
    rare = mixed(rare.select("doc_id", "n", "root", F.posexplode("prefix").alias("place", "key")))
    # a text of another group is compared with the least text of most of its shingles, which joins large groups
    first = rare.where(F.col("root") != F.col("least.root")).groupBy(F.col("doc_id").alias("a"), F.col("least.doc_id").alias("b")).count()
    first = first.join(side(sets, "a"), "a").join(side(sets, "b"), "b").where(possible).groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    first = cut(first.join(candidates, ["a", "b"], "left_anti"))
    edges = edges.union(cut(_alike(docs, first, words, threshold)))
    grouped = cut(_least_linked(edges))
    # then with all others of other groups: before the first shingle that two alike sets share, in their order, neither has more than may differ
    rare = mixed(placed(rare.drop("root"), grouped, "key", "place")).join(sets.select("doc_id", "sketch"), "doc_id")
    rare = rare.drop("least")
    least = threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6
    early = (F.col("na") - F.col("pa") >= least) & (F.col("nb") - F.col("pb") >= least)
    others = _compared(rare, threshold, side, early & possible)
    others = cut(others.join(candidates.union(first), ["a", "b"], "left_anti"))
    return components(_alike(docs, others, words, threshold).union(edges))


def deduplicate(docs: DataFrame, prints: int = PRINTS, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without those that are not the first of their group of near copies."""
    later = near_copies(docs.select("doc_id", "text"), prints, words, threshold).select(F.col("node").alias("doc_id"))
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
