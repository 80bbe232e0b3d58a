"""Each operator against a plain version on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgßé") for _ in range(rng.randint(2, 7))) for _ in range(300)] + ["the", "of", "and", "mit"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = prose(40), prose(30_000)
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [None, "", "   \n\t ", "x", "the", "The the THE of", "ÀÉ 東京 ﬁ", "a\x1cb\xa0c", "same same " * 40, "y" * 500, "the " * 300]
    texts += [prose(5) + " " + passage + " " + prose(7) for _ in range(6)] + [passage, passage, passage + ".", passage.upper()]
    texts += [long, long + " end", texts[0], texts[0], texts[1] + " tail", "mit license mit license", "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."]
    spots = [f"the {rng.choice(vocabulary)} {rng.choice(vocabulary)}" for _ in range(80)]
    texts += [" ".join(spots), " ".join([*spots[:40], "of x y", *spots[40:]]), " ".join(spots[5:])]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(1).shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("h", "n", "fp", "spans", "row", "shard", "anchors"):  # names that operators use inside
        df = df.withColumn(c, F.lit("?"))
    return df.withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(spark, docs, rows, nothing):
    from pathrank.llm.sharding import shard

    twice = docs.unionByName(docs.where("doc_id < 30"))
    found = shard(twice, shards=5).toPandas()
    assert len(found) == twice.count()
    counts = found.groupby("shard").size()
    assert len(counts) == 5 and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in found.groupby("shard").slot)
    text = dict(rows)
    for r in found.itertuples():
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    found["text"] = [text[i] or "" for i in found.doc_id]
    spread = found.groupby("text").shard.nunique()
    assert (spread > 1).sum() <= 5
    assert shard(nothing).count() == 0
    # a group of copies larger than a shard is cut into as few parts as places allow
    copies = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, F.lit("one text")).otherwise(F.col("id").cast("string")).alias("text"))
    one = shard(copies, shards=10).join(copies.where("text = 'one text'").select("doc_id"), "doc_id")
    assert one.select("shard").distinct().count() <= 6


def test_votes_bring_neighbours_together(spark):
    from pathrank.llm.sharding import links, spread, votes

    described = spark.createDataFrame([(0, 1, [7]), (1, 2, [7, 8]), (2, 3, [9, 7]), (3, 9, []), (4, 1, [5])], "row long, text_key long, line_keys array<long>")
    placed = spark.createDataFrame([(0, 4), (1, 4), (2, 0), (3, 1), (4, 2)], "row long, shard int")
    linked = links(described)
    assert sorted((r.row, r.size) for r in linked.collect()) == [(0, 2), (0, 3), (1, 3), (2, 3), (4, 2)]
    counts = spread(linked, placed)
    assert {tuple(r) for r in votes(linked, counts).collect()} == {(0, 4), (1, 4), (2, 4), (4, 2)}


def test_votes_count_every_neighbour(spark):
    """A round of votes against brute force; a document between two keys goes where both have neighbours."""
    from pathrank.llm.sharding import spread, votes

    pairs = [(0, 1), (0, 2), *[(k, 1) for k in range(1, 10)], *[(k, 2) for k in range(10, 17)]]
    shards = {0: 3, **{k: 0 for k in range(1, 6)}, **{k: 1 for k in range(6, 10)}, **{k: 1 for k in range(10, 14)}, **{k: 2 for k in range(14, 17)}}
    rng = random.Random(4)
    more = [(100 + k, 10 + rng.randrange(40)) for k in range(200) for _ in range(3)]
    pairs, shards = [*pairs, *set(more)], {**shards, **{100 + k: rng.randrange(8) for k in range(200)}}
    linked = spark.createDataFrame(pairs, "row long, key long")
    placed = spark.createDataFrame(list(shards.items()), "row long, shard int")
    found = {r.row: r.wanted for r in votes(linked, spread(linked, placed)).collect()}
    want = {}
    for row in {r for r, _ in pairs}:
        n = [0] * 8
        for r, key in pairs:
            if r == row:
                for other, k in pairs:
                    n[shards[other]] += k == key
        want[row] = n.index(max(n))
    assert found == want and found[0] == 1


def test_propagation_cuts_fewer_links(spark):
    from pathrank.llm.sharding import shard

    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(70))
    shared = [line() for _ in range(60)]
    texts = ["\n".join([line(), shared[k % 60], line()]) for k in range(600)]
    rng.shuffle(texts)
    found = shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).toPandas()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.split("\n")[1], []).append(i)
    place = dict(zip(found.doc_id, found.shard, strict=True))
    inside = {i: sum(place[i] == place[j] for j in own) - 1 for own in groups.values() for i in own}
    assert dict(zip(found.doc_id, found.links_after, strict=True)) == inside and set(found.links) == {9}
    assert found.links_after.sum() > 0.7 * found.links.sum() > 2 * found.links_before.sum()


def test_toxicity(spark, nothing):
    from pathrank.llm import toxicity

    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    data = []
    for i in range(600):
        sentences = [" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(rng.randint(1, 8))]
        toxic = i % 4 == 0
        if toxic:
            sentences.insert(rng.randint(0, len(sentences)), f"you utter {rng.choice(['scum', 'moron'])} there")
        data.append((i, ". ".join(sentences) + ".", int(toxic)))
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.where("doc_id < 400"), table.select("doc_id", "toxic").where("doc_id < 400"))
    found = by_id(toxicity.score(table, model))
    assert all((found[i].score >= 0.7) == bool(y) for i, _, y in data if i >= 400)
    for i, text, y in data:
        for s in found[i].sentences:
            assert y and re.search("scum|moron", text[s["first"] : s["last"]])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you utter scum there. " * 2000), (4, "clean words only. " * 20_000)], "doc_id long, text string")
    scores = by_id(toxicity.score(odd, model))
    assert scores[1].score == scores[2].score == scores[4].score < 0.1 < 0.7 < scores[3].score
    assert [r.doc_id for r in toxicity.reject(odd, model).collect()] == [1, 2, 4]
    assert toxicity.fit(table, table.select("doc_id", F.lit(1).alias("toxic"))).weights == {}
    assert toxicity.fit(nothing, nothing.select("doc_id", F.lit(1).alias("toxic"))).score("scum") < 0.1
    assert toxicity.score(nothing, model).count() == 0


def test_maximal_repeats_of_a_few_strings():
    from pathrank.llm.suffix_repeats import maximal_repeats

    rng = random.Random(2)
    for _ in range(60):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 14))).encode() for _ in range(rng.randint(2, 4))]
        least = rng.randint(2, 4)
        want = set()
        for length in range(least, 15):
            held = {}
            for k, s in enumerate(strings):
                for a in range(len(s) - length + 1):
                    held.setdefault(s[a : a + length], []).append((k, a))
            for places in held.values():
                left = {strings[k][a - 1 : a] if a else (k, "start") for k, a in places}
                right = {strings[k][a + length : a + length + 1] or (k, "end") for k, a in places}
                if len(places) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((length, tuple(sorted(places))))
        got = {(n, tuple(sorted(p))) for n, p in maximal_repeats(strings, least)}
        assert got == want


def repeats_plainly(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            s = b[k : k + least]
            if s in seen:
                gone[k : k + least] = b"\1" * least
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_repeats(docs, rows, nothing):
    from pathrank.llm.suffix_repeats import digest

    for least, hot in ((100, 2000), (40, 2000), (40, 2)):
        assert {r[0]: tuple(r)[1:] for r in digest(docs, least, hot).collect()} == repeats_plainly(rows, least)
    assert digest(nothing).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_have_all_their_occurrences(spark, nothing, hot):
    from pathrank.llm.suffix_repeats import repeats

    rng, least = random.Random(21), 40
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, line, long = noise(150), noise(60), noise(900)
    texts = [noise(300) for _ in range(8)] + [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) for _ in range(6)]
    texts += [noise(20) + line + noise(30) + line + noise(20) for _ in range(5)] + [long, "x" + long, long[:500], long[100:800] + passage, passage[20:120], "ab" * 150, None, ""]
    texts += [texts[0], texts[0], passage[:70] + noise(9) + passage[70:]]
    data = {3 * k: (t or "").encode() for k, t in enumerate(texts)}
    frame = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {}
    for r in repeats(frame, least, hot).collect():
        found.setdefault((r.head_id, r.head_start, r.n, r.length), []).append((r.doc_id, r.start))
    for (doc, start, n, length), places in found.items():
        s = data[doc][start : start + length]
        want = [(i, k) for i, b in data.items() for k in range(len(b) - length + 1) if b[k : k + length] == s]
        assert length >= least and len(want) > 1 and sorted(places) == want and want[0] == (doc, start) and n == len(want)
    assert any(length >= 300 for *_, length in found)  # much longer than a segment
    windows = {}
    for i, b in data.items():
        for k in range(len(b) - least + 1):
            windows.setdefault(b[k : k + least], []).append((i, k))
    for places in windows.values():
        if len(places) > 1:
            (doc, at), n = places[0], len(places)
            assert any(d == doc and a <= at and at + least <= a + size and m == n for d, a, m, size in found)
    assert repeats(nothing).count() == 0


def chains(text):
    """Spot signatures before they are hashed."""
    from pathrank.llm.spotsigs import ANCHORS

    tokens = [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]
    out = ["^" + (" ".join(tokens[:2]) if len(tokens) > 1 else "".join(tokens) + " ")]
    for k in range(len(tokens) - 1):
        if tokens[k] in ANCHORS and tokens[k + 1] not in ANCHORS:
            later = next((j for j in range(k + 2, len(tokens)) if tokens[j] not in ANCHORS), None)
            if later is not None:
                out.append(f"{tokens[k + 1]} " + "\x01" * (later > k + 2) + f"{tokens[later]} ")
    return out


def hashed(spark, lists):
    """Each list's sorted set of hashes."""
    frame = spark.createDataFrame(list(lists.items()), "key string, chains array<string>")
    return {r.key: r.h for r in frame.select("key", F.array_sort(F.array_distinct(F.transform("chains", lambda c: F.xxhash64(c)))).alias("h")).collect()}


def test_repeated_rows_of_spot_signatures(spark):
    from pathrank.llm.spotsigs import edited

    rows = [(5, "the five words here one"), (5, "the five words here one"), (5, "another text of id five, longer"), (6, "six of these"), (6, "six of them"), (7, "seven is the last"), (None, "no id")]
    found = edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == sorted((i or 0, len(t)) for i, t in rows)
    after = {7: "six of them", 6: "another text of id five, longer", 5: "seven is the last", None: ""}  # of an id's texts the one that begins smallest
    assert sorted(r.edited for r in found) == sorted(t[: len(t) - len(t) // 3] + after[i][: len(t) // 3] for i, t in rows)


def test_spot_signatures(spark, docs, rows, nothing):
    from pathrank.llm.spotsigs import edited, fingerprint, likeness, signatures, similar

    text, ids = dict(rows), sorted((i for i, _ in rows), reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    found = by_id(edited(docs))
    prints = {}
    plain = hashed(spark, {t or "": chains(t or "") for t in text.values()})
    for i, t in rows:
        t, n = t or "", len(t or "") // 3
        assert found[i].edited == t[: len(t) - n] + (text[after[i]] or "")[:n]
        assert found[i].n_chars == len(t) and found[i].signatures
        assert prints.setdefault(t, found[i].signatures) == found[i].signatures
        assert found[i].next_signatures == found[after[i]].signatures
        assert found[i].signatures == plain[t]
    assert edited(nothing).count() == 0
    sets = {tuple(r.signatures): min(x.doc_id for x in found.values() if x.signatures == r.signatures) for r in found.values()}
    want = {}
    for x, a in sets.items():
        for y, b in sets.items():
            j = len({*x} & {*y}) / len({*x} | {*y})
            if a < b and j >= 0.8:
                want[a, b] = round(j, 9)
    assert want
    assert {(r.a, r.b): round(r.likeness, 9) for r in similar(docs).collect()} == want
    assert spark.range(1).select(F.size(signatures(F.repeat(F.lit("the of "), 200_000)))).first()[0] == 1
    one = spark.range(1).select(signatures(F.lit("the cat of sat on a mat")).alias("s")).select(fingerprint(F.col("s")).alias("f"), likeness(F.col("s"), F.col("s")).alias("j")).first()
    assert len(one.f) % 16 == 0 and one.j == 1.0


def test_licenses(docs, rows, nothing):
    from pathrank.llm.licenses import PHRASES, scan

    found = by_id(scan(docs))
    for i, t in rows:
        w, hits, labels = PLAIN.findall(lowered(t)), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hits.append(k)
                    labels.add(label)
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(hits, default=None), max(hits, default=None), sorted(labels))
        assert 0 <= r.score <= 1
    assert scan(nothing).count() == 0


def licenses_plainly(rows):
    """(found labels, score) of each text: every template against every place."""
    from pathrank.llm.licenses import LEAST_SCORE, PHRASES, TEMPLATES

    texts = [PLAIN.findall(lowered(t)) for _, t in rows]
    idf = lambda w: round(math.log((len(texts) + 1) / (sum(w in t for t in texts) + 1)) + 1e-3, 6)
    holds = lambda t, p: any(t[k : k + len(p)] == p for k in range(len(t)))
    patterns = [(label, p.split(), p.split(), True) for p, label in PHRASES.items()] + [(label, k.split(), n.split(), False) for label, k, n in TEMPLATES]
    weights = {w: idf(w) for *_, n, _ in patterns for w in n}
    out = []
    for t in texts:
        labels, best = set(), 0.0
        for label, key, notice, exact in patterns:
            if not holds(t, key):
                continue
            for start in range(-len(notice), len(t)):
                met = [w for k, w in enumerate(notice) if 0 <= start + k < len(t) and t[start + k] == w]
                score = min(1.0, round(sum(weights[w] for w in met) / sum(weights[w] for w in notice), 6))
                if len(met) == len(notice) if exact else score >= LEAST_SCORE:
                    labels.add(label)
                    best = max(best, score)
        out.append((sorted(labels), best))
    return out


def test_license_labels_and_scores(spark, rows):
    from pathrank.llm.licenses import TEMPLATES, scan

    rng, more = random.Random(17), []
    for k, (_, _, notice) in enumerate(TEMPLATES * 3):
        w = notice.split()
        kept = [x for x in w if rng.random() > 0.06 * (k % 4)]  # words are missing, which breaks the alignment
        other = rng.choice(TEMPLATES)[2]
        more.append(" ".join(["code", *kept, "and", *(rng.choice(w) if rng.random() < 0.1 * (k % 5) else x for x in w), "\n", other.upper() if k % 2 else ""]))
    data = list(enumerate([*(t for _, t in rows), *more]))
    found = by_id(scan(spark.createDataFrame(data, "doc_id long, text string").repartition(3)))
    for (i, _), (labels, score) in zip(data, licenses_plainly(data), strict=True):
        assert found[i].found_labels == labels and abs(found[i].score - score) < 2e-6
    assert len({label for r in found.values() for label in r.found_labels}) > 12


def test_licenses_of_a_bundle_do_not_lower_each_other(spark):
    from pathrank.llm.licenses import TEMPLATES, scan

    notices = {label: notice for label, _, notice in reversed(TEMPLATES)}
    common = "redistribution and use in source and binary forms with or without modification are permitted"  # BSD's words are the commoner
    rows = [(1, notices["mit"] + ". " + notices["bsd"]), (2, notices["bsd"]), (3, "\n".join(notices.values()))] + [(10 + k, common) for k in range(40)] + [(100 + k, "other words") for k in range(60)]
    found = by_id(scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[1].found_labels == ["bsd", "mit"] and found[2].found_labels == ["bsd"]
    assert found[1].score == found[2].score == 1.0
    assert set(found[3].found_labels) >= set(notices)


def test_decontamination(spark, docs, rows, nothing):
    from pathrank.llm.decontaminate import brute_force, clean, digest, find

    text = [t for _, t in rows]
    items = [("b", text[75][20:220]), ("a", text[0]), ("short", "the of"), ("one", "東京"), ("none", "..."), ("null", None), ("again", text[0])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = {r[0]: r[1:] for r in brute_force(rows, items)}
    assert sum(r[-1] for r in want.values()) > 5
    for block in (1 << 20, 60):
        assert {r[0]: tuple(r)[1:] for r in digest(find(docs, benchmark, block_bytes=block)).collect()} == want
    kept = by_id(clean(docs, benchmark))
    assert all(kept[i].text == t for i, t in rows if not want[i][-1])
    assert kept[rows[0][0]].text == "" and kept[rows[0][0]].h == "?"
    none = digest(find(docs, benchmark.where("false"))).collect()
    assert {r.doc_id: r.n_words for r in none} == {i: r[0] for i, r in want.items()} and not any(r.contaminated for r in none)
    assert digest(find(nothing, benchmark)).count() == clean(nothing, benchmark).count() == 0


def test_decontamination_blocks_see_the_same_text(spark):
    from pathrank.llm.decontaminate import brute_force, clean, digest, find

    words = [f"w{k}x" for k in range(40)]
    # windows of different items overlap: words 1-10, 6-15; what remains after a cut must not form a window either
    items = [(f"i{k}", " ".join(words[k : k + 10])) for k in range(0, 30, 5)] + [("joined", "left one two three four five six seven eight right")]
    texts = ["lead " + " ".join(words[:15]) + " tail", " ".join(words), "left one two three " + " ".join(words[5:15]) + " four five six seven eight right", "clean text", None]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[0]), (None, texts[3]), (2, texts[2]), (3, texts[4])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    null_last = lambda x: sorted((tuple(r) for r in x), key=lambda r: tuple((v is None, str(v)) for v in r))
    for block in (1 << 20, 60):
        assert null_last(digest(find(docs, benchmark, block_bytes=block)).collect()) == null_last(brute_force(rows, items))
        kept = null_last(clean(docs, benchmark, block_bytes=block).collect())
        assert kept == null_last([(1, "lead  tail"), (1, " " + " ".join(words[35:])), (1, "lead  tail"), (None, "lead  tail"), (None, "clean text"), (2, "left one two three  four five six seven eight right"), (3, None)])


def test_golay_keys_meet():
    from pathrank.llm.simhash import Golay

    golay, rng = Golay(), np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    row, code = golay.nearby(words, 23)
    assert set(np.bincount(row).tolist()) <= {1, 6}
    near = [set(code[row == k].tolist()) for k in range(len(words))]
    for k, w in enumerate(words.tolist()):
        other = w ^ (1 << int(rng.integers(23)))
        assert int(golay.decode(np.array([other]))[0]) in near[k]


def test_simhash(spark, docs, rows, nothing):
    import xxhash

    from pathrank.llm.simhash import deduplicate, groups, links

    def plainly(t):
        w = WORDS.findall(lowered(t))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    found = by_id(groups(docs))
    prints = {i: plainly(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == prints
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and least[a] > least[b]:
                    least[a], changed = least[b], True
    assert {i: r.component_id for i, r in found.items()} == least
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORDS.findall(lowered(t))) else frozenset() for i, t in rows}
    kept = {r.doc_id for r in deduplicate(docs).collect()}
    same = {}
    for i, t in sorted(rows):
        same.setdefault(t or "", i)
    assert all(i not in kept for i, t in rows if same[t or ""] != i)
    alone = [i for i in sets if all(i == j or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for j in sets)]
    assert set(alone) <= kept and len(kept) < len(same)
    assert groups(nothing).count() == deduplicate(nothing).count() == 0
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in base for k in (0, 1, 2, 3, 4, 5)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.x, r.y) for r in links(spark.createDataFrame([(3, v) for v in signed], "m int, fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}


@pytest.mark.parametrize("block", [2000, 5])
def test_near_copies_are_all_found(spark, monkeypatch, block):
    from pathrank.llm import simhash
    from pathrank.llm.simhash import deduplicate

    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    line, texts = " ".join(rng.choice(vocabulary) for _ in range(12)), []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(4):  # scattered edits: about 0.75 to 0.95 of the shingles stay alike
            w = list(base)
            for at in rng.sample(range(len(w)), max(1, int(len(w) * rng.uniform(0.005, 0.03)))):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        texts.append(line + f" {k}")
        texts.append(texts[-2].upper())
    texts += ["", " ", None, "a b", "A  b", "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORDS.findall(lowered(t))) else frozenset() for i, t in rows}
    least = {i: i for i in sets}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in alike):
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    got = sorted(r.doc_id for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted({*least.values()})


def test_components(spark):
    from pathrank.llm.components import components

    rng = random.Random(9)
    chain = rng.sample(range(1000), 120)
    edges = list(zip(chain, chain[1:], strict=False)) + [(2000, 2001), (2001, 2002), (2003, 2003)] + [(3000, 3000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(chain) for n in chain if n != min(chain)} | {2001: 2000, 2002: 2000} | {3000 + k: 3000 for k in range(1, 50)}
    assert got == want


def windows_plainly(rows, window=13):
    first, words = {}, {i: WORDS.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_window_index(spark, docs, rows, nothing):
    from pathrank.llm.window_index import clean, digest

    want = windows_plainly(rows)
    for batches in (1, 4):
        assert {r[0]: tuple(r)[1:] for r in digest(docs, batches=batches).collect()} == want
    kept = by_id(clean(docs))
    for i, t in rows:
        words = WORDS.findall(kept[i].text or "")
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[i][2]
        assert kept[i].h == "?" and (want[i][1] or kept[i].text == t)
    assert digest(nothing).count() == clean(nothing).count() == 0
    twice = spark.createDataFrame([(7, odd_texts()[0] * 3)] * 2 + [(None, odd_texts()[0] * 3)], "doc_id long, text string")
    assert [r.n_removed for r in digest(twice).collect()] == [0, 0, 0]


def test_runs_are_compacted(spark, docs):
    from pathrank.llm.window_index import FingerprintIndex

    index = FingerprintIndex(spark)
    for low in (0, 60, 120, 180):
        index.add(docs.where(f"doc_id >= {low} and doc_id < {low + 60}"))
    assert [level for level, _ in index.runs] == [2]
    run = spark.table(index.runs[0][1])
    assert run.count() == run.select("h").distinct().count()
    index.close()


def test_an_index_is_opened_again(spark, rows, tmp_path):
    """Three sessions, each with the removals of its batch against all earlier ones."""
    from pathrank.llm.window_index import FingerprintIndex

    known = sorted((i, t) for i, t in rows if i is not None)
    known = [(k, t) for k, (_, t) in enumerate(known)]
    texts = {i: WORDS.findall(t or "") for i, t in known}
    first = {}
    for i, w in texts.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {i: {k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i} for i, w in texts.items()}
    edges = [0, 30, 61, len(known)]
    everything = spark.createDataFrame(known, "doc_id long, text string").persist()
    for low, high in zip(edges, edges[1:], strict=False):
        index = FingerprintIndex(spark, name="sessions", folder=str(tmp_path))
        assert bool(index.runs) == (low > 0)
        found = index.removals(everything.where(f"doc_id >= {low} and doc_id < {high}"), everything.where(f"doc_id < {low}"))
        got = {r.doc_id: {k for s in r.spans for k in range(s["first"], s["last"])} for r in found.collect()}
        assert got == {i: ks for i, ks in want.items() if low <= i < high and ks}
        index.close()
        for _, table in index.runs:  # another session's catalogue does not know them
            spark.sql(f"DROP TABLE {table}")
    with pytest.raises(ValueError, match="13 words"):
        FingerprintIndex(spark, 10, "sessions", str(tmp_path))
    last = FingerprintIndex(spark, name="sessions", folder=str(tmp_path))
    assert [level for level, _ in last.runs] == [1, 0]
    last.drop()
    assert not FingerprintIndex(spark, name="sessions", folder=str(tmp_path)).runs
    everything.unpersist()


def test_quality(spark, docs, nothing):
    from pathrank.llm.quality import fit, score

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    data = []
    for i in range(700):
        good = i % 3 > 0
        data.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(rng.randint(20, 80))), int(good)))
    table = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = fit(table, table.select("doc_id", "quality").where("doc_id < 500"))
    found = by_id(score(table, model))
    right = [(found[i].score >= 0.7) == bool(y) for i, _, y in data if i >= 500]
    assert sum(right) / len(right) > 0.97
    scores = by_id(score(docs, model))
    assert all(0 <= r.score <= 1 for r in scores.values()) and len(scores) == docs.count()
    assert score(nothing, model).count() == 0
    assert fit(table, table.select("doc_id", F.lit(1).alias("quality"))).share == 1.0
    assert fit(nothing, table.select("doc_id", "quality")).share == 1.0


def test_word_vectors(spark, rows, nothing):
    from pathrank.llm.common import SPACES, Words
    from pathrank.llm.quality import CONTEXT, PLACES, context_vectors, fixed_vectors, tokens, vocabulary

    texts = [t for _, t in rows if t and t.split()] + ["twice one", "twice two", None, "", "  "]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    held = [set((t or "").encode().split()) for t in texts]
    count = {w: sum(w in h for h in held) for w in set().union(*held)}
    words = sorted(count)
    hashes = dict(zip(words, Words([b" ".join(words)], SPACES).hashes[0].tolist(), strict=True))
    known = vocabulary(table)
    assert set(known.tolist()) == {hashes[w] for w in words if count[w] > 1} and (np.diff(known.astype(object)) > 0).all()
    best = sorted((w for w in words if count[w] > 1), key=lambda w: (-count[w], np.uint64(hashes[w]).view(np.int64)))
    assert set(vocabulary(table, 3).tolist()) == {hashes[w] for w in best[:3]}
    fixed = fixed_vectors(len(known))
    want = np.zeros((PLACES + len(known), fixed.shape[1]))
    for t in texts:
        own = tokens(Words([(t or "").encode()], SPACES), known)
        for i in range(len(own)):
            for j in range(max(0, i - CONTEXT), min(len(own), i + CONTEXT + 1)):
                if j != i:
                    want[own[i, 0]] += fixed[own[j, 0]] + fixed[own[j, 1]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(context_vectors(table, known), want, atol=1e-5)
    assert len(vocabulary(nothing)) == 0 and not context_vectors(nothing, known).any()


def test_packing(spark, docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pathrank.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = [" lead", "trail ", "two  spaces", "a\n\n b", "<|endoftext|>", "don't  's", " x 　 y", "\n"]
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    found = pack_documents(docs.select("doc_id", "text").unionByName(more), path, with_ids=True).toPandas()
    for i, t in [*rows, *((10_000 + k, t) for k, t in enumerate(odd))]:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = found[found.doc_id == i].sort_values("piece")
        data = b"".join(own.ids)
        assert np.frombuffer(data, "<u4").tolist() == want
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
        assert all(n == 1024 for n in own.length[1:]) and own.piece.tolist() == list(range(len(own)))
        assert [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
    for _, s in found.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist() and s.length.sum() <= 1024
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 1024 + 1
    assert pack_documents(nothing, path).count() == 0


def test_packing_splits_at_added_tokens(spark, sf_dir, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from pathrank.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # in its default setting
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "two  <|endoftext|>  spaces ", "<|endoftext|><|endoftext|> lead", "a <|endoftext| > b", "plain words only", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    for found in (queries.op10_best_fit_packing(spark, sf_dir), corpus_pipeline.pack_sequences(spark, docs, sf_dir)):
        assert {r.doc_id: r.ids_crc32 for r in found.collect()} == want


def test_open_bins_are_bounded():
    from pathrank.llm.packing import OpenBins

    rng, bins, filled = random.Random(8), OpenBins(100, 4), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        held = dict(bins.by_space)
        spaces = sorted(f for f, b in held.items() if b)
        here, offset = bins.put(n)
        fitting = [f for f in spaces if f >= n]
        assert offset == (100 - fitting[0] if fitting else 0)
        filled[here] = filled.get(here, 0) + n
        assert filled[here] <= 100 and sum(map(len, bins.by_space.values())) == bins.open <= 4
