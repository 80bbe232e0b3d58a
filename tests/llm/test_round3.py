"""Filter audit, main text and divergence of sources against plain versions on small tables with odd rows."""

import html
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import odd_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [*odd_texts(), "AAA bbb #", "É€漢 ABC", "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000, "a\x00b a\x00b", *[" ".join(rng.choice("abcdefgh") for _ in range(250)) for _ in range(4)]]
    found = [(k, t, rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None])) for k, t in enumerate(texts)]
    found += [found[3], (None, texts[0], "en", "s0"), (None, "no id", None, None), (5000, None, "xx", "alone")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for c in ("n", "key", "mask", "part", "term", "cells", "value", "first"):
        df = df.withColumn(c, F.lit("?"))
    return df


def test_transducer_counts_what_patterns_find(rows):
    from pathrank.llm.filter_audit import transduce

    texts = [t or "" for _, t, _, _ in rows]
    found = transduce([t.encode() for t in texts])
    for k, t in enumerate(texts):
        words = WORDS.findall(t)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t)))
        assert tuple(int(found[c][k]) for c in ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")) == want
    assert [len(v) for v in transduce([b""]).values()] == [1] * 5


def test_spans_of_one_hash_are_told_apart():
    from pathrank.llm.filter_audit import Spans, distinct

    words = [b"one", b"two", b"one", b"a long word that differs at its end 1", b"a long word that differs at its end 2", b"two"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = ends - [len(w) for w in words]
    same = np.zeros(len(words), np.uint64)
    assert distinct(Spans(data, begin, ends), np.array([0, 0, 0, 0, 0, 1]), same, 2).tolist() == [4, 1]


def brute_audit(rows, labels):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least.get(t, i) < i}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in bad))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = members
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                redundant = sum(f in m[0] and bool(m[0] & set(order[:k])) for m in members)
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, docs, rows):
    from pathrank.llm.filter_audit import audit

    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 90, 3)] + [(3, None, 1), (None, 1, 1), (6, 0, 0)]
    found = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in found.collect()} == brute_audit(rows, labels)
    assert audit(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def brute_divergence(rows, least, top):
    langs = defaultdict(lambda: defaultdict(Counter))
    spread = defaultdict(Counter)
    for _, t, lang, source in rows:
        terms = TERMS.findall(lowered(t))
        langs[lang or ""][source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    out = set()
    for lang, groups in langs.items():
        kept = [t for t, n in spread[lang].items() if n >= least]
        p = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole, own = p(sum(groups.values(), Counter())), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, own[s][t] - whole[t]) for t in kept if groups[s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize(("least", "block", "chunk"), [(3, 4096, 32), (2, 7, 2), (10_000, 4096, 32)])
def test_divergence(spark, docs, rows, monkeypatch, least, block, chunk):
    from pathrank.llm import divergence as d

    monkeypatch.setattr(d, "BLOCK_TERMS", block)
    monkeypatch.setattr(d, "CHUNK_SOURCES", chunk)
    monkeypatch.setattr(d, "COUNT_BYTES", 2000)
    found = d.divergence(docs, least, 5)
    assert {tuple(r) for r in found.collect()} == brute_divergence(rows, least, 5)
    assert d.divergence(docs.where("false"), least).count() == 0


def test_smoothing_is_exact_beyond_64_bits(spark):
    from pathrank.llm.divergence import _smoothed

    n, below = 9_000_000_000_000_000_000, 9_100_000_000_000_000_001
    got = spark.createDataFrame([(n, below)], "n long, below long").select(_smoothed(F.col("n"), F.col("below"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // below


ARTICLE = "<article><h1>A title &amp; more</h1><p>One <b>bold</b><br>word<p>Second&nbsp;one &lt;3</p></article>"


def test_blocks_follow_the_markup():
    from pathrank.llm.main_text import Page, blocks

    assert Page(f"<nav>Menu</nav>{ARTICLE}<footer>End</footer>").text == "A title & more\n\nOne bold word\n\nSecond one <3"
    soft = "<div class='layout with-sidebar ad'><main><p>Text</p></main></div>"
    assert Page(soft).text == "Text"
    inner = "<article><header class='post-header'><h1>T</h1><p>by us</p></header><p>Body</p><div class=share>Share</div><aside>x</aside><form><p>mail</p></form><footer>f</footer><section id=comments><article><p>nice</p></article></section><p hidden>h</p><p>In <span style='display: none'>not</span>line <button>press</button>here</article>"
    assert Page(inner).text == "T\n\nBody\n\nIn line here"
    assert Page("<p>a<!-- <p>b --> c<script>if (a < b) '</p>'</script> d<style>p{}</style>").blocks == ["a c d"]
    assert Page("<ul><li><a>Home</a><li><a>News</a><li><a>About</a></ul><ul><li>A real <a>item</a></ul><table><tr><td>1<td>2<tr><th>3</table>").blocks == ["A real item", "1 2", "3"]
    assert Page("<div>x</span></b></div><p>cut <a href='").blocks == ["x", "cut"]
    assert Page(None).blocks == Page("").blocks == Page("<title>only").blocks == []
    assert blocks("<b>" * 3000 + "deep" + "</i>" * 3000)[0][1] == "deep"


def test_suffix_classes_are_those_of_stretches():
    from pathrank.llm.main_text import _suffix_classes

    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 300)
    for width in (1, 2, 3, 5, 8, 400):
        classes = _suffix_classes(tokens, width)
        stretches = [tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)]
        assert len(classes) == max(0, len(stretches))
        order = {s: k for k, s in enumerate(sorted(set(stretches)))}
        assert classes.tolist() == [order[s] for s in stretches]


def site(rng, hosts=3, pages=14):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = []
    for h in range(hosts):
        notice, terms, rare = prose(9), prose(12), prose(8)
        for k in range(pages):
            own = [f"<p>{prose(rng.randint(6, 30))}</p>" for _ in range(3)]
            body = f"<div>{notice}</div>{own[0]}<p>{terms if k % 2 else rare if k < 4 else prose(7)}</p>{own[1]}{own[2]}<div><b>{prose(2)}</b> {notice}</div>"
            url = f"https://Host{h}.example/{k}"
            out.append((100 * h + k, url, body if k % 3 else f"<header>{notice}</header>{ARTICLE}<footer>{terms}</footer>"))
        out += [(100 * h + 50 + k, f"http://host{h}.example:80/copy{k}", out[-1][2]) for k in range(4)]
    return [*out, (900, None, out[1][2]), (901, "no url", out[1][2]), (902, "https://host0.example/null", None), (903, "https://host0.example/empty", ""), out[1], out[3], (None, "https://host0.example/x", ARTICLE), (None, "https://host0.example/x", ARTICLE)]


def brute_pages(rows, width, least):
    from pathrank.llm.main_text import Page

    read = [(i, u, Page(h)) for i, u, h in rows]
    outside = [[WORDS.findall(t) for _, t in p.outside] for _, _, p in read]
    seen = defaultdict(lambda: defaultdict(set))
    hosts = [(re.match(r"[a-z]+://([^/:]*)", (u or "").lower()) or [None, ""])[1] for _, u, _ in read]
    flat = [[w for b in page for w in b] for page in outside]
    voter = [(tuple(words), None if p.text is None else repr(i)) for words, (i, _, p) in zip(flat, read, strict=True)]
    for words, host, v in zip(flat, hosts, voter, strict=True):
        for k in range(len(words) - width + 1):
            if host:
                seen[host][tuple(words[k : k + width])].add(v)
    out = Counter()
    for (i, u, p), page, words, host in zip(read, outside, flat, hosts, strict=True):
        covered = [False] * len(words)
        for k in range(len(words) - width + 1):
            if len(seen[host][tuple(words[k : k + width])]) >= least:
                covered[k : k + width] = [True] * width
        text = p.text
        if text is None:
            ends = np.cumsum([len(b) for b in page]).tolist()
            kept = [b for b, k in zip(p.blocks, p.places, strict=True) if 2 * sum(covered[ends[k] - len(page[k]) : ends[k]]) <= len(page[k])]
            text = "\n\n".join(kept or p.blocks)
        out[i, u, text, len(text), len(words), sum(covered)] += 1
    return out


@pytest.mark.parametrize(("array_words", "part_bytes"), [(1 << 20, 4 << 20), (150, 4 << 20), (1 << 20, 1500), (60, 700)])
def test_main_text(spark, array_words, part_bytes):
    from pathrank.llm.main_text import LEAST_PAGES, WIDTH, extract

    rows = site(random.Random(8))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("key", F.lit(1)).withColumn("host", F.lit("?"))
    want = brute_pages(rows, WIDTH, LEAST_PAGES)
    found = extract(pages, array_words=array_words, part_bytes=part_bytes)
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_outside", "n_repeated"]
    assert Counter(map(tuple, found.collect())) == want
    dropped = sum(n for key, n in want.items() if key[5])
    assert dropped > 20 and extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(("array_words", "part_bytes"), [(1 << 20, 4 << 20), (150, 4 << 20), (1 << 20, 3000), (60, 1200)])
def test_repeats_of_articles_are_found_and_restored(spark, array_words, part_bytes):
    """All words of a page are in the arrays: a passage of three articles, or of two and a footer, is a repeat; the check keeps it."""
    from pathrank.llm.main_text import LEAST_PAGES, WIDTH, Page, extract, judged

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    lead, note, twice, plain = prose(9), prose(8), prose(9), f"<p>{prose(20)}</p>"
    rows = []
    for k in range(40):
        inside = [prose(15), lead if k % 4 == 0 else prose(6), note if k in (1, 2) else twice if k in (5, 6) else prose(7)]
        rows.append((k, f"https://a.example/{k}", f"<nav>{prose(3)}</nav><article><h1>{inside[0]}</h1><p>{inside[1]}</p><p>{inside[2]}</p></article><footer>{note if k == 3 else prose(6)}</footer>"))
    rows += [(100, "https://b.example/", rows[0][2]), (101, None, rows[0][2]), *[rows[5]] * 4]
    rows += [(200 + k, f"https://a.example/copy{k}", f"{plain}<p>{twice if k else prose(3)}</p>") for k in range(40)]  # copies count once: with two articles, three pages
    seen, streams = defaultdict(set), []
    for i, u, h in rows:
        page, host = Page(h), (u or "").split("/")[2:3]
        streams.append([WORDS.findall(" ".join(x)) for x in (page.article, [t for _, t in page.outside])])
        for words in streams[-1] if host else ():
            for k in range(len(words) - WIDTH + 1):
                seen[host[0], *words[k : k + WIDTH]].add((i if page.article else None, str(streams[-1])))
    want = Counter()
    for (i, u, h), (inside, around) in zip(rows, streams, strict=True):
        n, page, host = [], Page(h), (u or "").split("/")[2:3]
        covers = []
        for words in (inside, around):
            covered = [False] * len(words)
            for k in range(len(words) - WIDTH + 1):
                if host and len(seen[host[0], *words[k : k + WIDTH]]) >= LEAST_PAGES:
                    covered[k : k + WIDTH] = [True] * WIDTH
            covers.append(covered)
            n += [len(words), sum(covered)]
        cut, at = 0, 0
        for block in page.article:
            size = len(WORDS.findall(block))
            cut += 2 * sum(covers[0][at : at + size]) > size
            at += size
        want[i, *n, cut] += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = judged(pages, array_words=array_words, part_bytes=part_bytes).collect()
    assert Counter((r["page_id"], r["n_article"], r["n_article_repeated"], r["n_outside"], r["n_repeated"], r["n_restored"]) for r in found) == want
    restored = {r["page_id"] for r in found if r["n_restored"]}
    assert restored == {*range(0, 40, 4), 1, 2, 5, 6}
    assert all(r["text"] == Page(h).text for r in found for i, _, h in rows if r["page_id"] == i and i < 200)
    assert all(r["n_cut"] - r["n_restored"] + len(r["text"].split("\n\n")) + r["n_removed"] == r["n_blocks"] for r in found if r["page_id"] < 200)
    assert extract(pages, array_words=array_words, part_bytes=part_bytes).count() == len(rows)


def test_packed_digests():
    from pathrank.llm.main_text import _packed, _unpacked

    for values in ([], [0], [2**64 - 1], [0, 1, 2**40, 2**64 - 1]):
        assert _unpacked(_packed(np.array(values, np.uint64))).tolist() == values


def test_main_text_of_the_tables(spark, sf_dir):
    """All of each article, and nothing else, though hosts hold copies of articles; repeats are found around them."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # on fewer pages few hosts have three
    from pathrank.llm.queries import op12_host_suffix_array

    found = {r["page_id"]: r for r in op12_host_suffix_array(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        pieces = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inside)]
        assert found[r["page_id"]]["text"] == "\n\n".join(x for x in pieces if x)
    assert sum(r["n_repeated"] > 0 for r in found.values()) > len(found) / 10
    assert math.isclose(sum(r["n_chars"] for r in found.values()), sum(len(r["text"]) for r in found.values()))


def auc(scores, labels):
    """The chance that a row of label 1 scores above one of label 0, ties half."""
    order = np.argsort(scores, kind="stable")
    s = np.asarray(scores)[order]
    first, last = np.searchsorted(s, s, side="left"), np.searchsorted(s, s, side="right")
    ranks, y = (first + last + 1) / 2, np.asarray(labels)[order]
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("query", "label", "least"), [("op2_multiple_instance_toxicity", "toxic", 0.95), ("op9_random_indexing_quality", "quality", 0.98)])
def test_classifiers_rank_held_out_documents(spark, sf_dir, query, label, least):
    """On the tables, by rows that the query may not learn from."""
    from pathrank.llm.queries import QUERIES

    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", label)
    held = QUERIES[query](spark, sf_dir).where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 500 and auc(held["score"], held[label]) >= least


@pytest.mark.parametrize("name", ["op2", "op5", "op7", "op9", "op10"])
def test_repeated_rows_and_rows_without_an_id(spark, name):
    """A row for each row (op10: for each piece), equal rows alike, whatever the ids."""
    texts = ["some plain words of a text that goes on for a while", "", None, "mit license " * 5, "you stupid idiot. go away, idiot!"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (3, texts[3]), (None, texts[0]), (None, None), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("?")).withColumn("fp", F.lit(1))
    marks = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, y int")
    if name == "op2":
        from pathrank.llm.toxicity import fit, score

        found = score(docs, fit(docs, marks.withColumnRenamed("y", "toxic")))
    elif name == "op5":
        from pathrank.llm.licenses import scan

        found = scan(docs)
    elif name == "op7":
        from pathrank.llm.simhash import groups

        found = groups(docs)
    elif name == "op9":
        from pathrank.llm.quality import fit, score

        found = score(docs, fit(docs, marks.withColumnRenamed("y", "quality")))
    else:
        import public_tokenizers
        from pathrank.llm.packing import pack_documents

        found = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    got = Counter(r["doc_id"] for r in found.collect())
    assert got == Counter(i for i, _ in rows)
