"""Main text of web pages, with boilerplate found by suffix arrays over the pages of a host.

A page is read into blocks (paragraphs, headings, list items, table rows ...), each with what the markup says of it:
inside an ``article`` or ``main``, inside furniture (``nav``, ``footer``, ``aside``, forms, comments, adverts ...), or
neither. The words of all visible blocks, those of the article and those around it, are the page's two token streams.

The streams of a host are concatenated and sorted as suffixes; neighbours in that order that agree in their first
``WIDTH`` words are one repeat, and a repeat on enough distinct pages covers its words, in articles too. A block whose
words are mostly covered is boilerplate. A check by markup follows: of a page with an article, its blocks that repeats
cut are restored (copies of articles repeat as boilerplate does) and what repeats left around it is taken out; of other
pages, furniture and menus are. If nothing would be left, the page is a copy of others, and markup alone judges it.

Suffixes are sorted by their first ``WIDTH`` words (prefix doubling), which is all that a repeat needs. An array holds
``ARRAY_WORDS`` words at most; a host of more words has several arrays, and a hot host is dealt over several tasks. The
texts move once, compressed, to the task of their arrays. The distinct pages of a hot host's repeats are then added up
over its parts, so that the outcome does not depend on how a host is dealt: first by as many bits of the repeats'
digests as tell most of them apart, then, for those that might be on enough pages, by the whole digests. Pages without an
article that have equal streams count as one page, and so do equal rows: one part counts them, others may hold copies.

Defined results: null and empty html has no text; the text of an empty block is left out; pages without a host have
nothing to be compared with; repeated rows and rows without an id are pages each (equal pages count once among the
distinct pages); unclosed and stray tags are closed as browsers do; an empty table gives no rows; further columns are
ignored by ``extract``.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pathrank.llm.common import SPACES, Words, chunks, rolling, sliced

#: Successive words of a repeat, and distinct pages of a host that have it.
WIDTH, LEAST_PAGES = 5, 3
#: So many list items in a row that are nothing but links are a menu.
LEAST_MENU = 3
#: Words of one suffix array.
ARRAY_WORDS = 1 << 20
#: A host with more html than both this and a 2,000th of all is dealt over several tasks; a page counts so many bytes more.
PART_BYTES, PARTS, ROW_BYTES = 4 << 20, 2000, 100
#: Html read at a time, and text compressed at a time.
PAGE_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: Repeats of a hot host are first told apart by so many bits more than its bytes of html have.
SPARE_BITS = 1
#: Small bundles of text take a tenth less at this level than at the first, large ones a fifth.
_ZSTD = pa.Codec("zstd", compression_level=5)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HARD = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "datalist", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_BLOCKS = _HARD - {"button", "select", "datalist"} | _HEADINGS | {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
#: Opening one of the latter closes an open one of the former, up to the named borders.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Words of class and id: of comments and notices, which no article inside lifts, and of other furniture.
_NEVER = {"comment", "comments", "disqus", "respond", "replies", "cookie", "cookies", "consent", "gdpr", "related", "recommended", "recommendations"}
_FURNITURE = {"nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "header", "footer", "masthead", "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "widget", "toolbar", "pagination", "pager", "skip"}

_PLAIN, _ARTICLE, _SOFT, _NONE = 0, 1, 2, 3  # what an element makes of the text inside


class _Reader:
    """Reads a page tag by tag into blocks: (what the markup says, text, whether all of it is links in a list)."""

    def __init__(self) -> None:
        self.out: list[tuple[int, str, bool]] = []
        self.stack: list[tuple[str, int, int, bool]] = []  # name, kind inside, kind of the block around, whether it is a header
        self.open: Counter[str] = Counter()
        self.kind = self.block = _PLAIN
        self.parts: list[str] = []
        self.linked = self.loose = False

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                self.out.append((self.block, text, self.linked and not self.loose and self.open["li"] > 0))
            self.parts = []
        self.linked = self.loose = False

    def add(self, piece: str) -> None:
        if piece and self.kind == self.block:  # else it is in a hidden or excluded element inside a line
            self.parts.append(piece)
            if not piece.isspace():
                self.linked, self.loose = self.linked or self.open["a"] > 0, self.loose or not self.open["a"]

    def leave(self, names: set[str], borders: set[str] = frozenset()) -> None:
        """Closes the innermost open element of these names, and all inside it, unless a border comes first."""
        if not any(self.open[n] for n in names):
            return
        depth = len(self.stack) - 1
        while self.stack[depth][0] not in names:
            if self.stack[depth][0] in borders:
                return
            depth -= 1
        if any(x[0] in _BLOCKS for x in self.stack[depth:]):
            self.flush()
        self.open.subtract(x[0] for x in self.stack[depth:])
        del self.stack[depth:]
        self.kind, self.block = self.stack[-1][1:3] if self.stack else (_PLAIN, _PLAIN)

    def enter(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            self.leave({"p"})
            self.flush()
        if name in _CLOSES:
            self.leave(*_CLOSES[name])
        if name in ("br", "td", "th"):
            self.parts.append(" ")
        if name in _VOID:
            return
        inner, header = self.inside(name, attributes)
        self.kind, self.block = inner, inner if name in _BLOCKS else self.block
        self.stack.append((name, inner, self.block, header))
        self.open[name] += 1

    def inside(self, name: str, attributes: str) -> tuple[int, bool]:
        """What an element makes of its text, and whether it is a header in an article, which headings outlive."""
        outer = self.kind
        if name in _HEADINGS and self.stack and self.stack[-1][3]:
            return _ARTICLE, False
        if outer == _NONE or name in _HARD:
            return _NONE, False
        own = {a.lower(): entities.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        role, words = own.get("role", "").lower(), set(_WORD.findall(f"{own.get('class', '')} {own.get('id', '')}".lower()))
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        if hidden or role in _ROLES or words & _NEVER:
            return _NONE, False
        if name in ("article", "main") or role in ("article", "main"):
            return _ARTICLE, False
        if name == "header" or words & _FURNITURE and name not in ("html", "body") and name not in _HEADINGS:
            return (_NONE, name == "header" or "header" in words) if outer == _ARTICLE else (_SOFT, False)
        return outer, False


def blocks(html: str) -> list[tuple[int, str, bool]]:
    """(what the markup says, text, whether all of it is links in a list) of each block of a page, in order."""
    reader, at = _Reader(), 0
    while found := _TAG.search(html, at):
        reader.add(html[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if found[1]:
            reader.leave({name})
        elif name in _RAW:
            end = None if found[3].endswith("/") else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else at if found[3].endswith("/") else len(html)
        elif name:
            reader.enter(name, found[3])
    reader.add(_CUT_TAG.sub("", html[at:]))
    reader.flush()
    return reader.out


class Page:
    """A page's article, or its blocks; and the blocks inside and outside the article, with the places of the blocks among the latter."""

    def __init__(self, html: str | None) -> None:
        found = blocks(html or "")
        self.article = article = [text for kind, text, _ in found if kind == _ARTICLE]
        self.text = "\n\n".join(article) if article else None
        self.outside = [(kind, text) for kind, text, _ in found if kind != _ARTICLE]
        self.blocks, self.places = [], []  # of a page without an article
        if not article:
            for menu, run in groupby(enumerate(found), lambda x: x[1][2]):
                run = list(run)
                if not menu or len(run) < LEAST_MENU:
                    self.blocks += [text for _, (kind, text, _) in run if kind == _PLAIN]
                    self.places += [k for k, (kind, _, _) in run if kind == _PLAIN]

    def key(self, host: str, page_id: object) -> bytes:
        """Pages of a host of one key count as one: those without an article whose streams are equal, or equal rows."""
        own = b"" if self.text is None else repr(page_id).encode()
        parts = host.encode(), own, " ".join(self.article).encode(), " ".join(t for _, t in self.outside).encode()
        return hashlib.blake2b(b"".join(b"%d " % len(x) + x for x in parts), digest_size=16).digest()


def _host(pages: DataFrame) -> Column:
    """The host of the url, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _released(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the bytes of their differences, all lowest bytes first, compressed."""
    gaps = np.diff(ascending, prepend=np.uint64(0))
    return _pressed(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(_released(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.uint64).ravel(), dtype=np.uint64)


def bundles(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(host, part, parts, bits, bundle): the pages read into blocks and dealt by host, in compressed bundles; ``parts`` is 1 unless the host is hot."""
    sizes = pages.groupBy(_host(pages).alias("host")).agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + ROW_BYTES).alias("size"))
    least = max(part_bytes, (sizes.agg(F.sum("size")).first()[0] or 0) // PARTS)
    hot = sizes.where(F.col("size") > least).select("host", F.ceil(F.col("size") / least).cast("int").alias("parts"), F.ceil(F.log2("size") + SPARE_BITS).cast("int").alias("bits"))
    # fewer than PARTS hosts have more than a share of 1 / PARTS, so they can be broadcast
    rows = pages.select("page_id", "url", _host(pages).alias("host"), "html").join(F.broadcast(hot), "host", "left").select("page_id", "url", "host", "html", "parts", "bits")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        copies: Counter[tuple[str, bytes]] = Counter()
        size = 0

        def bundled() -> Iterator[pa.RecordBatch]:
            for (host, part, parts, bits), own in held.items():
                yield pa.RecordBatch.from_pylist([{"host": host, "part": part, "parts": parts, "bits": bits, "bundle": _pressed(pickle.dumps(own))}], dealt)

        for batch in sliced(batches, PAGE_BYTES, "html"):
            for page_id, url, host, html, parts, bits in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html", "parts", "bits")), strict=True):
                page = Page(html)
                key, parts = page.key(host, page_id), parts or 1
                outside = [text for _, text in page.outside]
                copy = copies[host, key] % parts  # the part of copy 0 counts the page; further copies of a bundle are dealt over the others
                copies[host, key] += 1
                part = (int.from_bytes(key[:8], "little") + copy) % parts
                held.setdefault((host, part, parts, bits or 0), []).append((page_id, url, key, copy == 0, page.article, outside, page.places))
                size += sum(map(len, page.article)) + sum(map(len, outside)) + ROW_BYTES
            if size >= BUNDLE_BYTES:
                yield from bundled()
                held, copies, size = {}, Counter(), 0
        yield from bundled()

    dealt = pa.schema([("host", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("bits", pa.int32()), ("bundle", pa.binary())])
    return rows.mapInArrow(read, "host string, part int, parts int, bits int, bundle binary").repartition("host", "part")


class Part:
    """The pages of a part of a host, and the words of their streams: each distinct page's article, and what is around it.

    ``counted`` tells which distinct pages this part counts."""

    def __init__(self, bundled: pa.Table, width: int) -> None:
        self.host, self.part, self.parts, self.bits = (bundled.column(c)[0].as_py() for c in ("host", "part", "parts", "bits"))
        self.pages = [page for b in bundled.column("bundle").to_pylist() for page in pickle.loads(_released(b))]
        self.width = width
        first: dict[bytes, int] = {}
        self.of = [first.setdefault(page[2], len(first)) for page in self.pages]
        self.counted = np.zeros(len(first), bool)
        streams: list[bytes] = [b""] * (2 * len(first))
        for k, (_, _, _, counted, article, outside, _) in zip(self.of, self.pages, strict=True):
            self.counted[k] |= counted
            streams[2 * k], streams[2 * k + 1] = " ".join(article).encode(), " ".join(outside).encode()
        words = [Words([x for x, in some], SPACES) for some in chunks(((x,) for x in streams), PAGE_BYTES)]
        counts = np.concatenate([w.counts for w in words])
        self.tokens, self.stream, self.first = np.concatenate([w.hashes[0] for w in words]), np.repeat(np.arange(len(counts)), counts), np.r_[0, np.cumsum(counts)]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the stretches of ``width`` words of one stream, and the stretches' digests."""
        n = max(0, len(self.tokens) - self.width + 1)
        whole = np.flatnonzero(self.stream[:n] == self.stream[self.width - 1 :][:n])
        return whole, rolling(self.tokens, self.width)[whole]

    def repeats(self, array_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The digests of all stretches, ascending, and on how many of the pages that the part counts they are, by suffix arrays."""
        found, ends, low = [], self.first[2::2], 0
        while low < len(ends):  # pages are not cut
            at = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, at + array_words, side="right")))
            found.append(_array_repeats(self.tokens[at : int(ends[high - 1])], self.stream[at : int(ends[high - 1])], self.counted, self.width))
            low = high
        return _added([d for d, _ in found], [n for _, n in found])


def _added(digests: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests, ascending, and the sums of their pages."""
    distinct, place = np.unique(np.concatenate([np.empty(0, np.uint64), *digests]), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate([np.empty(0), *pages]), len(distinct)).astype(np.int64)


def _suffix_classes(tokens: np.ndarray, width: int) -> np.ndarray:
    """The rank of each suffix by its first ``width`` words: the shorter ranks of two overlapping halves, doubled."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        pair = rank[: max(0, len(rank) - step)] * (int(rank.max()) + 1 if len(rank) else 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _array_repeats(tokens: np.ndarray, stream: np.ndarray, counted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest, distinct pages that are counted) of each stretch of ``width`` words of one array; a page has two streams."""
    rank = _suffix_classes(tokens, width)
    whole = np.flatnonzero(stream[: len(rank)] == stream[width - 1 :][: len(rank)])  # suffixes that have so many words of their stream
    order = whole[np.argsort(rank[whole], kind="stable")]  # the suffix array
    if not len(order):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    new = np.r_[True, np.diff(rank[order]) != 0]
    bounds = np.flatnonzero(new)
    page = stream[order] >> 1
    pages = np.add.reduceat(((new | np.r_[True, np.diff(page) != 0]) & counted[page]).astype(np.int64), bounds)
    return rolling(tokens, width)[order[bounds]], pages


_SUMS = pa.schema([("host", pa.string()), ("bucket", pa.int64()), ("part", pa.int32()), ("shift", pa.int32()), ("digests", pa.binary()), ("pages", pa.binary())])
_FOUND = pa.schema([("host", pa.string()), ("part", pa.int32()), ("digests", pa.binary())])


def _sums(part: Part, digests: np.ndarray, pages: np.ndarray, bits: int) -> pa.Table:
    """The pages of ascending digests of ``bits`` bits, by as many ranges of digests as the host has parts, or up to twice."""
    shift = np.uint64(bits - min(bits, (part.parts - 1).bit_length()))
    buckets, at = np.unique(digests >> shift, return_index=True)
    rows = []
    for bucket, own, n in zip(buckets.tolist(), np.split(digests, at)[1:], np.split(pages.astype(np.uint32), at)[1:], strict=True):
        rows.append({"host": part.host, "bucket": bucket, "part": part.part, "shift": int(shift), "digests": _packed(own - (np.uint64(bucket) << shift)), "pages": _pressed(n.tobytes())})
    return pa.Table.from_pylist(rows, _SUMS)


def often(sums: DataFrame, least_pages: int) -> DataFrame:
    """(host, part, digests): which digests of a part are on enough pages of the host."""

    def add(rows: pa.Table) -> pa.Table:
        base = np.uint64(rows.column("bucket")[0].as_py()) << np.uint64(rows.column("shift")[0].as_py())
        digests = [_unpacked(d) for d in rows.column("digests").to_pylist()]
        pages = [np.frombuffer(_released(n), np.uint32) for n in rows.column("pages").to_pylist()]
        distinct, n = _added(digests, pages)
        distinct = distinct[n >= least_pages]
        found = [_packed(d[np.isin(d, distinct, assume_unique=True)] + base) for d in digests]
        return pa.Table.from_arrays([rows.column("host").combine_chunks(), rows.column("part").combine_chunks(), pa.array(found, pa.binary())], schema=_FOUND)

    return sums.groupBy("host", "bucket").applyInArrow(add, "host string, part int, digests binary")


def _all(found: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(_unpacked(d) for d in found.column("digests").to_pylist())])


def repeated(dealt: DataFrame, width: int = WIDTH, least_pages: int = LEAST_PAGES, array_words: int = ARRAY_WORDS) -> DataFrame:
    """(host, part, digests): for each part of the hot hosts, the digests of its stretches on enough pages of the host."""
    kinds = "host string, bucket long, part int, shift int, digests binary, pages binary"

    def first(bundled: pa.Table) -> pa.Table:
        if not bundled.column("host")[0].as_py() or bundled.column("parts")[0].as_py() == 1:
            return _SUMS.empty_table()
        part = Part(bundled, width)
        digests, pages = part.repeats(array_words)
        short = digests >> np.uint64(64 - part.bits)  # stays ascending
        return _sums(part, *_added([short], [pages]), part.bits)

    def second(bundled: pa.Table, maybe: pa.Table) -> pa.Table:
        if not maybe.num_rows or not bundled.num_rows:
            return _SUMS.empty_table()
        part = Part(bundled, width)
        whole, digests = part.digests()
        own = np.isin(digests >> np.uint64(64 - part.bits), _all(maybe))
        order = np.lexsort((part.stream[whole[own]] >> 1, digests[own]))
        digests, page = digests[own][order], part.stream[whole[own]][order] >> 1
        fresh = np.r_[True, (np.diff(digests) != 0) | (np.diff(page) != 0)][: len(digests)]
        return _sums(part, *_added([digests], [fresh & part.counted[page]]), 64)

    sums = dealt.groupBy("host", "part").applyInArrow(first, kinds)
    sums = dealt.groupBy("host", "part").cogroup(often(sums, least_pages).groupBy("host", "part")).applyInArrow(second, kinds)
    return often(sums, least_pages)


def _mostly(covered: np.ndarray, blocks: list[str]) -> list[bool]:
    """Which blocks have most of their words covered; a block's words are parted by single spaces."""
    sizes = np.array([b.count(" ") + 1 for b in blocks], np.int64)
    sums, ends = np.r_[0, np.cumsum(covered)], np.cumsum(sizes)
    return (2 * (sums[ends] - sums[ends - sizes]) > sizes).tolist()


def judged(pages: DataFrame, width: int = WIDTH, least_pages: int = LEAST_PAGES, array_words: int = ARRAY_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of ``extract``; the article's words, ``n_article``, and those covered by repeats; all blocks of the page, those that
    repeats cut, and of these and the others what the check by markup ``n_restored`` and ``n_removed``."""
    known = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}"
    dealt = bundles(pages, part_bytes)

    def judge(bundled: pa.Table, found: pa.Table) -> pa.Table:
        part = Part(bundled, width)
        whole, digests = part.digests()
        if not part.host:
            repeats = np.empty(0, np.uint64)
        elif part.parts > 1:
            repeats = _all(found)
        else:
            distinct, n = part.repeats(array_words)
            repeats = distinct[n >= least_pages]
        starts = whole[np.isin(digests, repeats)]
        edges = np.bincount(starts, minlength=len(part.tokens) + 1) - np.bincount(starts + width, minlength=len(part.tokens) + 1)
        covered = np.cumsum(edges)[: len(part.tokens)] > 0
        rows = []
        for k, (page_id, url, _, _, article, outside, places) in zip(part.of, part.pages, strict=True):
            inside, around = (covered[part.first[j] : part.first[j + 1]] for j in (2 * k, 2 * k + 1))
            cut, cut_around = _mostly(inside, article), _mostly(around, outside)
            left = [j for j, c in enumerate(cut_around) if not c]
            if article:  # the check by markup: all of the article, nothing around it
                text, restored, removed = article, sum(cut), len(left)
            else:
                text, restored = [outside[j] for j in places if not cut_around[j]], 0
                text, removed = text or [outside[j] for j in places], len(left) - len(text)
            rows.append((page_id, url, "\n\n".join(text), len(around), int(around.sum()), len(inside), int(inside.sum()), len(article) + len(outside), sum(cut) + sum(cut_around), restored, removed))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    counts = ("n_outside", "n_repeated", "n_article", "n_article_repeated", "n_blocks", "n_cut", "n_restored", "n_removed")
    kinds = pa.schema([*to_arrow_schema(pages.select("page_id", "url").schema), ("text", pa.string()), *((c, pa.int64()) for c in counts)])
    met = dealt.groupBy("host", "part").cogroup(repeated(dealt, width, least_pages, array_words).groupBy("host", "part"))
    done = met.applyInArrow(judge, f"{known}, text string, {', '.join(f'{c} long' for c in counts)}")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *counts)


def extract(pages: DataFrame, width: int = WIDTH, least_pages: int = LEAST_PAGES, array_words: int = ARRAY_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, and of the words outside the article ``n_outside`` and those covered by repeats, ``n_repeated``."""
    return judged(pages, width, least_pages, array_words, part_bytes).select("page_id", "url", "text", "n_chars", "n_outside", "n_repeated")
