r"""HTML extraction: page structure, and a suffix array over the pages of a host.

A page is cut into blocks of text at the tags that break lines; white space inside a
block becomes one space, character references are decoded. Scripts, styles, comments and
other raw parts are no text. Each block gets a place:

* aside: inside a menu, header, footer, sidebar, form, advert, notice or comment section, as
  its tag, role, class or id says, or hidden. Such blocks are no text;
* main: inside an article or main element;
* maybe: inside one, but in an element whose name only hints at an aside (a known word
  among unknown ones, as in `notice-period` or `related-work`);
* open: anything else in the body.

What structure leaves undecided, the host's pages decide together. The words of all their
blocks, with a mark behind each block, are concatenated to one stream of numbers, with a
separator of its own behind each page. Its suffix array is built by doubling, to the depth
of RUN words, with the common prefixes of neighbours; suffixes that share RUN words stand
together, and the distinct pages among them are counted (pages with the same blocks are
one). A run counts as boilerplate on `open_need` pages: half of the host's, two at least.

* On a page without a main part, words of the open blocks that boilerplate covers are removed
  and unique runs kept, even inside a block. (Runs that go on over a mark, as those of short
  lines, only remove blocks that they cover whole.) A page that is nothing else keeps its
  text: it is a copy of what stands on other pages, not a frame around something.
* A maybe block goes if boilerplate covers it whole, or half of its words inside.
* A block of the main part goes if it is covered whole by runs that `main_need` pages have
  (four fifths of ten or more: a notice that a site puts into its articles). If such blocks
  are more than MOST_OF_MAIN of the main part, the pages are copies of an article, and all stay.
* All other blocks of the main part are kept whole, so an article that some pages share
  remains an article. Open blocks of a page that has a main part are not its article.

A host may have any number of pages, and the rules are the same for all. Hosts of more than
GROUP pages are dealt into groups by the hash of the page; each group has a suffix array of
its own. A run that half of the host's pages have is on half of the pages of some group at
least, so the groups' frequent runs, by their 128-bit hashes, are all candidates there
are; these are then counted over the whole host, and pages are cleaned one by one. Names of
large hosts and their runs are broadcast only up to BROADCAST_ROWS of them, else joined.

Tokenising is linear in the page whatever is in it. Null or empty html gives an empty text;
pages without a host form a host of their own. Repeated rows have repeated results (they are
one distinct page); an empty table none. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import durable, rows_of, small_batches, written

#: Words of a repeated run, pages that one suffix array takes, rows that may be broadcast.
RUN, GROUP, BROADCAST_ROWS = 8, 256, 200_000
#: The share of a main part's words that may go as boilerplate.
MOST_OF_MAIN = 0.3

MAIN, OPEN, MAYBE = 0, 1, 2


def open_need(pages: int) -> int:
    """Distinct pages, of those of a host, that make a run boilerplate."""
    return max(2, (pages + 1) // 2)


def main_need(pages: int) -> int | None:
    """The same inside a main part; None: no run is."""
    return -(-pages * 4 // 5) if pages >= 10 else None


# ---- blocks ------------------------------------------------------------------------

_RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "select", "textarea", "title")
#: Raw elements that go on to the end of the page if nothing ends them.
_RAW_TO_END = frozenset(("script", "style", "textarea", "title"))
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAIL = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split()
)
#: Elements that never hold an article's text.
_ASIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class names and ids that mean an aside.
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pager pagination footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations "
    "widget widgets comment comments disqus respond reply replies feedback skip toc tags tagcloud copyright legal disclaimer".split()
)
#: The same outside a main part.
_HEADER_NAMES = frozenset("header head".split())
#: Words that stand beside these and change nothing.
_COMPANIONS = frozenset(
    "site page main primary secondary global top bottom left right center upper lower list item items box bar block section area container wrapper "
    "wrap inner outer panel group row column col link links button buttons btn icon icons text title heading label form field posts post article "
    "articles story stories entry entries reader readers user users us unit slot zone spot space small large mobile desktop sticky fixed inline "
    "image media email policy message info js load count meta tools plugin thread header body content web blog".split()
)
#: A start tag of the first kind ends open elements of the second.
_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_HOLDERS = frozenset("ul ol dl table menu".split())
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_HINTED, _ASIDE = 1, 2


def _named(value: str, in_main: bool) -> int:
    """What the words of a class or id say."""
    found = 0
    for name in value.split():
        parts = set(_PART.findall(_CAMEL.sub(" ", name).lower()))
        telling = parts & _ASIDE_NAMES or not in_main and parts & _HEADER_NAMES
        if telling:
            if parts <= _ASIDE_NAMES | _COMPANIONS | _HEADER_NAMES:
                return _ASIDE
            found = _HINTED
    return found


def _kind(tag: str, attributes: str, in_main: bool) -> int:
    """0, or whether an element's name hints at a menu, notice, advert or the like, or it is one."""
    if tag in _ASIDE_TAGS or tag == "header" and not in_main:
        return _ASIDE
    if tag in ("html", "body", "article", "main") and "hidden" not in attributes or not _TELLING.search(attributes):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                found = max(found, _named(value, in_main))
        elif name == "role" and value.lower() in _ASIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return _ASIDE
        elif name == "hidden" or name == "style" and _UNSEEN.search(value):
            return _ASIDE
        if found == _ASIDE:
            break
    return found


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Behind the `>` that ends a tag, -1 if none does; last: the last place of each quotation mark.

    A mark that nothing closes is an ordinary character.
    """
    m = _TAIL.match(page, at)
    if m:
        return m.end()
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return at
        if m.start() < last[m[0]]:
            at = page.index(m[0], at) + 1


class _Blocks:
    """The blocks of a page, as its tags come."""

    def __init__(self):
        self.found: list[tuple[int, str]] = []
        self.held: list[str] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, what it is, whether inside main
        self.times: dict[str, int] = {}
        self.kind, self.main = 0, False

    def end_block(self) -> None:
        if self.held:
            if self.kind != _ASIDE:
                text = " ".join("".join(self.held).split())
                if text:
                    self.found.append((OPEN if not self.main else MAYBE if self.kind else MAIN, text))
            self.held.clear()

    def add(self, tag: str, kind: int, main: bool) -> None:
        if self.open:
            above = self.open[-1][1]
            # a main part starts anew, if it is not in an aside
            kind = max(kind, above if above == _ASIDE or main == self.main else 0)
        self.open.append((tag, kind, main))
        self.times[tag] = self.times.get(tag, 0) + 1
        self.kind, self.main = kind, main

    def close(self, tag: str) -> None:
        if self.times.get(tag):
            self.end_block()
            while True:
                last = self.open.pop()[0]
                self.times[last] -= 1
                if last == tag:
                    break
            self.kind, self.main = self.open[-1][1:] if self.open else (0, False)

    def start(self, tag: str, attributes: str) -> None:
        """A start tag of an element that is neither raw nor void."""
        if tag in _INLINE:
            # only asides are kept track of, and elements of the same name in them
            kind = _kind(tag, attributes, self.main)
            if kind == _ASIDE or self.times.get(tag):
                if self.kind != _ASIDE:
                    self.end_block()
                self.add(tag, kind, self.main)
            return
        if tag in _P_ENDERS:
            self.close("p")
        for other in _CLOSES.get(tag, ()):
            if self.times.get(other):
                for t, _, _ in reversed(self.open):
                    if t in _HOLDERS:
                        break
                    if t == other:
                        self.close(other)
                        break
        self.end_block()
        if attributes.endswith("/") and tag not in _P_ENDERS:
            return
        self.add(tag, _kind(tag, attributes, self.main), self.main or tag in ("article", "main"))

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.times.get(tag):
            self.end_block()
        else:
            # formatting doesn't end a block; it is open only as an aside
            self.close(tag)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of the blocks that may be text, in page order; asides are left out."""
    page = page or ""
    made = _Blocks()
    last = {c: page.rfind(c) for c in "\"'"}
    endless: set[str] = set()
    seen = at = 0  # text from `seen` on is not taken yet

    def take(to: int) -> None:
        if to > seen:
            own = page[seen:to]
            made.held.append(_html.unescape(own) if "&" in own else own)

    while (at := page.find("<", at)) >= 0:
        behind = page[at + 1 : at + 2]
        if behind in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3 if page.find("-->", at + 4) >= 0 else len(page)
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at) + 3 if page.find("]]>", at) >= 0 else len(page)
            else:
                end = page.find(">", at) + 1
                if not end:
                    break
            take(at)
            seen = at = end
            continue
        m = _NAME.match(page, at + 1)
        if m is None:
            at += 1
            continue
        end = _tag_end(page, m.end(), last)
        if end < 0:
            break  # no tag ends any more: the rest is text
        take(at)
        seen = at = end
        tag, attributes = m[2].lower(), page[m.end() : end - 1].rstrip()
        if m[1]:
            made.end(tag)
        elif tag in _ENDS:
            if not attributes.endswith("/") and tag not in endless:
                closing = _ENDS[tag].search(page, at)
                if closing:
                    seen = at = closing.end()
                elif tag in _RAW_TO_END:
                    seen = at = len(page)
                else:
                    endless.add(tag)
            if tag not in ("svg", "math"):
                made.end_block()
        elif tag in _VOID:
            if tag not in _INLINE:
                made.end_block()
        else:
            made.start(tag, attributes)
    take(len(page))
    made.end_block()
    return made.found


# ---- the suffix array of a host ----------------------------------------------------

#: Stands behind each block in a page's stream of words.
MARK = "\n"


def stream(page: list[tuple[int, str]]) -> list[str]:
    """The words of a page's blocks, and a mark behind each block."""
    return [w for _, text in page for w in (*text.split(" "), MARK)]


def page_number(page: list[tuple[int, str]]) -> int:
    """A hash of a page's blocks: pages with the same blocks are one."""
    import xxhash

    return xxhash.xxh3_64_intdigest("\n".join(f"{p} {t}" for p, t in page).encode("utf-8", "surrogatepass")) - (1 << 63)


def suffix_array(numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first `depth` numbers, and the common prefix of each with the one before.

    By doubling. Prefixes are exact up to `depth`; depth is a power of two.
    """
    n = len(numbers)
    ranks = [np.unique(numbers, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < depth:
        after = np.full(n, -1, np.int64)
        after[: n - width] = ranks[-1][width:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    # the ranks of widths depth, depth / 2, .. 1 find each common prefix
    prefix = np.zeros(n, np.int64)
    outside = -1 - np.arange(2 * depth)  # behind the end, all differ
    for rank in reversed(ranks):
        padded = np.append(rank, outside)
        same = np.zeros(n, bool)
        same[1:] = padded[order[1:] + prefix[1:]] == padded[order[:-1] + prefix[1:]]
        prefix += width * same
        width //= 2
    return order, np.minimum(prefix, depth)


def window_pages(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each word of each of these distinct pages, the number of pages that have the run from there on."""
    number: dict[str, int] = {}
    flat: list[int] = []
    for at, own in enumerate(streams):
        flat += [number.setdefault(w, len(number)) for w in own]
        flat.append(-1 - at)  # equals no other, so no run that is shared crosses it
    if not flat:
        return []
    sizes = np.array([len(s) + 1 for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes)
    order, prefix = suffix_array(np.array(flat, np.int64), run)
    group = np.cumsum(prefix < run) - 1
    pairs = np.unique(group * len(streams) + owner[order])
    times = np.bincount(pairs // len(streams))
    counts = np.zeros(len(flat), np.int64)
    counts[order] = times[group]
    return [c[:-1] for c in np.split(counts, np.cumsum(sizes)[:-1])]


def _cover(counts: np.ndarray, need: int | None, run: int = RUN) -> np.ndarray:
    """The words that lie in a run that so many pages have."""
    if need is None:
        return np.zeros(len(counts), bool)
    change = np.zeros(len(counts) + run + 1, np.int64)
    at = np.flatnonzero(counts >= need)
    change[at] += 1
    change[at + run] -= 1
    return np.cumsum(change)[: len(counts)] > 0


def cleaned(page: list[tuple[int, str]], counts: np.ndarray, pages: int) -> tuple[str, int]:
    """A page's text, and how many of its words went as boilerplate; counts: pages of each run of its stream."""
    kept: list[str] = []
    removed, at = 0, 0
    places, inside = [], counts.copy()
    for place, text in page:
        n = text.count(" ") + 1
        places.append((place, text, at, n))
        inside[at + max(0, n - RUN + 1) : at + n + 1] = 0  # runs over the block's end
        at += n + 1
    open_cover, inner_cover, main_cover = _cover(counts, open_need(pages)), _cover(inside, open_need(pages)), _cover(counts, main_need(pages))
    if any(p != OPEN for p, _ in page):
        main = [(n, bool(main_cover[at : at + n].all())) for place, _, at, n in places if place == MAIN]
        may_go = sum(n for n, whole in main if whole) <= MOST_OF_MAIN * sum(n for n, _ in main)
        for place, text, at, n in places:
            if place == OPEN:
                continue
            if place == MAYBE:
                goes = open_cover[at : at + n].all() or 2 * inner_cover[at : at + n].sum() >= n
            else:
                goes = may_go and main_cover[at : at + n].all()
            if goes:
                removed += n
            else:
                kept.append(text)
        return " ".join(kept), removed
    for _, text, at, n in places:
        gone = open_cover[at : at + n]
        if not gone.all():
            gone = inner_cover[at : at + n]
        if gone.any():
            removed += int(gone.sum())
            text = " ".join(w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g)
        if text:
            kept.append(text)
    if not kept:
        return " ".join(text for _, text in page), 0
    return " ".join(kept), removed


def page_texts(pages: list[list[tuple[int, str]]]) -> list[tuple[str, int]]:
    """The text of each of a host's pages, and how many words of it went as boilerplate."""
    distinct: dict[tuple, int] = {}
    numbers = [distinct.setdefault(tuple(page), len(distinct)) for page in pages]
    found = window_pages([stream(list(page)) for page in distinct])
    return [cleaned(page, found[i], len(distinct)) for page, i in zip(pages, numbers, strict=True)]


# ---- large hosts -------------------------------------------------------------------

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WindowHashes:
    """128-bit hashes of runs of words, as two signed numbers; keeps the hashes of words it has seen."""

    MOST = 1_000_000

    def __init__(self):
        self.words: dict[str, int] = {}

    def __call__(self, words: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        known = self.words
        if len(known) > self.MOST:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.array([known[w] for w in words], np.uint64)
        n = max(0, len(h) - run + 1)
        a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        other = (h ^ h >> np.uint64(31)) * _P2
        for i in range(run):
            a = a * _P1 + h[i : i + n]
            b = b * _P2 + other[i : i + n]
        return (a ^ a >> np.uint64(29)).view(np.int64), (b ^ b >> np.uint64(29)).view(np.int64)


def counts_of(h1: np.ndarray, h2: np.ndarray, known1: np.ndarray, known2: np.ndarray, pages: np.ndarray, length: int) -> np.ndarray:
    """As window_pages for one page: pages of its runs h1, h2, of those known (which come by known1)."""
    counts = np.zeros(length, np.int64)
    if len(h1) and len(known1):
        # known1 hardly ever has equals; the few places behind the first are tried too
        at = np.searchsorted(known1, h1)
        for step in range(2):
            i = np.minimum(at + step, len(known1) - 1)
            hit = (known1[i] == h1) & (known2[i] == h2)
            counts[: len(h1)][hit] = pages[i[hit]]
    return counts


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of numbers, null as empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_PAGE = "host string, number long, n long, places array<int>, texts array<string>"


def _distinct_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, n, html) to the blocks of pages, each distinct page of a host once for a task."""
    seen: set[tuple] = set()
    for batch in batches:
        for part in rows_of(batch, 256):
            rows = []
            for host, n, html in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                page = blocks(html)
                number = page_number(page)
                if (host, number) not in seen:
                    seen.add((host, number))
                    rows.append((host, number, n, [p for p, _ in page], [t for _, t in page]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "number", "n", "places", "texts"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by (host, g, number) to the runs that half of a group's distinct pages have."""
    hashes, key, last, held = WindowHashes(), None, None, []

    def found() -> Iterator[pa.RecordBatch]:
        if held:
            out = set()
            for words, counts in zip(held, window_pages(held), strict=True):
                at = np.flatnonzero(2 * counts >= len(held))
                at = at[at + RUN <= len(words)]
                if len(at):
                    h1, h2 = hashes(words)
                    out.update(zip(h1[at].tolist(), h2[at].tolist(), strict=True))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["host", "h1", "h2"]
            )

    for batch in batches:
        for host, g, number, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (host, g) != key:
                yield from found()
                key, last, held = (host, g), None, []
            if number != last:
                held.append(stream([(OPEN, t) for t in texts]))
                last = number
    yield from found()


def _few(df: DataFrame) -> tuple[DataFrame, int]:
    """A table, to be broadcast if it has few rows, and how many it has (one more than the bound, if more)."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


def _by_host(runs: DataFrame, *columns: str) -> DataFrame:
    """(host, a list for each column) of runs, each list in the order of h1."""
    listed = runs.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"))
    return listed.select("host", *[F.col(f"all.{c}").alias(f"k_{c}") for c in columns])


def frequent_runs(pages: DataFrame) -> DataFrame | None:
    """(host, k_h1, k_h2, k_pages, distinct): the runs that open_need of a large host's pages have; None if there are none.

    pages: host, n (the host's pages), html.
    """
    g = F.pmod("number", F.ceil(F.col("n") / GROUP).cast("long"))
    dealt = pages.select("host", "n", "html").mapInArrow(_distinct_pages, _PAGE).withColumn("g", g).repartition("host", "g")
    sorted_pages = dealt.sortWithinPartitions("host", "g", "number").select("host", "g", "number", "texts")
    tried = durable(sorted_pages.mapInArrow(_candidates, "host string, h1 long, h2 long").distinct())
    lists, n_tried = _few(tried)
    if not n_tried:
        return None
    lists = _by_host(tried, "h1", "h2")
    lists = F.broadcast(lists) if n_tried <= BROADCAST_ROWS else lists

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WindowHashes(), set()
        for batch in batches:
            for part in rows_of(batch, 256):
                rows = []
                known = zip(_lists(part.column(2)), _lists(part.column(3)), strict=True)
                for host, html, (k1, k2) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), known, strict=True):
                    page = blocks(html)
                    number = page_number(page)
                    if (host, number) in seen:
                        continue
                    seen.add((host, number))
                    words = stream(page)
                    has = counts_of(*hashes(words), k1, k2, np.arange(1, len(k1) + 1), len(words))
                    rows.append((host, number, np.unique(has[has > 0]).tolist()))
                columns = list(zip(*rows, strict=True)) or [()] * 3
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "number", "has"])

    asked = pages.select("host", "html").join(lists, "host").select("host", "html", "k_h1", "k_h2")
    # a distinct page may come from several tasks: equal rows
    each = written(asked.mapInArrow(counted, "host string, number long, has array<int>").distinct(), "runs")
    distinct = each.groupBy("host").agg(F.count("*").alias("distinct"))
    times = each.select("host", F.explode("has").alias("i")).groupBy("host", "i").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(2), F.floor((F.col("distinct") + 1) / 2))
    named = _by_host(tried, "h1", "h2").select("host", F.posexplode(F.arrays_zip("k_h1", "k_h2")).alias("p", "k"))
    runs = times.join(distinct, "host").where(F.col("pages") >= need).join(named.withColumn("i", F.col("p") + 1), ["host", "i"])
    runs = durable(runs.select("host", F.col("k.k_h1").alias("h1"), F.col("k.k_h2").alias("h2"), "pages", "distinct"))
    _, n_runs = _few(runs)
    if not n_runs:
        return None
    found = _by_host(runs, "h1", "h2", "pages", "distinct").select("host", "k_h1", "k_h2", "k_pages", F.element_at("k_distinct", 1).alias("distinct"))
    return F.broadcast(found) if n_runs <= BROADCAST_ROWS else found


# ---- the operator ------------------------------------------------------------------

_RESULT = "page_id long, url string, text string, n_chars long, n_repeated long"


def _results(page_ids: pa.Array, urls: pa.Array, found: list[tuple[str, int]]) -> list[pa.Array]:
    texts, removed = [t for t, _ in found], [n for _, n in found]
    return [page_ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())]


_COLUMNS = ["page_id", "url", "text", "n_chars", "n_repeated"]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) of each page; see the module."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    listed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host.alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    large, n_large = _few(listed.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in rows_of(batch, 256):
                made = [blocks(t) for t in some.column(3).to_pylist()]
                places = pa.array([[p for p, _ in page] for page in made], pa.list_(pa.int32()))
                texts = pa.array([[t for _, t in page] for page in made], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(3)], places, texts], ["page_id", "url", "host", "places", "texts"])

    def clean(group: pa.Table) -> pa.Table:
        made = [list(zip(p, t, strict=True)) for p, t in zip(group["places"].to_pylist(), group["texts"].to_pylist(), strict=True)]
        return pa.table(_results(group["page_id"], group["url"], page_texts(made)), _COLUMNS)

    def clean_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WindowHashes()
        for batch in batches:
            for part in rows_of(batch, 256):
                found = []
                known = zip(*(_lists(part.column(i)) for i in (3, 4, 5)), strict=True)
                for html, (k1, k2, times), distinct in zip(part.column(2).to_pylist(), known, part.column(6).to_pylist(), strict=True):
                    page = blocks(html)
                    words = stream(page)
                    counts = counts_of(*hashes(words), k1, k2, times, len(words)) if len(k1) else np.zeros(len(words), np.int64)
                    found.append(cleaned(page, counts, distinct or 0))
                yield pa.RecordBatch.from_arrays(_results(part.column(0), part.column(1), found), _COLUMNS)

    small_batches(pages.sparkSession)
    kinds = "page_id long, url string, host string, places array<int>, texts array<string>"
    small = listed.join(large, "host", "left_anti").select(*listed.columns) if n_large else listed
    done = small.select("page_id", "url", "host", "html").mapInArrow(cut, kinds).groupBy("host").applyInArrow(clean, _RESULT)
    if not n_large:
        return done
    of_large = listed.join(large, "host").select(*listed.columns, "n")
    runs = frequent_runs(of_large)
    if runs is None:
        none = F.array().cast("array<long>")
        each = of_large.select("page_id", "url", "html", none.alias("k_h1"), none.alias("k_h2"), none.alias("k_pages"), F.lit(0).cast("long").alias("distinct"))
    else:
        each = of_large.join(runs, "host", "left").select("page_id", "url", "html", "k_h1", "k_h2", "k_pages", "distinct")
    return done.union(each.mapInArrow(clean_each, _RESULT))
