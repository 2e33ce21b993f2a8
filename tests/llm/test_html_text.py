from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from corvane.llm import html_text as H


def texts(page):
    return [t for _, t in H.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("just  text", ["just text"]),
        ("<p>a&amp;b <b>c</b>d<br>e", ["a&b cd", "e"]),
        ("<p>one<p>two", ["one", "two"]),
        ("<p><b>x.<br><p>y</p>", ["x.", "y"]),
        ("a<!-- b --><script>if (a<b) '</p>'</script>c", ["a", "c"]),
        ("<style>p{}</style><title>t</title><p>x</p>", ["x"]),
        ("<nav>n</nav><header>h</header><p>x</p><footer>f</footer><aside>s</aside><form>q</form>", ["x"]),
        ("<div class='cookie-notice'>n</div><div id=\"sideBar\">s</div><div class=ad>a</div><p>x</p>", ["x"]),
        ("<div class='site-notice main'>n</div><div id=related-posts-3>s</div><p title='class=ad'>x</p>", ["x"]),
        ("<section class='comments'><article class='comment'><p>c</p></article></section><p>x</p>", ["x"]),
        ("<div hidden>h</div><div style='display: none'>h</div><div role=navigation>h</div><p>x</p>", ["x"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("1 < 2 &lt; 3 &#x41; &middot;&nbsp;x", ["1 < 2 < 3 A · x"]),
        ("<a title='x > y'>z</a>", ["z"]),
        ("<p>unclosed <b", ["unclosed <b"]),
        ("<p title=\"never closed>a</p><p>b</p>", ["a", "b"]),
        ("a<span class=ad>x<span>y</span>z</span>b", ["a", "b"]),
        ("<iframe src=x>a<p>b", ["a", "b"]),
        ("<div class=with-sidebar><p>a</p></div>", ["a"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("unit", ["<a x ", "<div>", "<a \"", "<a '", "<a \">\"", "<!-", "<iframe>", "</p", "<li><div>", "<p <", "&", "<a b='", "<td><ul>"])
def test_tokenising_is_linear(unit):
    times = []
    for n in (1 << 15, 1 << 18):
        page = unit * (n // len(unit))
        began = time.perf_counter()
        H.blocks(page)
        times.append(time.perf_counter() - began)
    assert times[0] < 0.2 and times[1] < 1.5, times


def test_main_text_wins():
    page = "<body><div>open</div><article><header><h1>T</h1></header><p>x</p><footer>by</footer></article><p>after</p></body>"
    assert H.page_texts([H.blocks(page)]) == [("T x", 0)]


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = rng.integers(0, 3, 40)
        order, prefix = H.suffix_array(s, 8)
        keys = [tuple(s[i : i + 8]) for i in order]
        assert sorted(order.tolist()) == list(range(40)) and keys == sorted(keys)
        for a, b, p in zip(keys, keys[1:], prefix[1:].tolist(), strict=False):
            assert p == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_window_pages_equal_brute_force():
    rng = random.Random(2)
    streams = [[rng.choice("ab") for _ in range(rng.randint(0, 25))] for _ in range(7)]
    found = H.window_pages(streams, 4)
    owners: dict[tuple, set] = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - 3):
            owners.setdefault(tuple(s[i : i + 4]), set()).add(k)
    for s, counts in zip(streams, found, strict=True):
        assert len(counts) == len(s)
        assert counts[: max(0, len(s) - 3)].tolist() == [len(owners[tuple(s[i : i + 4])]) for i in range(len(s) - 3)]


LINE = "welcome to our great site with many fine things"


def test_boilerplate_goes_and_unique_runs_stay():
    pages = [f"<div>{LINE} on page</div><p>text {i} is here, unique{i}, and nowhere{i} else at all</p><div>{LINE}</div>" for i in range(4)]
    found = H.page_texts([H.blocks(p) for p in pages])
    assert found[2][0] == "text 2 is here, unique2, and nowhere2 else at all"
    # the same page twice is one page: nothing is boilerplate by that
    assert H.page_texts([H.blocks(pages[0])] * 2)[0][1] == 0


def test_short_lines_in_a_row_are_a_run():
    menu = "".join(f"<div>{w}</div>" for w in "Home News Sport About Contact Imprint".split())
    pages = [f"{menu}<p>story {i} of its own</p>" for i in range(5)]
    assert [t for t, _ in H.page_texts([H.blocks(p) for p in pages])] == [f"story {i} of its own" for i in range(5)]


def test_a_page_that_is_a_copy_keeps_its_text():
    shared = " ".join(f"word{k}" for k in range(30))
    found = H.page_texts([H.blocks(f"<p>{shared}</p>"), H.blocks(f"<p>{shared}</p><p>and more words of this page alone</p>")])
    assert found[0] == (shared, 0)
    assert found[1][0] == "and more words of this page alone"


def test_names_that_only_hint_are_decided_by_the_host():
    """Inside an article: a hinted element stays if its words are its own, goes if half of the pages have them."""
    body = lambda i, name, text: f"<article><p>story {i} told once</p><div class='{name}'>{text}</div></article>"
    own = [body(i, "notice-period", f"the period of notice in case {i} is " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(6)]
    for i, (t, n) in enumerate(H.page_texts([H.blocks(p) for p in own])):
        assert t.startswith(f"story {i} told once the period of notice") and n == 0
    same = [body(i, "related-work", LINE + " and more for you") for i in range(6)]
    for i, (t, n) in enumerate(H.page_texts([H.blocks(p) for p in same])):
        assert t == f"story {i} told once" and n == 13


def test_site_wide_notices_in_articles_go_and_copies_stay():
    story = lambda i: " ".join(f"s{i}w{k}" for k in range(40))
    pages = [f"<article><p>{story(i)}</p><p>{LINE}</p></article>" for i in range(12)]
    assert H.page_texts([H.blocks(p) for p in pages]) == [(story(i), 9) for i in range(12)]
    # on few pages, or on most pages of a small host, it is text
    assert H.page_texts([H.blocks(p) for p in pages[:9]])[0] == (f"{story(0)} {LINE}", 0)
    some = pages[:9] + [f"<article><p>{story(i)}</p></article>" for i in range(20, 26)]
    assert H.page_texts([H.blocks(p) for p in some])[0][1] == 0
    # near copies of one article: their shared paragraphs are no notice
    copies = [f"<article><p>{story(1)}</p><p>{story(2)}</p><p>mine {i}</p></article>" for i in range(12)]
    assert H.page_texts([H.blocks(p) for p in copies])[3] == (f"{story(1)} {story(2)} mine 3", 0)


class Plain(HTMLParser):
    """The text of the article elements, by the standard library's parser."""

    inline = frozenset(("a", "b", "i", "em", "strong", "span"))
    out = frozenset(("nav", "footer", "aside", "form", "script", "style"))

    def __init__(self):
        super().__init__()
        self.inside, self.aside, self.got = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.aside += tag in self.out
        if tag not in self.inline:
            self.got.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.aside -= tag in self.out
        if tag not in self.inline:
            self.got.append(" ")

    def handle_data(self, data):
        if self.inside and not self.aside:
            self.got.append(data)


def test_the_query_equals_an_independent_extraction(spark, sf_dir):
    import __spark_entry__ as entry

    found = {r.page_id: r for r in entry.queries()["op9_html_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        made = Plain()
        made.feed(r.html or "")
        want = " ".join("".join(made.got).split())
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, want, len(want))


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 3)
    rows = [(i, f"http://h.example/{i}", f"<article><p>text {i} &amp; more</p></article><footer>f</footer>", "x") for i in range(10)]
    rows += [(20, None, None, "x"), (21, "no host", "", "x"), (22, "http://one.example/", "<p>alone</p>", "x"), (22, "http://one.example/", "<p>alone</p>", "x")]
    rows += [(None, "http://one.example/2", "<p>other</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    for most in (50_000, 0):
        monkeypatch.setattr(H, "BROADCAST_ROWS", most)
        found = sorted((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df).na.fill("-", ["url"]).na.fill(99, ["page_id"]).collect())
        assert found[:10] == [(i, f"http://h.example/{i}", f"text {i} & more", 13) for i in range(10)]
        assert found[10:] == [
            (20, "-", "", 0), (21, "no host", "", 0), (22, "http://one.example/", "alone", 5), (22, "http://one.example/", "alone", 5), (99, "http://one.example/2", "other", 5)
        ]
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_large_hosts_have_the_same_rules(spark, monkeypatch, most):
    rng = random.Random(3)
    word = lambda i, k: f"w{i}x{k}"
    section = " ".join(f"section{k}" for k in range(12))
    bodies = []
    for i in range(60):
        kind = rng.randrange(5)
        own = "<p>" + " ".join(word(i, k) for k in range(30)) + "</p>"
        head = f"<div>{LINE}</div>" if rng.random() < 0.7 else ""
        notice = f"<p>{LINE}</p>" if rng.random() < 0.9 else ""
        bodies.append(
            [f"{head}{own}<div>{section} {i}</div>", f"<article>{own}{notice}<div class='related-work'>{LINE} {LINE}</div></article>", f"{head}{own}", f"<article>{own}{notice}</article>", f"{head}<p>{section}</p>"][kind]
        )
    bodies += [bodies[5]] * 30 + [""]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    want = H.page_texts([H.blocks(b) for b in bodies])
    assert sum(n > 0 for _, n in want) > 20
    monkeypatch.setattr(H, "BROADCAST_ROWS", most)
    for group in (4, 1000):
        monkeypatch.setattr(H, "GROUP", group)
        found = sorted((r.page_id, r.text, r.n_chars, r.n_repeated) for r in H.extract(df).collect())
        assert found == [(i, t, len(t), n) for i, (t, n) in enumerate(want)]
