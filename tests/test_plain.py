"""Queries without SQL against plain Python over the whole tables."""

from __future__ import annotations

import re
from functools import cache

import pytest

from corvane.operators.ngrams import FUNCTION_WORDS
from corvane.plans import registry


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    def read(name: str):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()

    return cache(read)


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return lambda name: [tuple(r) for r in registry.queries()[name](spark, sf_dir).collect()]


def words(text):
    text = (text or "").lower().replace("’", "'").replace("ʼ", "'")
    return [w for w in (x.strip("'") for x in re.findall("[a-z']+", text)) if w]


def sentences(text):
    return [s for s in (x.strip(" ") for x in re.findall(r"[^.!?]+[.!?]*", text or "")) if s]


def conversations(rows):
    out: dict = {}
    for r in rows("conversations"):
        out.setdefault(r.conv_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.turn) for k, v in out.items()}


def test_increasing_repair(rows, found):
    groups: dict = {}
    for order, line, at, repaired in found("win10_increasing_repair"):
        groups.setdefault(order, []).append((line, at, repaired))
    given: dict = {}
    for r in rows("lineitem"):
        given.setdefault(r.l_orderkey, []).append((r.l_linenumber, int(r.l_quantity)))
    assert {k: sorted((a, b) for a, b, _ in v) for k, v in groups.items()} == {k: sorted(v) for k, v in given.items()}
    for own in groups.values():
        own.sort()
        values = [at for _, at, _ in own]
        want, i = list(values), 0
        while i < len(want):
            low = want[i - 1] if i else -1
            if want[i] > low:
                i += 1
                continue
            run = next((k for k in range(i, len(want)) if want[k] > low), len(want))
            high = values[run] if run < len(want) else 60
            for k in range(i, run):
                want[k] = low + max(k - i + 1, (high - low) * (k - i + 1) // (run - i + 1))
            i = run
        assert [r for *_, r in own] == want
        # a run of more lines than there is room for can't rise within its bounds, but it does rise
        assert all(want[k] > want[k - 1] for k in range(1, len(want)) if want[k] != values[k])


def test_sentence_snap(rows, found):
    want = set()
    for r in rows("benchmark"):
        target = len(r.text) // 2
        starts, at = [], 0
        for m in re.finditer(r"[^.!?]*[.!?]*\s*", r.text):
            starts.append(m.start())
        later = [s for s in starts if s >= target - 12]
        want.add((r.item_id, target, later[0] if later else starts[-1]))
    assert set(found("win17_sentence_snap")) == want


def test_greedy_pages(rows, found):
    def packed(groups: dict, most: int) -> set:
        out = set()
        for key, items in groups.items():
            page = held = 0
            for name, n in sorted(items):
                if held and held + n > most:
                    page, held = page + 1, 0
                held += n
                out.add((key, name, n, page))
        return out

    lines: dict = {}
    for r in rows("lineitem"):
        lines.setdefault(r.l_orderkey, []).append(r.l_linenumber)
    orders: dict = {}
    ticks: dict = {}
    for r in rows("orders"):
        own = sorted(set(lines.get(r.o_orderkey, [])))
        if own:
            orders.setdefault(r.o_custkey, []).append((r.o_orderkey, len(lines[r.o_orderkey])))
            near = {own[j] for i, n in enumerate(own) if n == 1 or n % 5 == 0 for j in (i - 1, i, i + 1) if 0 <= j < len(own)}
            if near:
                ticks.setdefault(r.o_custkey, []).append((r.o_orderkey, len(near)))
    assert set(found("pag02_greedy_pages")) == packed(orders, 40)
    assert set(found("aln07_batches")) == packed(ticks, 30)


def test_proportional_split(rows, found):
    got: dict = {}
    for conv, turn, n, cut in found("win19_proportional_split"):
        got.setdefault(conv, []).append((turn, n, cut))
    for conv, turns in conversations(rows).items():
        sizes = [len((t.text or "").split()) for t in turns]
        own = sorted(got[conv])
        assert [n for _, n, _ in own] == sizes
        cuts = [c for *_, c in own]
        assert all(a < b for a, b in zip(cuts, cuts[1:], strict=False))
        # where the plain shares rise, they are the cuts
        shares = [round(100 * sum(sizes[:k]) / max(1, sum(sizes))) for k in range(len(sizes))]
        if all(a < b for a, b in zip(shares, shares[1:], strict=False)) and shares:
            assert cuts == shares


def best_path(scores):
    """The largest sum of a path that never goes back, the first columns of equal ones, by trying all from the end."""
    n, m = len(scores), len(scores[0])

    @cache
    def best(i, j):
        """The best sum of rows up to i that ends at column j."""
        return scores[i][j] + (max(best(i - 1, k) for k in range(j + 1)) if i else 0.0)

    path = [max(range(m), key=lambda j: (best(n - 1, j), -j))]
    for i in range(n - 2, -1, -1):
        path.append(max(range(path[-1] + 1), key=lambda j: (best(i, j), -j)))
    return path[::-1]


def test_monotonic_alignment(rows, found):
    got: dict = {}
    for conv, turn, partner, margin in found("aln03_monotonic_alignment"):
        got.setdefault(conv, []).append((turn, partner, margin))
    for conv, turns in conversations(rows).items():
        a, b = ([t for t in turns if t.role == role] for role in ("user", "assistant"))
        if not a or not b:
            assert conv not in got
            continue
        scores = [[len(set(words(x.text)) & set(words(y.text))) / max(1, len(set(words(x.text)) | set(words(y.text)))) for y in b] for x in a]
        want = []
        for x, row, j in zip(a, scores, best_path(scores), strict=True):
            top = sorted(row, reverse=True)
            want.append((x.turn, b[j].turn, round(top[0] - (top[1] if len(top) > 1 else 0.0), 4)))
        assert sorted(got[conv]) == sorted(want)


def matches(a, b, similar, gap, floor, band):
    """Matched pairs of the best alignment within the band, by recursion over all cells."""
    n, m = len(a), len(b)
    wide = band + abs(n - m) // 4
    total = {(0, 0): (0.0, 0)}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j or abs(j - round(i * (m / n if n else 0.0))) > wide:
                continue
            tried = []
            if (i - 1, j - 1) in total and (s := similar(a[i - 1], b[j - 1])) >= floor:
                tried.append((total[i - 1, j - 1][0] + s, 2, total[i - 1, j - 1][1] + 1))
            if (i - 1, j) in total:
                tried.append((total[i - 1, j][0] - gap, 1, total[i - 1, j][1]))
            if (i, j - 1) in total:
                tried.append((total[i, j - 1][0] - gap, 0, total[i, j - 1][1]))
            if tried:
                value, _, k = max(tried)
                total[i, j] = (value, k)
    return total[n, m][1] if (n, m) in total else None


def test_banded_alignment(rows, found):
    by_source: dict = {}
    for r in rows("documents"):
        by_source.setdefault(r.source, []).append(r)
    got = dict(found("aln08_banded_alignment"))
    seeds = {}
    for doc, line, partner, _ in found("aln09_unique_seeds"):
        seeds.setdefault(doc, []).append((line, partner))
    n = 0
    for docs in by_source.values():
        docs.sort(key=lambda r: r.doc_id)
        for x, y in zip(docs, docs[1:], strict=False):
            a, b = ([set(t.lower().split()) for t in (r.text or "").split("\n")] for r in (x, y))
            n += 1
            want = matches(a, b, lambda p, q: len(p & q) / max(1, len(p | q)), 0.35, 0.3, 6)
            assert want is None or got[x.doc_id] == want
            chain = seeds.get(x.doc_id, [])
            assert all(p < r and q < s for (p, q), (r, s) in zip(chain, chain[1:], strict=False))
            full = [[set(t.lower().split()) for t in (r.text or "").split("\n") if t.strip()] for r in (x, y)]
            for i, k in chain:
                rare = [w for w in full[0][i] if len(w) >= 3 and sum(w in line for line in full[1]) == 1]
                assert any(w in full[1][k] for w in rare) and len(full[0][i] & full[1][k]) / len(full[0][i] | full[1][k]) >= 0.6
    assert len(got) == n


def test_token_diff(rows, found):
    got = {(c, t): n for c, t, n in found("aln12_token_diff")}
    pairs = 0
    for conv, turns in conversations(rows).items():
        for x, y in zip(turns, turns[1:], strict=False):
            if y.turn != x.turn + 1:
                continue
            a, b = words(x.text), words(y.text)
            row = [0] * (len(b) + 1)
            for w in a:
                last, row = row, [0]
                for j, v in enumerate(b):
                    row.append(last[j] + 1 if w == v else max(last[j + 1], row[j]))
            pairs += 1
            # anchors may cost a few words of the longest common subsequence, never give more
            assert got[conv, x.turn] <= row[-1]
            assert bool(got[conv, x.turn]) == bool(row[-1])
            if len(set(a)) == len(a) and len(set(b)) == len(b):
                assert got[conv, x.turn] == row[-1]
    assert len(got) == pairs


def test_beads(rows, found):
    got = {(c, t): (n, one) for c, t, n, one in found("aln14_bead_alignment")}
    pairs = 0
    for conv, turns in conversations(rows).items():
        answers = {t.turn: t for t in turns if t.role == "assistant"}
        for x in turns:
            if x.role != "user" or x.turn + 1 not in answers:
                continue
            a, b = ([len(s) for s in sentences(t.text)] for t in (x, answers[x.turn + 1]))

            def score(p, q):
                u, v = sum(p), sum(q)
                return -0.5 if not u or not v else 1 - abs(u - v) / max(u, v) - 0.1 * (len(p) + len(q) - 2)

            best = {(0, 0): (0.0, 0, 0)}
            for i in range(len(a) + 1):
                for j in range(len(b) + 1):
                    for p, q in ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1)):
                        if (i - p, j - q) in best and i >= p and j >= q:
                            s, n, one = best[i - p, j - q]
                            s += score(a[i - p : i], b[j - q : j])
                            if (i, j) not in best or s > best[i, j][0]:
                                best[i, j] = (s, n + 1, one + (p == q == 1))
            pairs += 1
            assert got[conv, x.turn] == best[len(a), len(b)][1:]
    assert len(got) == pairs


def test_fuzzy_spans_are_alike(rows, found):
    docs = {r.doc_id: words(r.text) for r in rows("documents")}
    items = {r.item_id: words(r.text) for r in rows("benchmark")}
    stop = set("the and of to a in is".split())
    by_pair: dict = {}
    for doc, item, lo, hi, item_lo, item_hi, score in found("jn17_fuzzy_spans"):
        a, b = docs[doc][lo:hi], items[item][item_lo:item_hi]
        by_pair.setdefault((doc, item), []).append((lo, hi, item_lo, item_hi))
        assert hi - lo >= 8 and score == 3 * sum(w not in stop for w in a)
        row = list(range(len(b) + 1))
        for i, w in enumerate(a):
            last, row = row, [i + 1]
            for j, v in enumerate(b):
                row.append(min(last[j] + (w != v), last[j + 1] + 1, row[j] + 1))
        assert row[-1] <= len(a) // 6
    # every item that stands in a document word by word is found whole
    for i, item in items.items():
        text = f" {' '.join(item)} "
        for d, doc in docs.items():
            if len(item) >= 8 and text in f" {' '.join(doc)} ":
                assert any(item_lo == 0 and item_hi == len(item) for _, _, item_lo, item_hi in by_pair[d, i])


def test_windows_rows_and_anchors(rows, found):
    answers = {(c, t): (w, s) for c, t, w, s in found("aln10_best_window")}
    relined: dict = {}
    for conv, turn, row, n, cover in found("aln11_relined"):
        relined.setdefault((conv, turn), []).append((row, n, cover))
    anchors: dict = {}
    for conv, turn, offset, told, _ in found("aln04_chapter_alignment"):
        anchors.setdefault(conv, []).append((turn, offset, told))
    for conv, turns in conversations(rows).items():
        asked = [t for t in turns if t.role == "user"]
        prose = " ".join(t.text or "" for t in turns if t.role == "assistant")
        for t in turns:
            if t.role == "assistant" and asked:
                window, cover = answers[conv, t.turn]
                assert window in {q.turn for q in asked} and 0 <= cover <= 1
        for q in asked:
            if nxt := [t for t in turns if t.turn == q.turn + 1 and t.role == "assistant"]:
                lines = sentences(q.text)
                own = sorted(relined.get((conv, q.turn), []))
                assert [r for r, *_ in own] == list(range(len(lines)))
                assert sum(n for _, n, _ in own) == (len(words(nxt[0].text)) if lines else 0)
        own = anchors.get(conv, [])
        assert [o for _, o, _ in own] == sorted({o for _, o, _ in own}) and all(0 <= o <= len(prose) for _, o, _ in own)
        assert not own or own[0][1:] == (0, "certain")


def test_function_words_are_words():
    assert len(set(FUNCTION_WORDS)) > 100 and all(w == w.strip().lower() for w in FUNCTION_WORDS)
