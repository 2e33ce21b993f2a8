"""Operators on small inputs whose results are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import alignment as A
from corvane.operators import concordance as C
from corvane.operators import quality as D
from corvane.operators import relations as R
from corvane.operators import search as S
from corvane.operators import similarity as M
from corvane.operators import tokens as K
from corvane.operators import windows as W
from corvane.operators.assembly import assembled_chapters, notes_by_book, uncited
from corvane.operators.ngrams import all_grams, grams


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def segments(spark):
    rows = [
        (0, "s", "en", "logos areth pasa meqodos lozzz kai"),
        (1, "s", "en", "yuxh logos"),
        (2, "s", "en", "texnh xlogos"),
        (3, "s", "en", None),
        (4, "s", "en", ""),
    ]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def ids(df):
    return [i for (i,) in values(df.distinct(), "doc_id")]


@pytest.mark.parametrize(
    ("terms", "mode", "want"),
    [
        (["logos", "areth"], "all", [0]),
        (["yuxh", "areth"], "any", [0, 1]),
        (["l*s"], "any", [0, 1]),
        (["l*x"], "any", []),
        (["tex*"], "any", [2]),
        (["l?gos"], "any", [0, 1]),
        (["l?ogos"], "any", []),
        (["l?os"], "any", []),
        (["*logos"], "any", [0, 1]),
        (["*"], "any", []),
    ],
)
def test_terms(segments, terms, mode, want):
    toks = K.tokens(segments)
    assert ids(S.any_of(toks, terms) if mode == "any" else S.all_of(toks, terms)) == want


def test_phrases_and_marks(segments):
    assert values(S.phrase_starts(segments, [["logos"], ["areth"]]), "doc_id", "pos") == [(0, 0)]
    assert values(S.phrase_starts(segments, [["areth"], ["logos"]]), "doc_id", "pos") == []
    assert values(S.highlights(S.phrase_starts(segments, [["pasa"], ["meqodos", "x"]]), 2), "doc_id", "pos") == [(0, 2), (0, 3)]


def test_readings_are_capped_and_counted():
    found, total = S.readings([[str(i) for i in range(40)]] * 2)
    assert (len(found), total, found[1]) == (64, 1600, ("0", "1"))


def test_words_strip_apostrophes_before_counting(spark):
    df = spark.createDataFrame([("Speaker’s first ‘change’ ' isn’t the last.",)], "text string")
    (row,) = df.select(T.english_words(F.col("text")).alias("w")).collect()
    assert row.w == ["speaker's", "first", "change", "isn't", "the", "last"]


def test_folds():
    assert T.greek_fold("λόγος") == "logos"
    assert T.greek_fold("lo/gos") == "logos"
    assert T.greek_fold("*a)nqrwpos") == "anqrwpos"
    assert T.greek_fold("δ’") == "d'"
    assert T.greek_key("λὸγος") == "lo/gos"
    assert T.greek_key("Ἀθῆναι") == "*a)qh=nai"
    with pytest.raises(ValueError):
        T.greek_key("7")
    assert T.latin_fold("Æneïs Juvat") == "aeneisiuuat"
    assert T.accent_norm("ΛΌΓΟΣ") == "λόγοσ"
    assert T.heading_norm("Περὶ Ψυχῆς, II!") == "περι ψυχης ii"
    assert T.straight_elision("ἀλλ᾽") == "ἀλλ'"


def test_lookup_variants_keep_their_order(spark):
    rows = [("proi+/ento", False), ("h(ra/kleitos", True), ("i+/n", True), ("'s", True), (None, True)]
    df = spark.createDataFrame(rows, "key string, capital boolean").select("key", T.lookup_variants(F.col("key"), F.col("capital")).alias("v"))
    assert [v for (v,) in df.select("v").collect()][:4] == [
        ["proi+/ento", "proi/ento", "proi(/ento", "proi)/ento"],
        ["h(ra/kleitos", "*(hra/kleitos"],
        ["i+/n", "i/n", "i(/n", "i)/n", "*+/in", "*/in", "*(/in", "*)/in"],
        ["'s", "*'s"],
    ]
    words = ["virumque", "Atque", "Romane", "que", "esne", "", None, "Quisque"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(T.latin_variants(F.col("w")).alias("v"))
    assert [v for (v,) in df.collect()] == [
        ["virumque", "virum"],
        ["atque", "Atque"],
        ["romane", "roma", "Romane", "Roma"],
        ["que"],
        ["esne", "es"],
        [""],
        None,
        ["quisque", "quis", "Quisque", "Quis"],
    ]


def test_chapters_are_assembled_over_missing_columns(spark):
    chunks = spark.createDataFrame(
        [
            (1, 10, "alpha beta ", [(1, 0, True), (5, 6, True)], {}),
            (1, 12, "gamma delta", [(1, 0, True), (5, 2, False), (10, 6, True)], {"2": 6}),
            (1, 14, "", [], {}),
            (2, 16, "other book", [(1, 0, True)], {}),
        ],
        "book int, col int, text string, ticks array<struct<n:int,off:int,real:boolean>>, sections map<string,int>",
    )
    chapters = spark.createDataFrame(
        [(1, "0", 9, 3), (1, "1", 10, 3), (1, "2", 13, 20), (1, "3", 14, 1), (2, "4", 16, 1), (3, "5", 20, 1)], "book int, chapter string, col int, line int"
    )
    found = {r.chapter: (r.citation, r.text, [tuple(a) for a in r.anchors]) for r in assembled_chapters(chunks, chapters).collect()}
    assert found == {
        "1": ("10.3", "alpha beta gamma ", [("10.3", 0, "chapter"), ("10.5", 6, "half_column"), ("12.1", 11, "column")]),
        "2": ("13.20", "delta", [("13.20", 0, "chapter")]),
        "3": ("14.1", "", [("14.1", 0, "chapter")]),
        "4": ("16.1", "other book", [("16.1", 0, "chapter")]),
    }


def test_notes_take_the_number_of_their_first_book(spark):
    cited = spark.createDataFrame([(1, 1, 0, 7), (1, 1, 1, 3), (1, 2, 0, 7), (2, 1, 0, 3), (2, 1, 1, 9)], "book int, chapter int, pos int, note int")
    labels = notes_by_book(cited)
    assert {(r.note, r.label) for r in labels.collect()} == {(7, "1.1"), (3, "1.2"), (9, "2.1")}
    defined = spark.createDataFrame([(7,), (11,)], "note int")
    assert [r.note for r in uncited(defined, labels).collect()] == [11]


def test_grams_stay_in_their_document(spark):
    df = spark.createDataFrame([(1, "s", "en", "a b c"), (2, "s", "en", "d e f")], "doc_id long, source string, lang string, text string")
    assert [g for (g,) in values(grams(df, 2), "gram")] == ["a b", "b c", "d e", "e f"]
    assert {n for (n,) in values(all_grams(df), "n")} == {2, 3}


def test_grammar_is_decided_by_whole_readings(spark):
    toks = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 4)], "off int, sig_id int")
    found = C.grammar_hits(toks, C.signatures(spark), {"case": "nom"})
    assert values(found, "off", "certain") == [(1, True), (2, False), (3, False)]
    assert C.grammar_hits(toks, C.signatures(spark), {"case": "nom", "number": "pl"}).count() == 0


def test_redundant_analyses(spark):
    rows = [("k", "pleasure", True), ("k", "pleasure", False), ("k", "", False), ("k", "to be", False), ("u", "x", False), ("u", None, False)]
    kept = C.redundant_filter(spark.createDataFrame(rows, "k string, gloss string, resolved boolean"), "k")
    assert sorted(map(str, kept.collect())) == sorted(
        map(str, spark.createDataFrame([rows[0], rows[3], rows[4], rows[5]], "k string, gloss string, resolved boolean").collect())
    )


@pytest.mark.parametrize(
    ("n", "want"),
    [((0, 0, 2, "a"), "none"), ((0, 0, 3, "a"), "coined"), ((0, 1, 100, "a"), "none"), ((1, 0, 1, "a"), "rare"), ((4, 900, 0, "a"), "rare"), ((5, 0, 10, "a"), "none"), ((0, 0, 30, "*a"), "none"), ((2, 0, 30, "*a"), "none")],
)
def test_distinctiveness(spark, n, want):
    df = spark.createDataFrame([n], "b int, c int, h int, k string")
    assert df.select(C.distinctiveness_label(F.col("b"), F.col("c"), F.col("h"), F.col("k"))).first()[0] == want


def test_lexicon_verdicts(spark):
    rows = [([],), (["Arist."],), (["Arist.", "Ar."],), (["Alex.Aphr.", "Plu."],), (["Plu.", "Hom."],)]
    df = spark.createDataFrame(rows, "a array<string>")
    assert [r[0] for r in df.select(C.lexicon_verdict(F.col("a"))).collect()] == ["own-only", "own-only", "earlier-attested", "corroborated", "earlier-attested"]


@pytest.mark.parametrize("few", [10_000, 2])
def test_nearest_interval(spark, monkeypatch, few):
    import random

    monkeypatch.setattr(R, "BROADCAST_ROWS", few)
    rng = random.Random(few)
    spans = [(lo, lo + rng.choice([0, 3, 40, 700]), f"n{i:02d}") for i in range(25) for lo in (rng.randint(-50, 2000),)]
    points = [(i, rng.randint(-400, 3500)) for i in range(300)]
    found = R.nearest_interval(spark.createDataFrame(points, "i long, p long"), spark.createDataFrame(spans, "lo long, hi long, name string"), "p", "i")
    want = {i: (p, *min((max(lo - p, p - hi, 0), name) for lo, hi, name in spans)) for i, p in points}
    assert {r.i: (r.p, r.distance, r.name) for r in found.collect()} == want


def test_running_sums_and_neighbours_over_ranges(spark):
    import random

    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 9)) for g in ("a", None, "b") for k in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "g string, k long, v int")
    groups = {g: sorted((k, v) for h, k, v in rows if h == g) for g in ("a", None, "b")}
    summed = K.running_before(df, ["g"], "k", F.col("v"), "before", 20)
    assert {(r.g, r.k): r.before for r in summed.collect()} == {(g, k): sum(v for _, v in own[:i]) for g, own in groups.items() for i, (k, _) in enumerate(own)}
    for behind in (False, True):
        beside = {(r.g, r.k): r.x for r in K.neighbour(df, ["g"], "k", "x", behind, 20).collect()}
        step = 1 if behind else -1
        assert beside == {(g, k): own[i + step][0] if 0 <= i + step < len(own) else None for g, own in groups.items() for i, (k, _) in enumerate(own)}


def test_as_of_takes_the_last_start(spark):
    left = spark.createDataFrame([("a", 5), ("a", 20), ("a", -1), ("b", 3)], "g string, x int")
    right = spark.createDataFrame([("a", 0, "p"), ("a", 10, "q"), ("a", 20, "r")], "g string, x int, v string")
    assert sorted((r.g, r.x, r.v or "") for r in R.as_of(left, right, ["g"], "x", ["v"]).collect()) == [
        ("a", -1, ""),
        ("a", 5, "p"),
        ("a", 20, "r"),
        ("b", 3, ""),
    ]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 0, 10), (1, 8, 12)], "k int, lo int, hi int")
    assert values(R.maximal(df, "k"), "lo", "hi") == [(0, 10), (8, 12)]


def test_near_pairs_over_bucket_edges(spark):
    toks = spark.createDataFrame([(1, p, w) for p, w in enumerate("a x x x b x x x x a".split())], "doc_id int, pos int, word string")
    assert values(S.near_pairs(toks, "a", "b", 4), "a_off", "b_off") == [(0, 4)]
    assert values(S.near_pairs(toks, "a", "b", 5), "a_off", "b_off") == [(0, 4), (9, 4)]


BOOKS = [(0, 20), (20, 40)]
CHAPTERS = [(0, 10), (10, 20), (20, 30), (30, 40)]


@pytest.mark.parametrize(
    ("slots", "window", "units", "options", "want"),
    [
        ([[2], [4]], 5, BOOKS, {}, [2, 4]),
        ([[2], [4]], 1, BOOKS, {}, None),
        ([[4], [2]], 5, BOOKS, {}, [2, 4]),
        ([[4], [2]], 5, BOOKS, {"ordered": True}, None),
        ([[19], [21]], 50, BOOKS, {}, None),
        ([[8], [12]], 12, BOOKS, {}, [8, 12]),
        ([[8], [12]], 12, CHAPTERS, {}, None),
        ([[10], [5, 12], [18]], 8, BOOKS, {}, [10, 12, 18]),
        ([[10], [5, 12], [18]], 7, BOOKS, {}, None),
        ([[2], [2]], 5, BOOKS, {"same": [0, 0]}, None),
        ([[2], [2]], 5, BOOKS, {}, [2, 2]),
        ([[4], [2, 6]], 5, BOOKS, {"sides": ["near", "before"]}, [2, 4]),
        ([[4], [2, 6]], 5, BOOKS, {"sides": ["near", "after"]}, [4, 6]),
    ],
)
def test_proximity(slots, window, units, options, want):
    found = A.proximity_windows([[(p, 1) for p in s] for s in slots], window, units, **options)
    assert ([sorted(s for s, _ in w) for w in found] or [None])[0] == want


def test_monotonic_alignment_is_the_best_of_all():
    rng = np.random.default_rng(0)
    from itertools import combinations_with_replacement

    for _ in range(20):
        s = rng.random((4, 5)).round(2)
        path, _ = A.monotonic_alignment(s)
        assert path == sorted(path)
        best = max(sum(s[i][j] for i, j in enumerate(c)) for c in combinations_with_replacement(range(5), 4))
        assert abs(sum(s[i][j] for i, j in enumerate(path)) - best) < 1e-9


def test_token_diff():
    a = [f"w{i % 3000}" for i in range(6000)]
    b = [("x" if i % 100 == 50 else w) for i, w in enumerate(a)]
    found = A.matched_tokens(a, b)
    assert len(found) > 0.95 * len(a)
    assert all(a[i] == b[j] for i, j in found)
    assert found == sorted(found)


def test_banded_alignment():
    same = lambda x, y: float(x == y)
    assert A.banded_alignment(list("abcd"), list("abd"), same) == [(0, 0), (1, 1), (2, None), (3, 2)]
    assert A.banded_alignment([], list("ab"), same) == [(None, 0), (None, 1)]


def test_beads():
    score = lambda i, i2, j, j2: 1 - abs((i2 - i) - (j2 - j)) * 0.1 if i2 > i and j2 > j else -1.0
    assert A.bead_alignment([1, 1], [1, 1], score) == [(0, 1, 0, 1), (1, 2, 1, 2)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("abcde", "xxabcdeyy", [(0, 5, 2, 7)]),
        ("abcdef", "abcdef", [(0, 6, 0, 6)]),
        ("abcdef", "abxdef", [(0, 6, 0, 6)]),
        ("abcdef", "abdef", [(0, 6, 0, 5)]),
        ("abdefg", "abcdefg", [(0, 6, 0, 7)]),
        ("abcdefghijklm", "abcxdefghijlm", [(0, 13, 0, 13)]),
        ("abcd", "abxd", []),
        ("abcdefX", "abcdefY", [(0, 6, 0, 6)]),
    ],
)
def test_fuzzy_runs(a, b, want):
    assert A.fuzzy_runs(list(a), list(b)) == want


def test_strictly_increasing():
    assert W.strictly_increasing([0, 5, 5, 5, 9], 0, 20) == [0, 5, 6, 7, 9]
    got = W.strictly_increasing([3, 3, 3], 0, 4)
    assert got == sorted(set(got))


@pytest.mark.parametrize(
    ("word", "state"),
    [
        ("ἀλλά", "ok"), ("ῥήτωρ", "ok"), ("λόγος", "ok"), ("λόγὁς", "unexpected"), ("κἀγώ", "ok"), ("τἀγαθά", "ok"), ("αἰεἰ", "unexpected"),
        ("οὐδέν", "ok"), ("ἐγᾦδα", "crasis"), ("μεντἄν", "crasis"), ("καλοκἀγαθία", "crasis"), ("ἐῤῥήθη", "rho"), ("πυῤῥῷ", "rho"), ("", "ok"),
    ],
)
def test_breathings(word, state):
    assert D.breathing_state(word) == state
    assert D.illegal_breathing(word) == (state != "ok")


def test_margins_are_of_the_row():
    # the second row's best column is not the chosen one
    path, margins = A.monotonic_alignment(np.array([[0.1, 0.2, 0.9], [0.8, 0.3, 0.5]]))
    assert path == [2, 2] and np.allclose(margins, [0.7, 0.3])


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], ["a", "b"], ["b", "c"])], "a array<double>, b array<double>, x array<string>, y array<string>")
    row = df.select(M.cosine(F.col("a"), F.col("b")), M.jaccard(F.col("x"), F.col("y"))).first()
    assert abs(row[0] - 0.70710678) < 1e-6
    assert abs(row[1] - 1 / 3) < 1e-9


def test_dense_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (500, 3, 70, 9000, 1)], "x long")
    assert values(K.dense_rank_by(df, "x", 100), "x", "rank") == [(1, 1), (3, 2), (70, 3), (500, 4), (9000, 5)]


def test_banded_alignment_of_long_documents(spark, tmp_path):
    from corvane.plans import registry

    lines = [f"line {i} with the words w{i} x{i} y{i}" for i in range(100)]
    rows = [(0, "s", "short a\nshort b", 15), (1, "s", "\n".join(lines), 3500), (2, "s", "\n".join(lines), None), (3, "s", None, None), (4, "s", "short", 5)]
    made = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["aln08_banded_alignment"](spark, str(tmp_path))
    assert values(found, "doc_id", "matched") == [(0, 0), (1, 100), (2, 0), (3, 0)]


def test_long_stretches_without_anchors_are_matched():
    rng = np.random.default_rng(3)
    a, b = ([f"w{k}" for k in rng.integers(0, 12, n)] for n in (1100, 900))
    # every word more than once on both sides, so there is no anchor
    assert min(a.count(w) for w in set(a)) > 1 and min(b.count(w) for w in set(b)) > 1
    found = A.matched_tokens(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:], strict=False))
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert len(found) == row[-1]


def test_eight_words_with_errors_hold_four_equal_ones():
    """What the join of four-word runs may rely on: n words, one error for six of them at most."""
    for n in range(8, 60):
        errors = n // 6
        # errors part the equal words into so many runs at most; a gap on the left takes a word of the run as well
        assert -(-(n - errors) // (errors + 1)) >= 4


def test_unique_seeds():
    split = lambda *t: [x.split() for x in t]
    window = split("alpha beta gamma", "delta epsilon zeta", "eta theta iota", "alpha kappa lambda")
    lines = split("beta gamma alpha", "theta eta iota", "delta epsilon zeta", "lambda kappa alpha", "unknown words here", "alpha alpha alpha")
    assert [(i, k) for i, k, _ in A.unique_seeds(lines, window)] == [(0, 0), (1, 2), (3, 3)]
    assert A.unique_seeds([], window) == [] and A.unique_seeds(lines, []) == []


def test_windows_and_states():
    sets = lambda *t: [set(x.split()) for x in t]
    chapters = [sets("a b c", "d e f"), sets("g h i", "j k l"), sets("m n o")]
    assert A.best_window(sets("g h i", "j k x"), chapters) == (1, pytest.approx(0.75))
    assert A.best_window(sets("g h i", "j k l"), chapters, 0) == (1, 1.0)
    assert A.best_window(sets("a b c", "d e x"), chapters, 0)[0] == 0
    assert [A.row_state(*x) for x in ((1, 0.9, 0.5, False), (1, 0.9, 0.05, False), (1, 0.9, 0.5, True), (1, 0.4, 0.5, False), (2, 0.9, 0.5, False), (0, 0, 0, False), (1, 0.1, 1, False))] == [
        "matched", "low", "low", "low", "merged", "missing", "missing"
    ]


def test_relined_keeps_rows_and_words():
    rows = [x.split() for x in ("a b c d", "e f g", "", "h i")]
    out, cover = A.relined("a b x c d e g h i y".split(), rows)
    assert out == ["a b x c d".split(), "e g".split(), [], "h i y".split()] and cover == pytest.approx(8 / 9)
    assert A.relined([], rows) == ([[], [], [], []], 0.0)


def test_chapter_anchors():
    prose = "Of birds first. Then fishes swim in water. Last of all stones lie still."
    refs = [(1, "birds"), (2, "the fishes that swim in water"), (3, "stones lie still")]
    assert [a[:3] for a in A.chapter_anchors(refs, prose)] == [(1, 0, "certain"), (2, 16, "reliable"), (3, 43, "reliable")]
    assert [a[:3] for a in A.chapter_anchors(refs, prose, {2: 20})][1] == (2, 20, "confirmed")
    assert [a[0] for a in A.chapter_anchors(refs, prose, {3: 2})] == [1, 2]
    assert A.chapter_anchors([], prose) == [] and A.chapter_anchors(refs, "") == []


def test_greek_tokens(spark):
    from corvane.functions import greek as G

    rows = [("λόγος, καὶ—<ψυ>χή· ἀλλ’ †ἦν† | — [.]",), ("",), (None,), ("  α  β",)]
    found = spark.createDataFrame(rows, "t string").select(G.greek_tokens(F.col("t")).alias("x")).collect()
    assert [(t.t, t.o, t.sigla) for t in found[0].x] == [("λόγος", 0, False), ("καὶ", 7, False), ("ψυχή", 11, True), ("ἀλλ’", 19, False), ("ἦν", 24, True)]
    assert [t.o for t in found[3].x] == [2, 5] and not found[1].x and not found[2].x


def test_readings_and_accents(spark):
    from corvane.functions import greek as G

    df = spark.createDataFrame([("masc nom/voc/acc sg (attic epic)",), ("doric",), (None,)], "p string")
    found = [r[0] for r in df.select(G.parsed_reading(F.col("p"))).collect()]
    assert found == [{"case": ["acc", "nom", "voc"], "gender": ["masc"], "number": ["sg"]}, {}, {}]
    words = spark.createDataFrame([("λόγος",), ("λογός",), ("Λόγος",), ("λόγον",), (None,)], "w string")
    match = lambda *t: [r[0] for r in words.select(G.accent_matches(F.col("w"), list(t))).collect()]
    assert match("λόγος") == [True, False, True, False, False]
    assert match("*λόγ*") == [True, False, True, True, False]
    assert match("λόγο?", "x") == [True, False, True, True, False]


def test_hyphens_and_glosses(spark):
    from corvane.operators import repair as T

    docs = spark.createDataFrame([(1, "an exam-\nple of well-\nknown and Aris-\ntotle and qq-\nrr"), (2, "plain"), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in "example well known aristotle".split()], "word string")
    told = T.hyphen_decisions(docs, words)
    assert [(r.first, r.action) for r in told.orderBy("i").collect()] == [("exam", "joined"), ("well", "hyphen"), ("Aris", "review"), ("qq", "review")]
    done = {r.doc_id: r.text for r in T.dehyphenated(docs, told).collect()}
    assert done == {1: 'an example of well-known and [REVIEW: "Aristotle" or "Aris-totle"?] and [REVIEW: "qqrr" or "qq-rr"?]', 2: "plain", 3: None}
    assert T.short_definition("<e><sense>x <i>have</i>, <i>hold</i> or <i>keep;</i> of <i>things</i></sense></e>") == "have, hold or keep"
    assert T.short_definition("<e><i>of or belonging to a</i> z</e>") == "" and T.short_definition("<e>none</e>") == "" and T.short_definition(None) == ""
    glosses = spark.createDataFrame([("a", "somewhat"), ("b", "have,"), ("c", "have")], "lemma string, gloss string")
    keys = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b"), ("b", "b1"), ("c", "c1")], "lemma string, key string")
    defs = spark.createDataFrame([("a1", "somewhat deficient"), ("a2", "somewhat fearful"), ("b", "have or hold"), ("b1", "have not"), ("c1", "haven")], "key string, definition string")
    found = {r.lemma: r.extended for r in T.extended_glosses(glosses, keys, defs).collect()}
    assert found == {"a": "somewhat", "b": "have or hold", "c": "have"}


def test_plans_and_tolerance(spark):
    from corvane.operators import lookup as L

    options = {"to": ["o", "os"], "ti": ["tis"], "hn": []}
    assert L.browse_plan("to ti hn", options) == ({"o": ["o tis hn", "os tis hn"]}, 0)
    assert L.browse_plan("to ti hn", None) == ({"t": ["to ti hn"]}, 0)
    assert L.browse_plan("t", {"t": ["x"]}) == ({"t": ["t"]}, 0) and L.browse_plan("", options) == ({}, 0)
    assert L.browse_plan("to to", options, cap=3) == ({"o": ["o o", "o os", "os o"]}, 4)
    assert L.headword_options(spark.createDataFrame([("a",)], "word string"), None).first().options is None
    assert L.tolerant([1, 0, 2], lambda x: 2 // x) == ({1: 2, 2: 1}, {0: "integer division or modulo by zero"})
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (1, "")], "seg long, t string")
    lines = spark.createDataFrame([(1, 1, ["a", "b", "c"]), (1, 3, ["d", "e"]), (1, 4, [])], "seg long, n int, words array<string>")
    starts = spark.createDataFrame([(1, "I", 1, 1), (1, "II", 2, 1), (1, "III", 9, 0)], "seg long, chapter string, line int, word int")
    found = sorted((r.block, r.chapter or "", r.n, r.words, r.cont) for r in L.page_blocks(lines, starts).collect())
    assert found == [(0, "", 1, ["a"], False), (1, "I", 1, ["b", "c"], True), (2, "II", 3, ["d", "e"], False), (2, "II", 4, [], False)]
    assert docs.count() == 3
