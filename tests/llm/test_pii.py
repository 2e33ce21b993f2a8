from __future__ import annotations

import hashlib
import random
import re

import pytest

from corvane.llm import pii as P
from tests.llm import odd

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return sorted(out)


def case(rng: random.Random) -> str:
    parts = ["a@b.c", "x.y+z@host-1.example.com", "a@b", "@", ".", "c@d.e_f@g.h", "1.2.3.4", "256.1.1.1", "0255.1.1.01", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "4222222222222", "123456789012345678901234", "+1 (234) 567-8901", "+44 20.7946", "+1", "+12 34 ", "é", "😀", "漢", " ", "\n", "-", "word", "12", "0", "00 ", "call", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "password=abcdef0123456789", 'token = "24be64439e3e49cf46b2"']
    return "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randint(0, 25)))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", *[case(rng) for _ in range(400)], "a@b.c " * 700, "9" * 30000, "1.2.3.4 " * 500 + "x@" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in P.pii_report(df).collect():
        want = brute(texts[r.doc_id])
        names = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in P.BASE] == names


def test_the_method_adds_checked_spans(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "iban GB82 WEST 1234 5698 7654 33."), (3, "my password=abcdef0123456789 ok"), (4, "mail a@b.co")]
    found = {r.doc_id: (r.spans, r.top_score) for r in P.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1][0] == "iban:5:32"
    assert found[2][0] == ""
    assert found[3][0].startswith("secret:3:")
    assert found[4] == ("email:5:11", pytest.approx(0.8))


@pytest.mark.parametrize("behind", [" Please pay", " BIC COBADEFFXXX", " 2024", " 2024 AB 12", " A", " P.", "\n", ", X", " DE89 3704 0044 0532 0130 00"])
def test_ibans_before_words_and_digits(spark, behind):
    texts = [f"é iban {own}{behind}" for own in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947 NO9386011117947")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in P.pii_report(df).collect()}
    assert found[0][0] == "iban:7:29" and found[1][0] == "iban:7:34" and found[2][:2] == ["iban:7:22", "iban:23:38"]
    assert [len(found[i]) for i in range(3)] == ([2, 2, 3] if "DE" in behind and "BIC" not in behind else [1, 1, 2])
    assert {r.text[:14] for r in P.redact(df).collect()} == {"é iban [IBAN]" + behind[:1], "é iban [IBAN] "}


def test_context_raises_the_score(spark):
    rows = [(1, "call +1 234 567 8901"), (2, "so +1 234 567 8901")]
    found = {r.doc_id: r.top_score for r in P.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] > found[2]


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "é a@b.co and +1 234 567 8901!", 30), (2, None, None), (3, "clean", 99), (3, "clean", 99)]
    done = P.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert done.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(tuple, done.collect()), key=str) == sorted(
        [(1, "é [EMAIL] and [PHONE]!", 22), (2, None, None), (3, "clean", 99), (3, "clean", 99)], key=str
    )


def plainly_redacted(text: str, spans: str) -> str:
    """The spans' places replaced one by one, from the last group on."""
    groups: list[list] = []
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], P.KINDS.index(x[0]))):
        if groups and start < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], end)
        else:
            groups.append([kind, start, end])
    for kind, start, end in reversed(groups):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def test_redaction_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["", *[case(rng) for _ in range(200)], "é" * 3000 + " a@b.c" + "漢" * 5000 + " 4111 1111 1111 1111 +44 20 7946 0000", "9" * 9000, "1.2.3.4, a@b.c " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in P.pii_report(df).collect()}
    for r in P.redact(df).collect():
        assert r.text == plainly_redacted(texts[r.doc_id], found[r.doc_id])


def test_many_matches_take_linear_time(spark):
    import time

    times = []
    for n in (4_000, 32_000):
        df = spark.createDataFrame([(1, "é some words call a@b.co now " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert P.redact(df).first().text == "é some words call [EMAIL] now " * n
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * max(times[0], 0.5), times


def test_odd_documents(spark):
    assert P.pii_report(odd.frame(spark)).count() == 120
    assert P.pii_report(odd.empty(spark)).count() == 0
