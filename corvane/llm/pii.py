r"""Personal data: expressions propose spans, checksums confirm, context adjusts the score.

Everything here is a DataFrame expression: no Python runs on the executors, and no
row is shuffled. A pattern's matches come from `regexp_extract_all`, the text between
them from `split` with the same pattern; running sums of both lengths give the spans
in code points.

Base kinds (email, ip, card, phone) are leftmost and non-overlapping per kind, and a
match that its check refuses is dropped without a retry. The patterns are written so
that each run of characters is tried once, which finds the same matches as the plain
patterns and stays linear on very long texts:

* `(?<![0-9])` before the digits of an address, as no match can start inside a run
  that failed at its start; `\G` does the same for e-mail addresses, which may start
  right behind the address before;
* possessive repeats, which Java runs as loops instead of recursion.

The method adds spans of two further kinds to these: `iban` (confirmed by mod-97; upper-case
words or digits may follow it, so of all ends of words the last that passes counts) and
`secret` (a long key behind a word such as password or token). Each span has a score:
what its pattern is worth, more with a checksum, more if a context word of its kind
stands within CONTEXT characters before it. Added spans need KEEP_SCORE; base spans
stay whatever their score is.

Null or empty texts have no spans; repeated rows give repeated rows; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span that are searched for context words.
CONTEXT = 40
#: Least score of a span that the method adds to the base spans.
KEEP_SCORE = 0.6
#: Blocks of the two-level running sums and maxima.
BLOCK = 64
#: Code points of a piece of a text: what stands at a place is found in its piece, not from the text's start.
PIECE = 2048

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

#: The rest of an IBAN behind its first four characters, as long as it may be, up to the end of a word.
_IBAN_REST = r"(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?={_IBAN_REST})",
    "secret": r"(?<![A-Za-z0-9_])(?i:api[_-]?key|access[_-]?key|secret|password|passwd|token)[ ]{0,2}[=:][ ]{0,2}[\"']?[A-Za-z0-9+/_-]{12,}+",
}
#: A text without this cannot hold a match.
NEEDS = {"email": "@", "phone": "+"}
#: Score of a match by its pattern alone, and what a checksum adds.
WORTH = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "secret": 0.7}
CHECKED = {"card": 0.4, "iban": 0.4}
CONTEXT_ADDS = 0.15
CONTEXT_WORDS = {
    "email": "e-?mail|contact|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "secret": "key|secret|password|token|login",
}


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: inside a lambda, an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column, most: bool) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: F.greatest(s, x) if most else s + x)


def with_running(numbers: Column, body, most: bool = False) -> Column:
    """body(f), f(i) being the sum (or the largest) of the elements before i: by blocks, n * BLOCK steps and not n * n."""

    def blocked(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.size(own) / BLOCK).cast("int"))
        blocks = F.transform(places, lambda b: _total(F.slice(own, b * BLOCK + 1, F.lit(BLOCK)), most))
        return let(blocks, lambda bs: let(F.transform(bs, lambda _, b: _total(F.slice(bs, F.lit(1), b), most)), lambda before: summed(own, before)))

    def summed(own: Column, before: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            ahead, inside = F.get(before, block), _total(F.slice(own, block * BLOCK + 1, (i % BLOCK).cast("int")), most)
            return F.greatest(ahead, inside) if most else ahead + inside

        return body(at)

    return let(numbers, blocked)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in pieces, in time that its length bounds."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.substr(F.array_join(some, ""), start - first * PIECE + 1, end - start)


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
        rest = F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda s, c: F.when(c == "", s)
            .when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97)
            .otherwise((s * 100 + F.ascii(c) - 55) % 97),
        )
        return F.length(plain).between(15, 34) & (rest == 1)
    return F.lit(True)


def _whole_ibans(pieces: Column, heads: Column) -> Column:
    """The spans of IBANs that begin with these matches of the pattern; without those that none begins with, or in one before."""

    def whole(x: Column) -> Column:
        # 34 characters, as many spaces, and the character behind
        run = F.regexp_extract(part(pieces, x["start"], x["start"] + 69), "^[A-Z]{2}[0-9]{2}" + _IBAN_REST, 0)
        ends = lambda words: F.transform(
            F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
        )
        longest = F.get(F.filter(let(F.split(run, " "), ends), lambda m: _confirmed("iban", m)), F.lit(0))
        return let(longest, lambda m: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (x["start"] + F.length(m)).alias("end"), m.alias("m")))

    good = F.filter(F.transform(heads, whole), lambda x: x["m"].isNotNull())
    start = F.struct(F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(F.concat(s["out"], F.array(x)).alias("out"), x["end"].alias("at"))
    )
    return F.aggregate(good, start, step, lambda s: s["out"])


_NONE = "array<struct<start:int,kind:int,end:int,score:double>>"


def spans(text: Column, kind: str) -> Column:
    """All confirmed spans of a kind in a text: array of (start, kind's number, end, score)."""
    number = KINDS.index(kind)
    pattern = F.lit(PATTERNS[kind])
    split = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, PATTERNS[kind], -1).alias("gaps")
    )

    def place(x: Column) -> Column:
        # element i: the text before match i, and the match
        steps = F.transform(x["matches"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))

        def placed(before) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = before(i) + F.length(F.get(x["gaps"], i))
                return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m)).alias("end"), m.alias("m"))

            return F.transform(x["matches"], one)

        return with_running(steps, placed)

    def scored(pieces: Column) -> Column:
        placed = let(split, place)
        good = _whole_ibans(pieces, placed) if kind == "iban" else F.filter(placed, lambda x: _confirmed(kind, x["m"]))
        near = lambda x: part(pieces, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"])
        found = F.transform(
            good,
            lambda x: F.struct(
                x["start"].alias("start"),
                x["kind"].alias("kind"),
                x["end"].alias("end"),
                F.least(
                    F.lit(WORTH[kind] + CHECKED.get(kind, 0.0))
                    + F.when(F.rlike(near(x), F.lit(rf"(?i)\b(?:{CONTEXT_WORDS[kind]})\b")), CONTEXT_ADDS).otherwise(0.0),
                    F.lit(1.0),
                ).alias("score"),
            ),
        )
        return found if kind in BASE else F.filter(found, lambda x: x["score"] >= KEEP_SCORE)

    has = F.rlike(text, pattern) if kind not in NEEDS else F.contains(text, F.lit(NEEDS[kind])) & F.rlike(text, pattern)
    return F.when(has, let(pieces_of(text), scored)).otherwise(F.array().cast(_NONE))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and `found`: all spans by start, then kind, as (start, kind, end, score)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select("doc_id", text.alias("text"))
    each = each.select("doc_id", "text", *[spans(F.col("text"), k).alias(f"s_{k}") for k in KINDS])
    return each.select(
        "doc_id",
        "text",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.concat(*[F.col(f"s_{k}") for k in BASE])).alias("base"),
        F.array_sort(F.concat(*[F.col(f"s_{k}") for k in KINDS])).alias("found"),
    )


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of each document's spans; see the module."""
    return find_pii(docs).select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows the text.

    Overlapping spans become one, named by the first. Texts without spans, null ones
    too, and all other columns stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    own = docs.withColumn("__text", text).withColumn(
        "__found", F.array_sort(F.concat(*[spans(F.col("__text"), k) for k in KINDS]))
    )
    found, length = F.col("__found"), F.length("__text")

    def written(pieces: Column) -> Column:
        def joined(before) -> Column:
            """before(i): where the spans before i end; a span that starts there or later begins a group."""
            each = F.transform(found, lambda x, i: F.struct(before(i).alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
            groups = F.filter(each, lambda y: y["start"] >= y["at"])
            kept = F.transform(groups, lambda y: F.concat(part(pieces, y["at"], y["start"]), F.get(names, y["kind"])))
            return F.concat(F.array_join(kept, ""), part(pieces, before(F.size(found)), length))

        return with_running(F.transform(found, lambda x: x["end"]), joined, most=True)

    done = let(pieces_of(F.col("__text")), written)
    own = own.withColumn("text", F.when(F.size("__found") > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])
