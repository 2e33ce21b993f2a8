"""Greek tokens, morphological readings and accent-sensitive terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import accent_norm

# Punctuation that is stripped from a token's edges, editorial sigla that are also dropped inside it.
PUNCTUATION = ".,·;—()|\"‘«»·;"
SIGLA = "†*<>[]⎪⟦⟧⌜⌞⌝⌟"
# The values of each category of a morphological reading.
FEATURES = {
    "gender": "masc fem neut masc/fem masc/neut masc/fem/neut",
    "case": "nom gen dat acc voc nom/acc nom/voc nom/voc/acc gen/dat",
    "number": "sg pl dual",
    "person": "1st 2nd 3rd",
    "tense": "pres imperf fut aor perf plup futperf",
    "mood": "ind subj opt imperat inf part",
    "voice": "act mid pass mp",
    "degree": "comp superl irreg_comp",
    "marker": "adverb adverbial particle prep conj interrog exclam indecl numeral letter",
}
_RAW = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}—]+"


def greek_tokens(line: Column) -> Column:
    """The tokens of a line: array of (t: the token, o: where its raw form starts, sigla: whether it had any).

    Raw tokens are runs without white space and em-dashes; punctuation and sigla go from their edges,
    sigla from inside; an apostrophe of elision stays. What is empty then is no token.
    """
    line = F.coalesce(line, F.lit(""))
    start = F.struct(F.array().cast("array<struct<raw:string,o:int>>").alias("out"), F.lit(0).alias("at"))
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(_RAW), F.lit(0)).alias("raw"), F.split(line, _RAW, -1).alias("gap"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        found = F.array(F.struct(x["raw"].alias("raw"), at.alias("o")))
        out = F.when(x["raw"].isNull(), s["out"]).otherwise(F.concat(s["out"], found))
        return F.struct(out.alias("out"), (at + F.coalesce(F.length(x["raw"]), F.lit(0))).alias("at"))

    placed = F.aggregate(pairs, start, step, lambda s: s["out"])
    cleaned = F.transform(
        placed,
        lambda x: F.struct(clean_token(x["raw"]).alias("t"), x["o"].alias("o"), has_sigla(x["raw"]).alias("sigla")),
    )
    return F.filter(cleaned, lambda x: x["t"] != "")


def clean_token(raw: Column) -> Column:
    return F.translate(F.btrim(raw, F.lit(PUNCTUATION + SIGLA)), SIGLA, "")


def has_sigla(raw: Column) -> Column:
    return F.translate(raw, SIGLA, "") != raw


def parsed_reading(parse: Column) -> Column:
    """A parse string as a map of categories to sorted values; words of no category are left out.

    A word of several values, as nom/voc, has each of them. The map is empty if nothing is known.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(parse, F.lit("")), r"[()\s]+", " ")), " ")
    cells = []
    for category in sorted(FEATURES):
        known = F.array(*[F.lit(v) for v in FEATURES[category].split()])
        hits = F.array_intersect(words, known)
        values = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda w: F.split(w, "/")))))
        cells.append(F.struct(F.lit(category).alias("c"), values.alias("v")))
    return F.map_from_entries(F.filter(F.array(*cells), lambda x: F.size(x["v"]) > 0))


def reading_text(reading: Column) -> Column:
    """A reading as text: case=acc,nom;number=sg."""
    return F.array_join(F.transform(F.map_entries(reading), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))), ";")


def signature(parses: Column) -> Column:
    """The distinct readings of a token's parses as sorted texts; without those that say nothing."""
    texts = F.transform(parses, lambda p: reading_text(parsed_reading(p)))
    return F.array_sort(F.array_distinct(F.filter(texts, lambda t: t != "")))


def accent_term(term: str) -> str:
    """An anchored pattern for a term with its accents: * any characters, ? one; a leading * marks a capital and goes."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(c, re.escape(c)) for c in accent_norm(term.lstrip("*"))) + "$"


def accent_matches(token: Column, terms: list[str]) -> Column:
    """Whether a surface token matches one of the terms with exactly its accents."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        tried = [re.compile(accent_term(t), re.S) for t in terms]
        return values.map(lambda v: v is not None and any(p.match(accent_norm(v)) for p in tried))

    return run(token)
