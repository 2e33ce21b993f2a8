"""Text functions: tokenisers and folds as column expressions.

Everything that Spark's built-ins can say is a Column; only canonical decomposition (NFD),
which no built-in does, is a vectorised function over Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The transliteration of the Greek alphabet, its diacritics, elision marks.
GREEK_LETTERS = dict(zip("αβγδεζηθικλμνξοπρστυφχψωςϝ", "abgdezhqiklmncoprstufxywsv", strict=True))
GREEK_MARKS = {
    "̓": ")",
    "̔": "(",
    "́": "/",
    "̀": "\\",
    "͂": "=",
    "ͅ": "|",
    "̈": "+",
}
ELISION_MARKS = "'’ʼ᾽̓᾿"
LIGATURES = {"æ": "ae", "œ": "oe", "ﬁ": "fi", "ﬂ": "fl"}


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "’ʼ", "''")


def english_words(text: Column) -> Column:
    """Words of a-z and apostrophes, edge apostrophes stripped, empty ones dropped before they get a position."""
    plain = F.lower(straight_quotes(F.coalesce(text, F.lit(""))))
    raw = F.regexp_extract_all(plain, F.lit("[a-z']+"), F.lit(0))
    bare = F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")
    # most texts have no apostrophe, and nothing to strip
    return F.when(F.contains(plain, F.lit("'")), bare).otherwise(raw)


def spaced_words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences with their end marks, trimmed; empty ones are dropped."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: s != "")


def fold_lemma(lemma: Column) -> Column:
    """Lower case, letters a-z and apostrophe only."""
    return F.regexp_replace(F.lower(lemma), "[^a-z']", "")


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as single hyphens, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shard_letter(text: Column) -> Column:
    """The first letter if it is one of a-z, else an underscore."""
    first = F.substring(F.lower(text), 1, 1)
    return F.when(first.rlike("^[a-z]$"), first).otherwise("_")


def initials_shard(text: Column) -> Column:
    """The first alphabetic character anywhere, else an underscore."""
    found = F.regexp_extract(F.lower(text), r"(\p{L})", 1)
    return F.when(found != "", found).otherwise("_")


def wildcard_regex(term: str) -> str | None:
    """An anchored pattern for a term with * (any letters) and ? (one letter); None if nothing is left.

    Leading asterisks mark a capital and are stripped first.
    """
    bare = term.lstrip("*")
    if not bare:
        return None
    import re

    parts = {"*": "[a-z']*", "?": "[a-z']"}
    return "^" + "".join(parts.get(c, re.escape(c)) for c in bare) + "$"


def matches_term(word: Column, term: str) -> Column:
    """Whether a word matches a term: exact, by prefix (a single trailing *), or by pattern."""
    bare = term.lstrip("*")
    if not bare:
        return F.lit(False)
    if "*" not in bare and "?" not in bare:
        return word == bare
    if bare.index("*" if "*" in bare else "?") == len(bare) - 1 and bare.endswith("*"):
        return word.startswith(bare[:-1])
    return word.rlike(wildcard_regex(term))


def phrase_regex(words: list[str]) -> str:
    """Whole words in a row, whatever is between them that is no letter; a leading * opens the left edge."""
    import re

    left = "" if words[0].startswith("*") else r"(?<![a-z'])"
    body = r"[^a-z']+".join(re.escape(w.strip("*")).replace(r"\?", "[a-z']") + ("[a-z']*" if w.endswith("*") else "") for w in words)
    return f"{left}{body}(?![a-z'])"


# ---- folds that need decomposition -------------------------------------------------


def greek_key(word: str) -> str:
    """ASCII key of a Greek word: letters, then its marks in order; a grave accent counts as acute; one accent is kept."""
    out: list[str] = []
    accents = 0
    for c in unicodedata.normalize("NFD", word):
        low = c.lower()
        if low in GREEK_LETTERS:
            if c != low:
                out.append("*")
            out.append(GREEK_LETTERS[low])
        elif c in GREEK_MARKS:
            mark = "/" if GREEK_MARKS[c] == "\\" else GREEK_MARKS[c]
            if mark in "/=":
                accents += 1
                if accents > 1:
                    continue
            out.append(mark)
        elif c in ELISION_MARKS:
            out.append("'")
        else:
            raise ValueError(f"no key for {c!r}")
    return "".join(out)


def greek_fold(word: str) -> str:
    """Letters only: Greek ones transliterated, Latin ones kept, marks dropped, apostrophes straight."""
    out = []
    for c in unicodedata.normalize("NFD", word or "").lower():
        if c in GREEK_LETTERS:
            out.append(GREEK_LETTERS[c])
        elif "a" <= c <= "z" or c == "'":
            out.append(c)
        elif c in "’ʼ᾽":
            out.append("'")
    return "".join(out)


def latin_fold(word: str) -> str:
    """Ligatures expanded, marks dropped, v as u and j as i, other characters dropped."""
    text = (word or "").lower()
    for mark, plain in LIGATURES.items():
        text = text.replace(mark, plain)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if "a" <= c <= "z" or c == "'")
    return text.replace("v", "u").replace("j", "i")


def accent_norm(word: str) -> str:
    """Composed, lower case, final sigma as sigma; diacritics stay."""
    return unicodedata.normalize("NFC", word or "").lower().replace("ς", "σ")


def match_key(word: str) -> str:
    """Letters only, without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", word or "").lower() if c.isalpha())


def heading_norm(text: str) -> str:
    """Without marks, lower case, anything but Greek or Latin letters as single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if "a" <= c <= "z" or "α" <= c <= "ω" else " " for c in plain).split())


def straight_elision(word: str) -> str:
    """Any elision mark at the end as an apostrophe."""
    return word[:-1] + "'" if word and word[-1] in ELISION_MARKS else word


def capital_key(key: Column) -> Column:
    """The key of a capital: a star, then the marks of the first letter, then the letter."""
    return F.when(key.rlike("^[a-z]"), F.regexp_replace(key, r"^([a-z])([()/\\=|+]*)", r"*$2$1")).otherwise(F.concat(F.lit("*"), key))


def lookup_variants(key: Column, capitalized: Column | None = None) -> Column:
    """Keys to look up in order: the key, a diaeresis dropped or read as either breathing, then the capitals of all these."""
    read = F.array(key, *(F.replace(key, F.lit("+"), F.lit(mark)) for mark in ("", "(", ")")))
    found = F.when(F.contains(key, F.lit("+")), read).otherwise(F.array(key))
    return found if capitalized is None else F.when(capitalized, F.concat(found, F.transform(found, capital_key))).otherwise(found)


# fixed values: enclitics, and words that only end like one
ENCLITICS = ("que", "ne", "ve")
NO_ENCLITIC = ("atque", "neque", "itaque", "absque", "denique", "undique", "utique", "quoque", "namque", "plerumque", "ubique")


def latin_variants(word: Column) -> Column:
    """Keys of a Latin word in order: the whole word in lower case, what an enclitic leaves of it (two letters at least),
    and, of a word with a capital, the capitals of both."""
    key = F.lower(word)
    host = F.when(~key.isin(*NO_ENCLITIC), F.nullif(F.regexp_extract(key, f"^(.{{2,}})(?:{'|'.join(ENCLITICS)})$", 1), F.lit("")))
    plain = F.array_compact(F.array(key, host))
    first = F.substring(word, 1, 1)
    capitals = F.transform(plain, lambda k: F.concat(F.upper(F.substring(k, 1, 1)), F.substr(k, F.lit(2))))
    return F.when(word.isNull(), None).when(first != F.lower(first), F.concat(plain, capitals)).otherwise(plain)


def folded(fold, text: Column) -> Column:
    """A fold of this module as a vectorised column function."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fold(v))

    return run(text)
