r"""Token ids of whole texts by the tokenizers library, with a cache of units.

The library spends about 3 microseconds a token. Both vocabularies split a text into
units that are encoded apart from each other, so a worker keeps the ids of units it has
seen and gives only new ones to the library. What makes the units exact:

* byte_bpe: the pattern never joins characters across a border between a character that
  is no white space and white space that follows it. Texts whose only white space is
  single spaces and single line feeds between words are cut at these; every other text
  goes to the library as a whole.
* word_bpe: white space is dropped before the pairs are merged, so no token holds two
  words; texts are cut at spaces and line feeds.
* a run of punctuation behind a letter is a token border of its own in both patterns
  (the apostrophe of contractions excepted, which is not cut).
* a word of letters alone (of the Latin blocks, where lower case and composition change
  no border) is one unit of the pattern, so the library's merge model gets it directly, its
  bytes written as the vocabulary's characters.

The cache holds at most CACHE units of at most UNIT characters, which bounds a worker's
memory: half of it is the units used since that half was last begun, half those before; a
unit that was used in neither is forgotten. A text that holds the string of one of the
vocabulary's added tokens goes to the library as a whole, which gives that token's id.
"""

from __future__ import annotations

import os
import re
import threading
import zlib

CACHE = 600_000
UNIT = 40

_PUNCT = ".,!?;:)]}%&*#$|"
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def _plainly_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between words."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not _OTHER_SPACE.search(text)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _added(made) -> list[str] | None:
    """The strings of the added tokens; None if some are looked for in another form than the text's."""
    tokens = made.get_added_tokens_decoder().values()
    return None if any(t.normalized for t in tokens) else [t.content for t in tokens]


def _packed(ids: list[int]) -> bytes:
    import array

    out = array.array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("ids need 4 bytes")
    if os.sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in both vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Units(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, made, encode, prefix: str, lower: bool):
        super().__init__()
        self.merge, self.encode, self.prefix, self.lower = made.model.tokenize, encode, prefix, lower
        self.tails: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.characters = _byte_characters()

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None and unit:
            core = unit.rstrip(_PUNCT)
            if core and core != unit and core[-1] < "İ" and core[-1].isalpha():
                tail = unit[len(core) :]
                last = self.tails.get(tail)
                if last is None:
                    last = self.encode(tail)
                    if len(self.tails) < 10_000:
                        self.tails[tail] = last
                ids = self[core] + last
            elif max(unit) < "İ" and unit.isalpha():
                word = self.prefix + (unit.lower() if self.lower else unit)
                written = word.encode().decode("latin-1").translate(self.characters)
                ids = _packed([t.id for t in self.merge(written)])
        if ids is None:
            ids = self.encode(self.prefix + unit) if unit or self.prefix else b""
        if len(unit) <= UNIT:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class _Vocabulary:
    """A vocabulary's library encoder: ids of a text, packed."""

    def __init__(self, path: str):
        self.made = _tokenizer(path)
        self.added = _added(self.made)

    def whole(self, text: str) -> bytes:
        return _packed(self.made.encode(text, add_special_tokens=False).ids)

    def packed(self, text: str) -> bytes:
        if self.added is None or any(a in text for a in self.added):
            return self.whole(text)
        return self.by_units(text)


class ByteBpe(_Vocabulary):
    """byte_bpe: ids of a text, packed."""

    def __init__(self, path: str):
        super().__init__(path)
        self.first = _Units(self.made, self.whole, "", False)
        self.later = _Units(self.made, self.whole, " ", False)
        self.feed = self.whole("\n")

    def by_units(self, text: str) -> bytes:
        if not text:
            return b""
        if not _plainly_spaced(text):
            return self.whole(text)
        out: list[bytes] = []
        first, later = self.first, self.later.__getitem__
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.feed)
            head, *rest = line.split(" ")
            out.append(first[head])
            out += map(later, rest)
        return b"".join(out)


class WordBpe(_Vocabulary):
    """word_bpe: ids of a text, packed."""

    def __init__(self, path: str):
        super().__init__(path)
        self.units = _Units(self.made, self.whole, "", True)

    def by_units(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))


_made: dict[tuple[str, str], ByteBpe | WordBpe] = {}
_lock = threading.Lock()


def encoder(kind: str, path: str):
    """The worker's encoder of a vocabulary file: kind is byte_bpe or word_bpe."""
    with _lock:
        key = (kind, path)
        if key not in _made:
            _made[key] = {"byte_bpe": ByteBpe, "word_bpe": WordBpe}[kind](path)
        return _made[key]


def crc32(packed: bytes) -> int:
    return zlib.crc32(packed) & 0xFFFFFFFF
