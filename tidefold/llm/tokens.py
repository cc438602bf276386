"""Token ids by the tokenizers library, with the merges of each piece of text done once.

Byte-pair merges never cross the boundaries of the pre-tokenizer. Both
vocabularies used here have a boundary before a blank that a non-blank
follows, so a text is cut at its blanks, each piece is looked up in a bounded
cache, and only new pieces go through the library's model. Where the cut could
differ from the library's own (other white space beside a blank), or a piece
has characters beyond Latin letters and ASCII, the library encodes the whole;
so it does with a text that holds the literal of an added token, such as
``<|endoftext|>``, which the library takes for that token. A very long text is
taken part by part. ``tests/llm`` holds all this against ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

CACHE_WORDS, CACHE_PARTS, LONG = 700_000, 100_000, 1 << 20

#: What the fast path splits; the same alternatives as the vocabularies' own patterns, on ASCII and Latin letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ž"  # without U+0130, whose lower case is two characters
_SAFE = re.compile(f"[\t\n\r\x20-\x7e{_LATIN}]*")
_LETTERS = re.compile(f"[{_LATIN}]+")
_CLOSERS = (".", ",")
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Cache(dict):
    """Ids of units; a unit that is missing is encoded, so that a lookup never leaves the interpreter's own loop for known ones."""

    def __init__(self, new):
        super().__init__()
        self.new = new

    def __missing__(self, unit: str) -> bytes:
        return self.new(unit)


class CachedEncoder:
    """Encodes texts to little-endian id arrays, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``lower`` says that the vocabulary lower-cases and drops white space.
    """

    def __init__(self, path: str, lower: bool, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Literals of added tokens; one that is looked for in the normalized text may be in any.
        self.added = ["" if t.normalized else t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError("the vocabulary does not fit the id type")
        self.merge = self.tokenizer.model.tokenize
        self.lower, self.code = lower, {"<u2": "H", "<u4": "I"}[dtype]
        table = byte_alphabet()
        letters = [chr(c) for c in range(0x180) if _SAFE.fullmatch(chr(c))]
        self.alphabet = {ord(c): "".join(table[b] for b in c.encode()) for c in letters}
        self.lead = "" if lower else " "
        self.mark = self.lead.translate(self.alphabet)
        self.pieces = _WORD_PIECES if lower else _BYTE_PIECES
        self.forget()
        self.closers = {c: self.whole(c) for c in _CLOSERS}

    def forget(self) -> None:
        """Empties the caches, which grow with the units seen."""
        self.cache, self.older, self.parts = _Cache(self._new), {}, {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, unit: str) -> bytes:
        """The ids of a unit after a blank, kept; the older half of a full cache goes."""
        if (out := self.older.get(unit)) is None:
            if unit.isalpha() and (unit.isascii() or _LETTERS.fullmatch(unit)):
                if self.lower and (low := unit.lower()) != unit:
                    return self.cache[low]
                out = self.merged(self.mark + (unit if unit.isascii() else unit.translate(self.alphabet)))
            elif unit[-1:] in _CLOSERS and unit[-2:-1].isalpha():  # a boundary of both vocabularies
                out = self.cache[unit[:-1]] + self.closers[unit[-1]]
            else:
                out = self.piece(self.lead + unit)
                if "\n" in unit or len(unit) > 40:  # seldom seen again; its words are kept
                    return out
        cache = self.cache
        if len(cache) >= CACHE_WORDS // 2:
            self.older = dict(cache)
            cache.clear()
        if len(unit) < 64:
            cache[unit] = out
        return out

    def merged(self, piece: str) -> bytes:
        """The ids of a piece in the letters that stand for its bytes."""
        return array(self.code, [t.id for t in self.merge(piece)]).tobytes()

    def part(self, piece: str) -> bytes:
        """The ids of one piece between boundaries; those of a word come from the cache of units where it has them."""
        word = piece[1:] if self.lead and piece[0] == " " else piece if self.lower else ""
        if word.isalpha():
            return self.cache[word]
        if (out := self.parts.get(piece)) is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            out = self.merged(piece.translate(self.alphabet))
            if len(piece) < 64:
                self.parts[piece] = out
        return out

    def piece(self, unit: str) -> bytes:
        if not _SAFE.fullmatch(unit):
            return self.whole(unit)
        return b"".join(map(self.part, self.pieces.findall(unit.lower() if self.lower else unit)))

    def encode(self, text: str) -> bytes:
        return self._encode(text) if len(text) <= LONG else b"".join(self.parts_of(text))

    def parts_of(self, text: str) -> Iterator[bytes]:
        """The ids of a text in parts of about ``LONG`` characters, cut at blanks between two letters, where both vocabularies have a boundary."""
        at = 0
        while m := _CUT.search(text, at + LONG):
            yield self._encode(text[at : m.start()])
            at = m.start()
        yield self._encode(text[at:])

    def _encode(self, text: str) -> bytes:
        for literal in self.added:
            if literal in text:
                return self.whole(text)
        if (_ODD if self.lower else _RUNS).search(text):
            return self.whole(text)
        units = text.split(" ")
        return self.piece(units.pop(0)) + b"".join(map(self.cache.__getitem__, units))


#: Separators that Python or the patterns may class differently, and marks that compose with a character before them.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0300-\u036f\u2028\u2029]")
#: A blank followed by white space or by the end: there the cut before the blank may be no boundary.
_RUNS = re.compile(r" (?:\s|$)")
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

_ENCODERS: dict[tuple[str, bool], CachedEncoder] = {}


def encoder(name: str, lower: bool, folder: str | None = None) -> CachedEncoder:
    """One encoder for each Python worker. ``folder`` overrides where the vocabulary files are."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = f"{folder}/{name}"
    if (path, lower) not in _ENCODERS:
        _ENCODERS[path, lower] = CachedEncoder(path, lower)
    return _ENCODERS[path, lower]
