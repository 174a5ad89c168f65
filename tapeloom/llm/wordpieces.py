"""Splitting of texts into the pieces that the word BPE vocabulary encodes one by one.

The rules are those of the tokenizer file: added tokens are cut out of the raw text first; the rest is
brought into NFC and lower case; white space is dropped; pieces are contractions, runs of letters, single
numerals and runs of other marks. Texts within Latin-1 take a plain regular expression (there NFC changes
nothing and lower case maps one character to one); all others take the library's own normaliser
and splitter.
"""

from __future__ import annotations

import json
import re

import tokenizers


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMERALS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMERALS}]+")


def tokenizer_text(path: str) -> str:
    """The tokenizer file; the driver reads it and broadcasts it (some megabytes), so executors need no file of that path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class PieceSplitter:
    def __init__(self, text: str):
        self.spec = json.loads(text)
        self.library = tokenizers.Tokenizer.from_str(text)
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}

    def printable(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([self.alphabet[b] for b in piece.encode()])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _PIECES.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text)
            found = self.library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes([self.byte_of[c] for c in p]).decode(errors="surrogateescape") for p, _ in found]
        return _PIECES.findall(text.lower())

    def split(self, text: str) -> list[str]:
        """Pieces in order; an added token is a piece of its own (no other piece can look like one)."""
        if "<|" not in text or not self.cut.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out
