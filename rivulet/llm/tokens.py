"""Token ids of texts, by the ``tokenizers`` library and a public vocabulary file.

Merges never cross the borders that the vocabulary's splitting pattern sets, so a text is cut at white space and each
distinct piece is encoded once; two generations of a bounded memo keep the frequent ones. Workers serve many partitions, so a memo that is kept saves work
in the next one; one that is forgotten leaves its memory to other stages.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Entries of a generation; an entry takes about 190 bytes.
WORD_MEMO, PIECE_MEMO = 400_000, 100_000
# The splitting patterns of the two public vocabularies.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Below U+0130 no character changes by NFC and lower-casing is the same everywhere.
_PLAIN = re.compile("[\x00-į]*")
#: White space for Python, but not for the patterns.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_ASCII_SPACES = "\t\x0b\x0c\r"
_OTHER_SPACES = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACED_PIECES = re.compile(r"\s*\S+|\s+$")
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_printable))}


def _any(chars: str, text: str) -> bool:
    """Whether any of the characters is in the text; a plain search for each is faster than a pattern."""
    return any(c in text for c in chars)


class Memo(dict):
    """make(key), remembered for the keys of the last generations."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers. Strings of special tokens are ordinary text."""

    def __init__(self, path: str, words: int = WORD_MEMO, pieces: int = PIECE_MEMO):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        split, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = split.get("pretokenizers") or [{}]
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and normal is None
        word_end = parts[0].get("pattern", {}).get("Regex") == WORD_END.pattern and [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.pieces = Memo(self._piece, pieces)
        self.words = Memo(self._spaced if byte_level else self._word, words)
        self.encode = self._encode_spaced if byte_level else self._encode_words if word_end else self._whole

    def forget(self) -> None:
        """Empties the memos; the vocabulary stays."""
        for memo in (self.words, self.pieces):
            memo.clear()
            memo.old = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _split(self, text: str, pattern: regex.Pattern) -> bytes:
        """text without white space, but for one leading space of a byte-level vocabulary."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return self._piece(text)  # a piece of its own is remembered as a word
        if body[:-1].isalpha() and body[-1] in ".,":
            known = self.words[body[:-1]] if len(body) < len(text) or pattern is WORD_END else self.pieces[text[:-1]]  # a space goes before byte-level words
            return known + self.pieces[body[-1]]
        if text.isascii() or _PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))
        return self._whole(text)

    def _spaced(self, part: str) -> bytes:
        """part with the white space before it; where that isn't a line end, a space is left out."""
        if part[:1] != "\n":
            return self._split(f" {part}", BYTE_LEVEL)
        return self.pieces["\n"] + self._split(part[1:], BYTE_LEVEL) if part[1:] and not part[1].isspace() else self._whole(part)

    def _encode_spaced(self, text: str) -> bytes:
        if _any(_SEPARATORS, text):
            return self._whole(text)
        parts = text.replace("\n", " \n").split(" ")
        if len(parts) == len(text.split()) and not _any(_ASCII_SPACES, text) and (text.isascii() or not _any(_OTHER_SPACES, text)):  # single spaces and line ends only, none at either end
            return self._split(parts[0], BYTE_LEVEL) + b"".join(map(self.words.__getitem__, parts[1:]))
        found = _SPACED_PIECES.findall(text)
        if not found:
            return b""
        rest = b"".join(self.words[x] if x[0] == "\n" else self.words[x[1:]] if x[0] == " " and x[1:2] != "\n" else self._whole(x) for x in found[1:])
        return self._whole(found[0]) + rest

    def _word(self, word: str) -> bytes:
        return self._split(word.lower(), WORD_END) if word.isascii() or _PLAIN.fullmatch(word) else self._whole(word)

    def _encode_words(self, text: str) -> bytes:
        if _any(_SEPARATORS, text):
            return self._whole(text)
        try:
            text.encode("latin-1")  # there the vocabulary's normal form is lower case, which saves words' variants
        except UnicodeEncodeError:
            return b"".join(map(self.words.__getitem__, text.split()))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@lru_cache(maxsize=4)
def encoder(path: str, words: int = WORD_MEMO, pieces: int = PIECE_MEMO) -> Encoder:
    return Encoder(path, words, pieces)
