"""Splits texts into the pieces that a tokenizer file's model merges, as the tokenizers library does."""

from __future__ import annotations

import json
import re

import regex

#: The two splitting patterns and the code points where every Unicode version in use agrees.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SURE = ((0x0, 0x557), (0x900, 0xC5B), (0xD00, 0x208E), (0x20A0, 0xA7CD), (0xAC00, 0xFFFF), (0x1F000, 0x1FAFF), (0x20000, 0x2B739))
UNSURE = "[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SURE) + "]"

#: Up to U+024F the classes are short: letters, numbers and white space. The standard library's patterns over them are three times as fast.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPACES = "\\t-\\r \\x85\\xa0"
LATIN = "[^\\x00-\\u024f]"
LATIN_BYTE = f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
LATIN_WORD = f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"

#: Entries of a worker's cache of pieces; a full cache is emptied, so its memory is bounded.
CACHE = 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next free one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else free))
        free += b not in shown
    return letters


class Splitter:
    """The pieces of texts for one tokenizer file; special strings are pieces of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.model = told["model"]
        self.tokenizer = Tokenizer.from_file(path)
        added = told["added_tokens"]
        if odd := [x["content"] for x in added if any(x.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]:
            raise ValueError(f"{path}: added tokens {odd} take in more or less than their own text, which is not supported")
        self.special = {x["content"]: x["id"] for x in added}
        self.words = self.model.get("end_of_word_suffix") == "</w>"
        self._pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._unsure = regex.compile(UNSURE)
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        self._normal = self.tokenizer.normalizer
        self._beyond = re.compile(LATIN).search
        self._latin = re.compile(LATIN_WORD if self.words else LATIN_BYTE).findall

    def letters(self, piece: str) -> str:
        """The bytes of a piece as the vocabulary spells them."""
        return piece.encode().decode("latin-1").translate(self._letters)

    def _ordinary(self, text: str) -> list[str]:
        if not self._beyond(text):
            # composed already; white space splits words and goes; only case is left to normalise
            lower = text if self._normal is None else text.lower()
            if lower is text or not self._beyond(lower):
                return self._latin(lower)
        if self._normal is not None:
            text = self._normal.normalize_str(text)
        if self._unsure.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._pattern.findall(text)

    def segments(self, text: str):
        """(special string or None, pieces) in the text's order."""
        for k, part in enumerate(self._special.split(text) if any(map(text.__contains__, self.special)) else [text]):
            if k % 2:
                yield part, []
            elif part:
                yield None, self._ordinary(part)
