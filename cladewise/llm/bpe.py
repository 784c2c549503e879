"""Operator 4: exact byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick
from .pieces import CACHE, Splitter, byte_letters

ENDING = "</w>"
#: A letter at the end of a word is another symbol; it stands so much higher.
SHIFT = 0x1000
#: Bytes of results that are sent at once.
SENT = 8 << 20


class Encoder:
    """Ids of texts for a tokenizer file of the tokenizers library, and texts of ids.

    A vocabulary automaton gives, at each place of a piece, the tokens that end there
    (its suffix links lead from each to the next shorter one). Of the tokens that end a
    prefix just one ends the prefix's encoding: the one that leaves a pair as it is when
    merged together with the last token of what stands before it. That token is stored
    for each prefix, and the ids are read off from the back.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.splitter = Splitter(path)
        self.words = self.splitter.words
        vocab = self.splitter.model["vocab"]
        self.symbols = {t: self.spelled(t) for t in vocab}
        self.ids = {s: vocab[t] for t, s in self.symbols.items()}
        singles = {*byte_letters()} | ({chr(ord(c) + SHIFT) for c in byte_letters()} if self.words else set())
        if not singles <= self.ids.keys():
            raise ValueError("the vocabulary lacks a byte")
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.splitter.special.items()}
        self.ranks = {(self.spelled(a), self.spelled(b)): k for k, (a, b) in enumerate(self.splitter.model["merges"])}
        self.automaton = ahocorasick.Automaton()
        for s in self.ids:
            if self.merged(s) == [s]:  # others never come out of merging
                self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.plain = self.splitter.tokenizer.decoder is None
        self.bytes = {c: b for b, c in enumerate(byte_letters())}

    def spelled(self, token: str) -> str:
        """A token as symbols, one character each."""
        if self.words and token.endswith(ENDING) and len(token) > len(ENDING):
            token = token[: -len(ENDING)]
            return token[:-1] + chr(ord(token[-1]) + SHIFT)
        return token

    def merged(self, symbols: str) -> list[str]:
        """What plain merging makes of a short run of symbols: lowest rank first, from the left."""
        parts = [*symbols]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens next to each other stay as they are."""
        pair = left, right
        if (fit := self.fits.get(pair)) is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            fit = self.fits[pair] = self.merged(left + right) == [left, right]
        return fit

    def tokens(self, symbols: str) -> list[str]:
        """The tokens of a piece."""
        last: list[str] = [""] * (len(symbols) + 1)
        done = 0
        for end, token in self.automaton.iter(symbols):
            end += 1
            if done == end:
                continue
            before = end - len(token)
            if not before or (last[before] and self.compatible(last[before], token)):
                last[end], done = token, end
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def piece(self, piece: str) -> bytes:
        letters = self.splitter.letters(piece)
        if self.words:
            letters = letters[:-1] + chr(ord(letters[-1]) + SHIFT)
        out = np.array([self.ids[t] for t in self.tokens(letters)], "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; special strings in the text are their own ids."""
        out = []
        for special, pieces in self.splitter.segments(text):
            if special:
                out.append(np.array([self.splitter.special[special]], "<u4").tobytes())
                continue
            found = [*map(self.known.get, pieces)]
            if None in found:
                found = [self.piece(p) if x is None else x for p, x in zip(pieces, found)]
            out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special ones included: tokens with a space between, or their bytes where the file has a byte decoder."""
        names = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.plain:
            return " ".join(names)
        out = bytearray()
        for name in names:
            out += bytes(self.bytes[c] for c in name) if all(c in self.bytes for c in name) else name.encode()
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def kept(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row's whole text: ids as little-endian 32-bit integers in a binary, decoded from them.

    One narrow pass. A null text counts as empty: no ids and an empty text. Null ids
    and repeated rows are kept row by row; an empty table gives no rows; other columns
    are left out. Long pieces without white space take time in proportion to their length.
    """
    rows = pick(docs, id_column, text_column)
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        encoder = kept(path)
        for batch in batches:
            ids, texts, begin, size = [], [], 0, 0
            for i, value in enumerate(batch.column(1)):
                ids.append(encoder.encode(value.as_py() or ""))
                texts.append(encoder.decode(ids[-1]))
                size += len(ids[-1]) + len(texts[-1])
                if size > SENT or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(ids)), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], schema.names)
                    ids, texts, begin, size = [], [], i + 1, 0

    return rows.mapInArrow(run, schema)
