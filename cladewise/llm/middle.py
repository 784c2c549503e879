"""Operator 11: fill-in-the-middle. Texts are cut by masks of their bytes held as big integers."""

from __future__ import annotations

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import pick

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
ONE = ord("1")


def class_mask(members: bytes) -> bytes:
    """A table for bytes.translate that turns members into the digit 1 and all other bytes into 0."""
    return bytes(ONE if b in members else ONE - 1 for b in range(256))


FOLLOWING = class_mask(bytes(range(0x80, 0xC0)))  # UTF-8 bytes inside a code point
BLANK = class_mask(b" \t\n\v\f\r")
NEWLINE = class_mask(b"\n")


def mask(text: bytes, table: bytes) -> int:
    """One bit for each byte, the first byte's the highest; a power of two as the base reads in linear time."""
    return int(text.translate(table) or b"0", 2)


def starts(text: bytes, units: str) -> int:
    """The mask of the bytes at which a unit begins: code points, words with the blanks after them, or lines.

    Blanks before the first word belong to it. A shift to the right moves marks on by a byte.
    """
    full, first = (1 << len(text)) - 1, 1 << len(text) >> 1
    if units == "code_points":
        return full & ~mask(text, FOLLOWING)
    if units == "words":
        letters = full & ~mask(text, BLANK)
        begun = letters & ~(letters >> 1)
        lead = len(text) - begun.bit_length()  # blanks before the first word
        return (begun & ~(first >> lead)) | first if begun else first
    if units == "lines":
        return (mask(text, NEWLINE) >> 1) | first
    raise ValueError(f"unknown units {units!r}")


def select(marks: int, width: int, ranks: list[int], at: int = 0) -> dict[int, int]:
    """The places of the marked bits of the given ranks (ascending, from 0), counted from the highest of width bits.

    The bits are halved; each half's count tells which ranks lie in it. Halves without a
    rank are not looked at, so a rank costs time in proportion to the width, once.
    """
    if not ranks:
        return {}
    if width == 1:
        return {ranks[0]: at}
    right = width - width // 2
    high = marks >> right
    count = high.bit_count()
    left = select(high, width // 2, [r for r in ranks if r < count], at)
    later = [r - count for r in ranks if r >= count]
    found = select(marks & ((1 << right) - 1), right, later, at + width // 2) if later else {}
    return left | {r + count: place for r, place in found.items()}


def cut(text: bytes, units: str, ranks: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """(n, units before the middle, units in it, bytes before it, bytes up to its end); the ranks count modulo n + 1."""
    marks = starts(text, units)
    n = marks.bit_count()
    a, b = sorted(r % (n + 1) for r in ranks)
    places = select(marks, len(text), sorted({r for r in (a, b) if r < n})) | {n: len(text)}
    return n, a, b - a, places[a], places[b]


def draws(own: Column, salt: str) -> list[Column]:
    """Four whole numbers below 2^32 from the id and the salt."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(own.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, units: str = "code_points", plain: int = 10, spm: int = 20, salt: str = "1:", marks: tuple[str, str, str] = MARKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: its whole text cut into n units and rearranged.

    Two draws from the id are the cuts, a third keeps `plain` of a hundred texts as they
    are, a fourth gives `spm` of a hundred others the form suffix, prefix, middle instead
    of prefix, suffix, middle. Empty texts and those that hold a mark are plain as well;
    plain ones have no prefix and middle (null). Each row stands for itself: repeated
    rows come out alike, a null text counts as empty, a null id as an empty one. An empty
    table gives no rows; other columns are left out. One narrow pass; a task holds one
    batch of texts, and besides it a byte and some bits for each byte of one text.
    """
    if units not in ("code_points", "words", "lines"):
        raise ValueError(f"unknown units {units!r}")
    if len(set(marks)) < 3 or not all(m and m.startswith("<") and m.endswith(">") and "<" not in m[1:] for m in marks):
        raise ValueError("marks are three different strings, each from < to > without another <")
    rows = pick(docs, id_column, text_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    h = draws(F.col(id_column), salt)
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(text, F.lit(m))
    form = F.when((text == "") | held | (F.pmod(h[2], F.lit(100)) >= 100 - plain), "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    rows = rows.select(F.col(id_column), text.cast("binary").alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")), T.StructField("form", T.StringType()), T.StructField("output", T.StringType())])
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in batches:
            numbers, outputs = [], []
            for value, h1, h2, kind in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                body = value.as_py()
                n, before, within, a, b = cut(body, units, (h1, h2))
                if kind == "plain":
                    numbers.append((n, None, None))
                    outputs.append(body)
                else:
                    numbers.append((n, before, within))
                    prefix, middle, suffix = body[:a], body[a:b], body[b:]
                    outputs.append(b"".join((p, prefix, s, suffix, m, middle) if kind == "psm" else (s, suffix, p, prefix, m, middle)))
            counts = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, batch.column(4), pa.array(outputs, pa.binary()).cast(pa.string())], schema.names)

    return rows.mapInArrow(run, schema).select(id_column, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle was made from; null for an unknown form.

    A mark begins with < and holds no other, so where a text and a mark meet no earlier
    mark can arise: the first one found is the one that was put in.
    """
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: cuts, form, and digests of the output and of the text restored from it."""
    rows = fill_in_middle(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
