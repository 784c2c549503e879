"""FASTA files as rows of header and sequence."""

from __future__ import annotations

import shutil
import tarfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from .ranges import BATCH, DataError, LineReader, Range, load, whole_lines

SCHEMA = "file string, ordinal struct<part: bigint, at: bigint>, header string, sequence string"


def starts(text: bytes) -> Iterator[int]:
    """Where the lines begin whose first character, white space aside, is '>'."""
    line, mark = 0, text.find(b">")
    while mark >= 0:
        line = text.rfind(b"\n", line, mark) + 1 or line
        if not text[line:mark].decode("utf-8", "replace").strip():
            yield line
        line = text.find(b"\n", mark) + 1
        mark = text.find(b">", line) if line else -1


def records(span: Range) -> Iterator[tuple[int, bytes]]:
    """(place, text) of each record whose header begins in the range, also where its lines go on beyond it."""
    first, stop = span.start == span.low, span.stop - span.low
    held, begun = None, 0
    for at, text in whole_lines(span):
        last = 0
        for line in starts(text):
            if held is not None:
                held.append(text[last:line])
                yield begun, b"".join(held)
            elif first and text[:line].strip():
                raise DataError(f"{span.path}: sequence data before the first header")
            if at + line >= stop and not span.packed:
                return
            held, begun, last = [], at + line, line
        if held is not None:
            held.append(text[last:])
        elif first and text.strip():
            raise DataError(f"{span.path}: sequence data before the first header")
        elif not first and at + len(text) >= stop:
            return
    if held is not None:
        yield begun, b"".join(held)


class FastaReader(LineReader):
    def batches(self, span):
        ordinal = pa.struct([("part", pa.int64()), ("at", pa.int64())])
        rows, size = [], 0

        def batch():
            places, headers, sequences = zip(*rows)
            columns = [pa.array([span.path] * len(rows), pa.string()), pa.array([{"part": span.number, "at": p} for p in places], ordinal), pa.array(headers, pa.string()), pa.array(sequences, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "header", "sequence"])

        for at, text in records(span):
            head, *lines = text.decode("utf-8", "replace").split("\n")
            header, sequence = head.strip()[1:].strip(), "".join(map(str.strip, lines))
            if not header:
                raise DataError(f"{span.path}: empty header at byte {at}")
            if not sequence:
                raise DataError(f"{span.path}: no sequence: {header}")
            rows.append((at, header, sequence))
            size += len(text)
            if size >= BATCH:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class FastaSource(DataSource):
    """spark.read.format("fasta"): options path or paths (a JSON list), member (in a tar or zip archive), largest (bytes of a range), tasks."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, *paths: str, partitions: int = 0) -> DataFrame:
    """(file, ordinal, header, sequence) of files and folders in one scan: plain files are cut into ranges of bytes, a gzip file is one task until it is dealt out anew.

    `ordinal` is the file's number and the byte its record begins at, so it is the same
    in each run. Lines end with \\n or \\r\\n; they are stripped, blank ones skipped. Text
    before the first header, an empty header and a record without sequence end the query
    with an error; bytes that are no UTF-8 are replaced; a file without records gives none.
    """
    out = load(spark, FastaSource, list(paths))
    return out.repartition(partitions) if partitions else out


def read_fasta_member(spark: SparkSession, archive: str, member: str, folder: str | None = None) -> DataFrame:
    """A FASTA file inside a tar archive of any compression, or a zip archive.

    Without a folder it is read where it is: a stored member in ranges, a compressed one
    as a stream of one task. With a folder that the executors share, a tar's member is
    unpacked there once, so that many tasks read what was compressed.
    """
    if folder is None:
        return load(spark, FastaSource, [archive], member)
    target = Path(folder) / Path(member).name
    if not target.exists():
        part = target.with_name(target.name + ".part")
        target.parent.mkdir(parents=True, exist_ok=True)
        with tarfile.open(archive) as tar:
            try:
                held = tar.extractfile(member)
            except KeyError:
                held = None
            if held is None:
                raise DataError(f"{archive} has no {member}")
            try:
                with held, part.open("wb") as out:
                    shutil.copyfileobj(held, out)
                part.rename(target)
            finally:
                part.unlink(missing_ok=True)
    return read_fasta(spark, str(target))
