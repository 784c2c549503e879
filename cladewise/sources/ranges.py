"""Data sources over lines of text: files, gzip files and members of tar and zip archives, planned as ranges of bytes.

Plain files and members that are stored as they are split into ranges; a line belongs
to the range it begins in. What is compressed is a stream that one task reads, without
unpacking it to a folder. Files are opened by pyarrow: local paths and the schemes it
knows (hdfs, s3, gs, ...).
"""

from __future__ import annotations

import json
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 4 << 20
#: Ranges are no shorter than this, however many tasks there are.
LEAST = 4 << 20
#: A batch of rows is closed at so many bytes of text.
BATCH = 8 << 20


class DataError(Exception):
    """An input that can't be read as what it should be."""


@dataclass(frozen=True)
class Range:
    """Bytes start to stop of a text that lies at low to high in a file; packed: how it is compressed, and then it is one range."""

    path: str
    number: int
    low: int
    high: int
    start: int
    stop: int
    packed: str = ""
    member: str = ""


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    held: list[Range]


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder in the order of their names; names that begin with . or _ are left out."""
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise DataError(f"{path} does not exist")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = (f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p))
    return [(path.rstrip("/") + f.path[len(inner.rstrip("/")) :], f.size) for f in sorted(shown, key=lambda f: f.path)]


def place(path: str, size: int, member: str) -> tuple[int, int, str]:
    """(low, high, packed) of the text in a file."""
    if not member:
        return 0, size, "gzip" if path.endswith(".gz") else ""
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        if zipfile.is_zipfile(file):
            with zipfile.ZipFile(file) as archive:
                if member not in archive.namelist():
                    raise DataError(f"{path} has no {member}")
                info = archive.getinfo(member)
            if info.compress_type != zipfile.ZIP_STORED or info.flag_bits & 1:
                return 0, info.file_size, "zip"
            file.seek(info.header_offset + 26)
            lengths = file.read(4)
            low = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
            return low, low + info.file_size, ""
        file.seek(0)
        try:
            with tarfile.open(fileobj=file, mode="r:") as archive:
                info = next((m for m in archive if m.name == member), None)
        except tarfile.ReadError:
            return 0, size, "tar"  # compressed: its task looks for the member
    if info is None or not info.isfile():
        raise DataError(f"{path} has no {member}")
    return (0, info.size, "tar") if info.issparse() else (info.offset_data, info.offset_data + info.size, "")


def planned(files: list[tuple[str, int]], member: str, largest: int, tasks: int) -> list[Ranges]:
    """The ranges of all files by tasks: long texts are cut, neighbouring short ones read together."""
    places = [(path, *place(path, size, member)) for path, size in files]
    width = max(1, min(largest, max(LEAST, sum(high - low for _, low, high, _ in places) // max(tasks, 1))))
    out, room = [], 0
    for number, (path, low, high, packed) in enumerate(places):
        for start in [low] if packed else range(low, high, width):
            stop = high if packed else min(high, start + width)
            if room < stop - start or not out:
                out.append(Ranges([]))
                room = width
            out[-1].held.append(Range(path, number, low, high, start, stop, packed, member))
            room -= stop - start
    return out


def gunzipped(file) -> Iterator[bytes]:
    """The contents of all members of a gzip file; zeros after the last are padding."""
    unpack = zlib.decompressobj(31)
    begun = False
    while data := file.read(BLOCK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            yield unpack.decompress(data, BLOCK)
            while unpack.unconsumed_tail:
                yield unpack.decompress(unpack.unconsumed_tail, BLOCK)
            data = unpack.unused_data
            if unpack.eof:
                unpack, begun = zlib.decompressobj(31), False
    if begun:
        yield unpack.flush()
        if not unpack.eof:
            raise DataError("the gzip file ends within a member")


def blocks(span: Range) -> Iterator[bytes]:
    """The text from the byte before the range on (the first range: from its start) to its end, not the range's."""
    system, inner = file_system(span.path)
    with system.open_input_file(inner) as file:
        if span.packed == "gzip":
            yield from gunzipped(file)
        elif span.packed == "zip":
            with zipfile.ZipFile(file) as archive, archive.open(span.member) as text:
                while data := text.read(BLOCK):
                    yield data
        elif span.packed == "tar":
            with tarfile.open(fileobj=file, mode="r|*") as archive:
                for info in archive:
                    if info.name == span.member and info.isfile():
                        text = archive.extractfile(info)
                        while data := text.read(BLOCK):
                            yield data
                        return
            raise DataError(f"{span.path} has no {span.member}")
        else:
            at = max(span.start - 1, span.low)
            file.seek(at)
            while data := file.read(min(BLOCK, span.high - at)):
                at += len(data)
                yield data


def whole_lines(span: Range) -> Iterator[tuple[int, bytes]]:
    """(place in the text, whole lines) from the first line that begins in the range, to the end of the text; a longer line is joined once."""
    at = span.start - span.low
    partial = at > 0
    at -= partial
    rest: list[bytes] = []
    for block in blocks(span):
        if partial:
            cut = block.find(b"\n") + 1
            at += cut or len(block)
            if at >= span.stop - span.low:
                return
            if not cut:
                continue
            partial, block = False, block[cut:]
        cut = block.rfind(b"\n") + 1
        if not cut:
            rest.append(block)
            continue
        text = b"".join([*rest, block[:cut]])
        rest = [block[cut:]]
        yield at, text
        at += len(text)
    if text := b"".join(rest):
        yield at, text


class LineReader(DataSourceReader):
    """Plans the ranges; what a range's rows are is told by `batches`."""

    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.member = options.get("member", "")
        self.largest, self.tasks = int(options.get("largest", 128 << 20)), int(options.get("tasks", 1))

    def partitions(self):
        return planned([f for p in self.paths for f in listed(p)], self.member, self.largest, self.tasks) or [Ranges([])]

    def batches(self, span: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def read(self, partition):
        for span in partition.held:
            yield from self.batches(span)


def load(spark: SparkSession, source: type[DataSource], paths: list[str], member: str = "") -> DataFrame:
    """spark.read of a source, its ranges bounded like those of Spark's own files."""
    spark.dataSource.register(source)
    largest = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    options = {"paths": json.dumps(paths), "member": member, "largest": str(largest), "tasks": str(spark.sparkContext.defaultParallelism)}
    return spark.read.format(source.name()).options(**options).load()
