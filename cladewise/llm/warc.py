"""Operator 9: WARC archives, written by Spark's own writer and read back by a reader that salvages."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import attach, pick, shared_folder

#: An empty gzip member. It stands between the members of an archive and unpacks to nothing.
NOTHING = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
ENDING = b"\r\n\r\n"
#: Unpacked bytes of one member at most: more than any row can hold, with its heads.
LARGEST = (1 << 31) + (1 << 20)
#: A file is closed when its members reach so many bytes.
FILE_BYTES = 16 << 20
NAME = "urn:page:"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def record(kind: str, name: str, url: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record. A revisit has the head of the answer and, for its payload, the digest and the record that holds it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{name}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + ENDING + block + ENDING


def parse(data: bytes, at: int = 0) -> tuple[dict | None, int, str]:
    """(record or None, where it ends, what is wrong with it) of the plain record at a place."""
    if not (found := VERSION.match(data, at)):
        return None, at, "no version line"
    fields, line = {}, found.end()
    while (end := data.find(b"\r\n", line)) != line:
        if end < 0:
            return None, at, "headers without end"
        key, colon, value = data[line:end].partition(b":")
        if not colon:  # the next version line has none, so no header is read twice
            return None, at, "header without colon"
        fields[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        line = end + 2
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None, at, "no content length"
    start = end + 2
    stop = start + int(length)
    if data[stop : stop + 4] != ENDING:
        return None, at, "block without end"
    block = data[start:stop]
    head, gap, payload = block.partition(ENDING)
    if fields.get("warc-type") == "response" and gap:
        import hashlib

        told = fields.get("warc-payload-digest", "")
        if told.startswith("sha1:") and told[5:] != hashlib.sha1(payload).hexdigest():
            return None, at, "payload digest differs"
    return {"fields": fields, "head": head, "payload": payload if gap else b""}, stop + 4, ""


def unpacked(view: memoryview, at: int, step: int = 16_384) -> tuple[bytes | None, int]:
    """(contents, where it ends) of the gzip member at a place; None if it fails its checks or unpacks to more than LARGEST."""
    unpack, out, size = zlib.decompressobj(31), [], 0
    while not unpack.eof and at < len(view):
        part = view[at : at + step]
        try:
            out.append(unpack.decompress(part, LARGEST - size + 1))
        except zlib.error:
            return None, at
        at += len(part)
        size += len(out[-1])
        if size > LARGEST:
            return None, at
    return (b"".join(out), at - len(unpack.unused_data)) if unpack.eof else (None, at)


def salvage(data: bytes):
    """The records of an archive, gzip members or plain, as ("record", start, end, record) and what is lost as ("gap", start, end, reason).

    After a member or record that fails its checks, the reader searches for the next
    gzip header whose member unpacks to a record, or the next version line that
    starts a whole record, and goes on from there; the bytes between are one gap. Where
    the next header and the next version line are is remembered, so the search for them
    goes through the archive once.
    """
    at, lost, why, size = 0, None, "", len(data)
    after = line = -1  # the next gzip header and version line as last found; size if there is none
    view = memoryview(data)
    while at < size:
        found, end, fault = None, at, "no member or version line"
        if data.startswith(MEMBER, at):
            out, stop = unpacked(view, at)
            if out is not None:
                if not out:
                    if lost is not None:
                        yield "gap", lost, at, why
                        lost = None
                    at = stop
                    continue
                found, ended, fault = parse(out)
                if found and ended != len(out):
                    found, fault = None, "more than one record in a member"
                end = stop
            else:
                fault = "member fails its checks"
        elif VERSION.match(data, at):
            found, end, fault = parse(data, at)
        if found:
            if lost is not None:
                yield "gap", lost, at, why
                lost = None
            yield "record", at, end, found
            at = end
            continue
        if lost is None:
            lost, why = at, fault
        if after <= at:
            after = data.find(MEMBER, at + 1)
            after = size if after < 0 else after
        if line <= at:
            seen = VERSION.search(data, at + 1)
            line = seen.start() if seen else size
        at = min(after, line)
    if lost is not None:
        yield "gap", lost, size, why


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> None:
    """A gzip member for each page, in files that are closed at FILE_BYTES.

    Of equal payloads of at least `least` bytes the largest page_id is the response and
    the others revisit it; of rows that share that id each one is a response. The rows
    of a frequent payload are spread over many tasks. Null html is an empty payload; a
    page without id is told apart only by its place; other columns are left out.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("payload_digest", F.sha1("html")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    known = attach(rows, large.where("_n > 1"), "payload_digest", "_n")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    told = known.select(F.col("page_id").cast("string").alias("name"), F.coalesce("url", F.lit("")).alias("url"), F.when(revisit, F.lit("")).otherwise(F.col("html")).cast("binary").alias("payload"), "payload_digest", "payload_bytes", F.when(revisit, F.col("_first").cast("string")).alias("refers_to"))

    def run(batches):
        out, size_so_far = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                name, url, payload, digest, size, refers_to = (x.as_py() for x in row)
                url = re.sub(r"[\r\n]+", " ", url)
                out.append(member(record("response" if refers_to is None else "revisit", name or "", url, digest, size, payload, refers_to)))
                size_so_far += len(out[-1])
                if size_so_far >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([NOTHING.join(out)], pa.binary())], ["value"])
                    out, size_so_far = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([NOTHING.join(out)], pa.binary())], ["value"])

    lines = told.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    writer = lines.write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none")
    writer.option("maxRecordsPerFile", 1).mode("error").text(folder)


RECORDS = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("lost", T.StringType()), ("name", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def read_archives(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """A row for each record, and one for each gap with its reason in `lost` (null for records); `strict`: a gap is an error.

    `start` and `end` are places in the file. payload_bytes of a revisit are those that
    its head tells. Files that hold nothing give no rows.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, out = path.as_py(), []
                for what, start, end, x in salvage(content.as_py()):
                    if what == "gap" and strict:
                        raise ValueError(f"{path}: bytes {start} to {end} are no record: {x}")
                    if what == "gap":
                        out.append({"file": path, "start": start, "end": end, "lost": x})
                        continue
                    fields = x["fields"]
                    told = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", x["head"])
                    refers = fields.get("warc-refers-to")
                    out.append({"file": path, "start": start, "end": end, "name": fields.get("warc-record-id", "").strip("<>").removeprefix(NAME), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(told[1]) if told else len(x["payload"]), "refers_to": refers.strip("<>").removeprefix(NAME) if refers else None, "payload": x["payload"]})
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORDS)
    return files.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the archives to the shared folder and reads them, where a gap is an error: page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, start, end."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    kind = pick(pages, "page_id").schema[0].dataType
    write_archives(pages, folder, least)
    records = read_archives(spark, folder, strict=True)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return records.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url", "file", "start", "end")
