"""Token banks as flat files, written by many tasks and read by position.

A bank is a folder. For each run of `rows_a_file` rows in order, NAME.tokens holds their
tokens one after the other and NAME.index a record for each row: where its tokens begin
in the file, how many they are, and its columns, all little-endian 64-bit integers. A
row's file and record follow from its ordinal alone, so reading by position joins
nothing but the files' names. `manifest` (Parquet) has a row for each file, `header` one.

Files have a name of their own for each attempt of a task; only those that Spark's
committer takes into the manifest are the bank's. They are opened by pyarrow: local
paths and the schemes it knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import storage
from ..functions.exprs import tokens
from ..operators.ordering import numbered
from .ranges import DataError, file_system

#: Rows in a file; the last may have fewer.
FILE_ROWS = 1 << 16
#: Ranges of a file are read together if no more than GAP bytes lie between them and they span no more than SPAN.
GAP, SPAN = 1 << 16, 8 << 20
#: A batch of rows is closed at so many bytes of tokens.
BATCH = 8 << 20
#: Times that an ordinal is read by one task; one asked for more often is dealt to several.
REPEATS = 1024
LISTED = "file long, name string, n long, n_tokens long"


def write_bank(rows: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] = (), rows_a_file: int = FILE_ROWS) -> None:
    """The tokens of `sequence` in order, and whole-number columns, as a bank at path; an earlier one there is replaced once this is whole.

    Null sequences are empty ones; a null in a column is an error, as are columns that
    aren't whole numbers. Rows that agree in `order` may come in any order. No rows give
    a bank without files.
    """
    if rows_a_file < 1:
        raise ValueError("rows_a_file must be positive")
    spark, columns = rows.sparkSession, list(columns)
    kinds = dict(rows.dtypes)
    odd = [c for c in columns if kinds[c] not in ("tinyint", "smallint", "int", "bigint")]
    if odd:
        raise ValueError(f"not whole numbers: {', '.join(odd)}")
    whole = [F.coalesce(F.col(f"`{c}`").cast("long"), F.raise_error(F.lit(f"a bank's column {c} holds a null")).cast("long")).alias(f"_c{i}") for i, c in enumerate(columns)]
    keys = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    placed = numbered(rows.select(*keys, F.coalesce(tokens("sequence"), F.lit(b"")).alias("_tokens"), *whole), [f"_o{i}" for i in range(len(keys))], "_ordinal")
    dealt = placed.select(F.floor(F.col("_ordinal") / rows_a_file).alias("file"), "_ordinal", "_tokens", *(f"_c{i}" for i in range(len(columns))))
    part, aside = f"{path}.part", f"{path}.old"
    target, half, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, part, aside))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(half, True)

    def write(batches):
        yield from written(batches, part)

    try:
        dealt.repartition("file").sortWithinPartitions("file", "_ordinal").mapInArrow(write, LISTED).write.parquet(f"{part}/_listed")
        listed = spark.read.schema(LISTED).parquet(f"{part}/_listed")
        # a row for each file
        before = "coalesce(sum(n_tokens) over (order by file rows between unbounded preceding and 1 preceding), 0) as base"
        listed.selectExpr("*", before).write.parquet(f"{part}/manifest")
        header = listed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        header.withColumns({"rows_a_file": F.lit(rows_a_file).cast("long"), "columns": F.array(*map(F.lit, columns)).cast("array<string>")}).write.parquet(f"{part}/header")
        swept(part, {r.name for r in listed.select("name").toLocalIterator()})
        storage.replace(files, half, target, old)
    finally:
        files.delete(half, True)


def written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (file, ordinal, tokens, columns), sorted so, and tells (file, name, n, n_tokens) of each file."""
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    now, name, text, index, n, at = None, "", None, None, 0, 0

    def closed() -> pa.RecordBatch:
        text.close()
        index.close()
        return pa.RecordBatch.from_pylist([{"file": now, "name": name, "n": n, "n_tokens": at}], pa.schema([("file", pa.int64()), ("name", pa.string()), ("n", pa.int64()), ("n_tokens", pa.int64())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column(0).to_numpy()
        held = batch.column(2).to_pylist()
        size = np.fromiter(map(len, held), np.int64, len(held))
        extra = [batch.column(c).to_numpy() for c in range(3, batch.num_columns)]
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(edges, edges[1:]):
            if number[a] != now:
                if now is not None:
                    yield closed()
                now, n, at = int(number[a]), 0, 0
                name = f"{now:012d}-{uuid.uuid4().hex}"
                text, index = (system.open_output_stream(f"{inner}/{name}.{k}") for k in ("tokens", "index"))
            text.write(b"".join(held[a:b]))
            ends = at + np.cumsum(size[a:b])
            index.write(np.stack([ends - size[a:b], size[a:b], *(x[a:b] for x in extra)], 1).astype("<i8").tobytes())
            n, at = n + b - a, int(ends[-1])
    if now is not None:
        yield closed()


def swept(folder: str, names: set[str]) -> None:
    """Deletes the files of attempts that were lost; names has an entry for each file that stays."""
    from pyarrow import fs

    system, inner = file_system(folder)
    for found in system.get_file_info(fs.FileSelector(inner)):
        stem, _, kind = found.base_name.rpartition(".")
        if kind in ("tokens", "index") and stem not in names:
            system.delete_file(found.path)


def header(spark: SparkSession, path: str):
    """(n, n_tokens, rows_a_file, columns) of a bank."""
    return spark.read.parquet(f"{path}/header").first()


def bank_check(spark: SparkSession, path: str) -> DataFrame:
    """(n, n_tokens, n_bytes, whole): rows and tokens by the index files, bytes of the token files on disk, whether all agree with the manifest."""
    width = 8 * (2 + len(header(spark, path).columns))

    def look(batches):
        system, inner = file_system(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, index = system.get_file_info([f"{inner}/{row['name']}.{k}" for k in ("tokens", "index")])
                size, told, n_tokens = text.size or 0, index.size or 0, 0
                if told:
                    with system.open_input_stream(index.path) as source:
                        while held := source.read(width << 12):
                            n_tokens += int(np.frombuffer(held[: len(held) // 8 * 8], "<i8")[1 :: width // 8].sum())
                n = told // width
                out.append({"n": n, "n_tokens": n_tokens, "n_bytes": size, "whole": told % width == 0 and n == row["n"] and size == n_tokens == row["n_tokens"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("whole", pa.bool_())]))

    found = spark.read.parquet(f"{path}/manifest").repartition("file").mapInArrow(look, "n long, n_tokens long, n_bytes long, whole boolean")
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_tokens", "n_bytes"))
    return found.agg(*sums, F.coalesce(F.bool_and("whole"), F.lit(True)).alias("whole"))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, offset, length, tokens, columns) of all rows; offset is where their tokens begin if all files follow one another."""
    told = header(spark, path)
    files = spark.read.parquet(f"{path}/manifest").where("n > 0").repartition("file")
    places = files.select("name", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"), (F.col("file") * told.rows_a_file).alias("first"))
    return at_places(places.select("name", "base", "at", (F.col("first") + F.col("at")).alias("ordinal"), F.lit(1).cast("long").alias("times")), path, told.columns).drop("times")


def take_from_bank(spark: SparkSession, path: str, ordinals: DataFrame) -> DataFrame:
    """(ordinal, offset, length, tokens, columns) of the given ordinals, as often as they are given; only their ranges of the files are read.

    An ordinal that the bank doesn't have, or null, is an error. Repeats are counted
    before anything is read: a row is read once for each REPEATS of them.
    """
    told = header(spark, path)
    asked = ordinals.groupBy(F.col("ordinal").cast("long").alias("ordinal")).agg(F.count(F.lit(1)).alias("_n"))
    outside = F.col("ordinal").isNull() | (F.col("ordinal") < 0) | (F.col("ordinal") >= told.n)
    wrong = F.concat(F.lit("not an ordinal of the bank: "), F.coalesce(F.col("ordinal").cast("string"), F.lit("null")))
    asked = asked.withColumn("ordinal", F.when(outside, F.raise_error(wrong).cast("long")).otherwise(F.col("ordinal")))
    asked = asked.withColumn("file", F.floor(F.col("ordinal") / told.rows_a_file)).withColumn("at", F.col("ordinal") % told.rows_a_file)
    split = asked.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / REPEATS)))).withColumn("times", F.least(F.col("_n") - F.col("_b") * REPEATS, F.lit(REPEATS).cast("long")))
    found = split.join(spark.read.parquet(f"{path}/manifest").select("file", "name", "base"), "file")
    places = found.repartitionByRange("ordinal", "_b").sortWithinPartitions("ordinal", "_b").select("name", "base", "at", "ordinal", "times")
    out = at_places(places, path, told.columns)
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_i", "times")


def at_places(places: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """(ordinal, times, offset, length, tokens, columns) at the places (name, base, at, ordinal, times), which come sorted within their partitions."""
    width, inner_names = 8 * (2 + len(columns)), [f"_c{i}" for i in range(len(columns))]
    names = ["ordinal", "times", "offset", "length", "tokens", *inner_names]
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * len(columns)

    def read(batches):
        system, inner = file_system(path)
        for batch in batches:
            files = batch.column(0).to_pylist()
            base, at, ordinal, times = (batch.column(c).to_numpy() for c in range(1, 5))
            edges = [k for k in range(len(files)) if not k or files[k] != files[k - 1]] + [len(files)]
            for a, b in zip(edges, edges[1:]):
                with system.open_input_file(f"{inner}/{files[a]}.index") as index:
                    begin = (at[a:b] * width).tolist()
                    raw = b"".join(pieces(index, begin, [x + width for x in begin]))
                records = np.frombuffer(raw, "<i8").reshape(b - a, -1)
                with system.open_input_file(f"{inner}/{files[a]}.tokens") as text:
                    held, size, low = [], 0, a
                    for k, piece in enumerate(pieces(text, records[:, 0].tolist(), records[:, :2].sum(1).tolist()), a + 1):
                        held.append(piece)
                        size += len(piece)
                        if size >= BATCH or k == b:
                            own = records[low - a : k - a]
                            columns = (ordinal[low:k], times[low:k], base[low:k] + own[:, 0], own[:, 1], held, *own[:, 2:].T)
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)
                            held, size, low = [], 0, k

    schema = "ordinal long, times long, offset long, length long, tokens binary" + "".join(f", {c} long" for c in inner_names)
    return places.mapInArrow(read, schema).toDF(*names[:5], *columns)


def pieces(source, starts: list[int], ends: list[int]) -> Iterator[bytes]:
    """The bytes of each range, whose starts ascend; neighbours are read together, within GAP and SPAN."""
    i = 0
    while i < len(starts):
        j, low, high = i + 1, starts[i], ends[i]
        while j < len(starts) and starts[j] <= high + GAP and ends[j] - low <= SPAN:
            high = max(high, ends[j])
            j += 1
        held = source.read_at(high - low, low)
        if len(held) < high - low:
            raise DataError(f"a bank's file ends before byte {high}")
        for a, b in zip(starts[i:j], ends[i:j]):
            yield held[a - low : b - low]
        i = j
