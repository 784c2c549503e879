"""Weights, token banks, chunks, samples, length buckets, padded batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Row, Window

from ..functions.exprs import balancing_key, raw_weight, tokens
from ..functions.hashing import draw
from .ordering import numbered, running

#: Whole units of a weight of 1: sums of whole numbers don't depend on their order.
WEIGHT_UNITS = 2**24
#: Cells of the line of weights at most; one row reaches into no more.
MOST_CELLS = 2**18
#: Fixed value: rows in a chunk.
CHUNK_ROWS = 100_000
#: Leading hex digits of a hash that name its group in a fingerprint.
FINGERPRINT_DIGITS = 4


def class_frequencies(rows: DataFrame, rank: str = "genus") -> DataFrame:
    """Rows with `frequency`, the rows of their class; counted before rows meet their count."""
    named = rows.withColumn("_key", balancing_key(rank))
    counts = named.groupBy("_key").agg(F.count(F.lit(1)).cast("double").alias("frequency"))
    return named.join(counts, "_key").drop("_key")


def sampling_weights(rows: DataFrame, frequency: str, power: float, name: str = "weight") -> DataFrame:
    """Rows with a weight, frequency to the power -power, scaled so that weights sum to the number of rows."""
    raw = raw_weight(frequency, power)
    one = rows.agg((F.count(F.lit(1)) / F.sum(raw)).alias("_scale"))
    return rows.join(F.broadcast(one), F.lit(True)).withColumn(name, raw * F.col("_scale")).drop("_scale")  # with a row


def token_bank(rows: DataFrame, order: list[str]) -> DataFrame:
    """`tokens` (a byte each) and `offset`, where they begin if all follow one another in order."""
    return running(rows, order, F.col("length"), "offset").withColumn("tokens", tokens("sequence"))


def bank_is_whole(bank: DataFrame) -> DataFrame:
    """Whether lengths and tokens agree: (n, n_tokens, n_bytes, whole)."""
    one = bank.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("n_tokens"), F.sum(F.octet_length("tokens")).alias("n_bytes"))
    return one.withColumn("whole", F.col("n_tokens") == F.col("n_bytes"))


def chunked(rows: DataFrame, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with `ordinal`, their number in order, and `chunk`: chunk_rows rows that follow one another; the last may be shorter."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("ordinal") / chunk_rows))


def chunks(rows: DataFrame, order: list[str], chunk_rows: int = CHUNK_ROWS) -> Iterator[list[Row]]:
    """The chunks one after the other as lists of rows; the driver holds one partition, and one chunk of it, at a time."""
    held = chunked(rows, order, chunk_rows).orderBy("ordinal").drop("ordinal")
    for _, chunk in groupby(held.toLocalIterator(), lambda r: r.chunk):
        yield list(chunk)


def fingerprint(rows: DataFrame, key: str = "seq_hash") -> DataFrame:
    """(fingerprint): one hash over the hex hashes `key` in order, however often each is there; of no rows the hash of nothing.

    Hashes that begin alike are folded together, then the groups' hashes: no task sees
    all rows. Equal hashes are counted first, so one that many rows share is one entry.
    """
    counted = rows.groupBy(F.col(key).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.concat_ws(":", "_h", F.col("_n").cast("string"))
    groups = counted.where("_h is not null").groupBy(F.substring("_h", 1, FINGERPRINT_DIGITS).alias("_g")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(entry)), ",")).alias("_d"))
    told = F.array_sort(F.collect_list(F.concat_ws(":", "_g", "_d")))
    return groups.agg(F.md5(F.array_join(told, ",")).alias("fingerprint"))


def take(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The rows of the given ordinals, as often as they are given."""
    return ordinals.join(rows, "ordinal")


def validation_subset(rows: DataFrame, samples: int, seed: int, key: str = "seq_hash", impl: str = "blake2b") -> DataFrame:
    """`samples` rows without replacement, by the least draws, in the order of their keys; all rows if there are no more.

    Only keys, one for each row, are sorted by their draws; whole rows stay where they are.
    """
    chosen = rows.select(key).orderBy(draw(key, seed, "validation", impl), key).limit(samples)
    return rows.join(chosen, key, "left_semi").orderBy(key)


def weighted_sample(rows: DataFrame, weight: str, number: int, seed: int, key: str = "seq_hash", impl: str = "blake2b") -> DataFrame:
    """`number` rows with replacement and `draw`, their place in the sample: each draw takes a row with its share of the weights.

    Weights of mean about 1, as sampling_weights gives them, are laid end to end in the
    order of `key` in whole units (WEIGHT_UNITS to 1, so that sums are exact); a draw is a
    point there and takes the row it falls on. Null and negative weights count as 0.
    Points and rows are dealt to cells of the line, a row to each cell that it reaches
    into, so neither a heavy row nor a large sample meets in one task. Each row has a key
    of its own. No row has any weight: no draws.
    """
    if number < 0:
        raise ValueError("a sample can't be negative")
    units = F.greatest(F.coalesce(F.round(F.col(weight) * WEIGHT_UNITS).cast("long"), F.lit(0)), F.lit(0))
    laid = running(rows.select(key, units.alias("_units")).where("_units > 0"), [key], F.col("_units"), "_from")
    total = laid.agg(F.sum("_units").alias("_total"))
    cells = max(1, min(number, MOST_CELLS))
    width = F.ceil(F.col("_total") / cells)
    points = rows.sparkSession.range(number).withColumnRenamed("id", "draw").join(F.broadcast(total), F.col("_total") > 0)  # with a row
    points = points.withColumn("_at", F.floor(draw(F.col("draw").cast("string"), seed, "sample", impl) * F.col("_total")).cast("long"))
    points = points.select(F.floor(F.col("_at") / width).alias("_cell"), "_at", "draw", F.lit(None).cast(dict(laid.dtypes)[key]).alias("_row"))
    reached = F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_from") + F.col("_units") - 1) / width))
    starts = laid.join(F.broadcast(total), F.lit(True)).withColumn("_cell", F.explode(reached))  # with a row
    starts = starts.select("_cell", F.greatest("_from", F.col("_cell") * width).alias("_at"), F.lit(None).cast("long").alias("draw"), F.col(key).alias("_row"))
    line = Window.partitionBy("_cell").orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    drawn = starts.unionByName(points).withColumn("_row", F.last("_row", ignorenulls=True).over(line)).where("draw is not null")
    return drawn.select("draw", F.col("_row").alias(key)).join(rows, key)


def bucket_by_length(rows: DataFrame, order: list[str], batch_size: int, window: int) -> DataFrame:
    """(…, ordinal, bucket, batch, slot): windows of batch_size x window rows in order, by length within, cut into batches.

    `ordinal` numbers the rows in order; of equal lengths the earlier stays first.
    """
    in_order = rows if "ordinal" in rows.columns else numbered(rows, order)
    size = batch_size * window
    placed = in_order.withColumn("bucket", F.floor(F.col("ordinal") / size).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("length", "ordinal")) - 1
    return placed.withColumn("_p", place).withColumn("batch", (F.col("bucket") * window + F.floor(F.col("_p") / batch_size)).cast("int")).withColumn("slot", (F.col("_p") % batch_size).cast("int")).drop("_p")


def shuffled_batches(batches: DataFrame, batch_size: int, seed: int, impl: str = "blake2b") -> DataFrame:
    """(batch, size, turn): full batches in drawn order, shorter ones last."""
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    drawn = draw(F.col("batch").cast("string"), seed, "batch", impl)
    keyed = sizes.withColumn("_short", F.col("size") < batch_size).withColumn("_draw", drawn)
    return numbered(keyed, ["_short", "_draw", "batch"], "turn").drop("_short", "_draw")


def cropped(rows: DataFrame, probability: float, low: int, high: int, seed: int, key: str = "seq_hash", impl: str = "blake2b") -> DataFrame:
    """Rows whose sequence, with that probability, is a window of low to high letters at a drawn place; shorter ones stay.

    Draws come from `key` alone, so a lost task makes the same windows again; for others
    in each epoch give another seed.
    """
    if not (0 <= probability <= 1 and 1 <= low <= high):
        raise ValueError("probability must lie in [0, 1], bounds must satisfy 1 <= low <= high")
    size = F.lit(low) + F.floor(draw(key, seed, "crop-length", impl) * (high - low + 1)).cast("int")
    cut = rows.withColumn("_size", F.when(draw(key, seed, "crop", impl) < probability, size))
    place = F.floor(draw(key, seed, "crop-place", impl) * (F.col("length") - F.col("_size") + 1)).cast("int")
    cut = cut.withColumn("_place", F.when(F.col("length") > F.col("_size"), place))
    window = F.substring(F.col("sequence"), F.col("_place") + 1, F.col("_size"))
    cut = cut.withColumn("sequence", F.when(F.col("_place").isNotNull(), window).otherwise(F.col("sequence")))
    return cut.withColumn("length", F.when(F.col("_place").isNotNull(), F.col("_size")).otherwise(F.col("length"))).drop("_size", "_place")


def padded(batches: DataFrame, max_length: int, min_width: int = 1) -> DataFrame:
    """(…, width, padded): sequences, cropped before if at all, cut to max_length and filled up with '-' to their batch's width."""
    held = F.least("length", F.lit(max_length))
    width = F.greatest(F.max(held).over(Window.partitionBy("batch")), F.lit(min_width))
    rows = batches.withColumn("width", width).withColumn("n_tokens", held)
    return rows.withColumn("padded", F.rpad(F.substring("sequence", 1, max_length), F.col("width"), F.lit("-")))
