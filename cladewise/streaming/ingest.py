"""New FASTA files as a stream: the same filters and hashes, and a table without repeats."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import cut_at, normalize_sequence, strip, valid_sequence
from ..functions.schema import Filters
from ..operators.staging import ambiguity_reason, length_reason


def records(spark: SparkSession, folder: str, marker: str = "ssu", filters: Filters | None = None) -> DataFrame:
    """A stream of (accession, sequence, length, n_ambiguous, marker, exclusion, seen) of the records in files that come into a folder."""
    pieces = spark.readStream.format("text").option("lineSep", "\n>").load(folder)
    text = F.regexp_replace("value", r"^\s*>", "")
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x != "")
    header = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    sequence = normalize_sequence(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ""))
    rows = pieces.where(F.size(lines) > 0).select(cut_at(header, " ")["head"].alias("accession"), sequence.alias("sequence"), F.lit(marker).alias("marker"), F.current_timestamp().alias("seen"))
    rows = rows.withColumn("length", F.length("sequence")).withColumn("n_ambiguous", F.length(F.regexp_replace("sequence", "[ACGT]+", "")))
    filters = filters or Filters()
    return rows.withColumn("exclusion", F.coalesce(F.when(~valid_sequence("sequence"), "invalid_sequence"), length_reason(filters), ambiguity_reason(filters)))


def distinct_sequences(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first record of each kept sequence within the watermark; older state goes."""
    return rows.where("exclusion is null").withWatermark("seen", delay).dropDuplicatesWithinWatermark(["sequence"])


def counts(rows: DataFrame, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Records by window and exclusion."""
    return rows.withWatermark("seen", delay).groupBy(F.window("seen", width), F.coalesce("exclusion", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All files there are, once, into Parquet; what was written before is known from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
