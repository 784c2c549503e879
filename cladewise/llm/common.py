"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 2000
#: Slices over which the rows of one hot key are spread.
HOT_SLICES = 64


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each exact name; other columns, also those whose names differ in case only, go."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local run gets a temporary folder, which becomes the
    context's; on a cluster that would be one machine's disk, so it is an error.
    """
    context = spark.sparkContext
    if told := spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir():
        return told
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shared"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, without its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as Parquet and read back; discard() deletes it.

    A checkpoint keeps the size that its plan was guessed at. Over the turns of an
    iteration these guesses multiply to numbers of millions of digits; files tell their
    true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote; no plan may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows left-joined with facts, one row for each key, of which count is its number of rows.

    Facts are written once. Those of hot keys, fewer than HOT_SHARE, are broadcast, and
    their rows are dealt out over HOT_SLICES slices of the join with the others, so no
    task gets all rows of a key. Without a hot key the join is the plain one.
    """
    facts = written(facts)
    told = facts.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    if (told.most or 0) * HOT_SHARE <= (told.total or 0):
        return rows.join(facts.drop(count), key, "left")
    values = [c for c in facts.columns if c not in (key, count)]
    few = facts.where(F.col(count) * HOT_SHARE > F.lit(told.total)).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    others = [c for c in rows.columns if c != key]
    hot = F.col("_hot").isNotNull()
    spread = F.pmod(F.xxhash64(*others), F.lit(HOT_SLICES)).cast("int") if others else F.lit(0)
    left = rows.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left").withColumn("_slice", F.when(hot, spread).otherwise(0))
    met = left.join(facts.drop(count).withColumn("_slice", F.lit(0)), [key, "_slice"], "left")
    return met.select(key, *others, *(F.when(hot, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def least_ids(rows: DataFrame, key: str, number: int, most: int) -> DataFrame:
    """For each key its `most` smallest numbers, in slices first: a key with many rows is no task's own."""
    from pyspark.sql import Window

    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(number), F.lit(HOT_SLICES)))
    first = Window.partitionBy(key, "_slice").orderBy(number)
    last = Window.partitionBy(key).orderBy(number)
    return sliced.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_slice").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_n")
