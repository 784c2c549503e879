"""Splits that hashes decide, with some genera held out whole."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.exprs import taxon_key
from ..functions.hashing import draw
from ..functions.schema import Split


def genus_sizes(rows: DataFrame) -> DataFrame:
    """(genus_key, family_key, n_sequences, n_siblings): genera with their number of sequences, and how many genera their family has; genera without family count together."""
    sizes = rows.select(taxon_key("genus").alias("genus_key"), taxon_key("family").alias("family_key")).where("genus_key is not null").groupBy("genus_key", "family_key").agg(F.count(F.lit(1)).alias("n_sequences"))
    families = sizes.groupBy(F.col("family_key").alias("_family")).agg(F.count(F.lit(1)).alias("n_siblings"))
    return sizes.join(families, F.col("family_key").eqNullSafe(F.col("_family"))).drop("_family")


def novel_genera(rows: DataFrame, config: Split = Split(), impl: str = "blake2b") -> DataFrame:
    """(genus_key) of the genera held out: of a family with others, large enough, and drawn."""
    sizes = genus_sizes(rows)
    able = sizes.where((F.col("n_siblings") > 1) & (F.col("n_sequences") >= config.min_novel_genus_size) & F.col("family_key").isNotNull())
    return able.where(draw("genus_key", config.seed, "novel-genus", impl) < config.novel_genus).select("genus_key")


def with_split(rows: DataFrame, config: Split = Split(), impl: str = "blake2b") -> DataFrame:
    """Rows with `split` last. It depends on a row's hash and the set of genera alone, not on order."""
    novel = novel_genera(rows, config, impl).select(F.col("genus_key").alias("_novel"))
    drawn = draw("seq_hash" if impl == "blake2b" else F.lower(F.hex("seq_hash")) if dict(rows.dtypes)["seq_hash"] == "binary" else "seq_hash", config.seed, "sequence", impl)
    held = rows.withColumn("_genus", taxon_key("genus")).withColumn("_draw", drawn).join(novel, F.col("_genus") == F.col("_novel"), "left")
    split = F.when(F.col("_novel").isNotNull(), "test_novel_genus").when(F.col("_draw") < config.validation, "val").when(F.col("_draw") < config.validation + config.test, "test").otherwise("train")
    return held.withColumn("split", split).drop("_genus", "_novel", "_draw")
