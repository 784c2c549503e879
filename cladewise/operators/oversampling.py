"""How many synthetic rows each class gets, and the rows."""

from __future__ import annotations

import random

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from ..functions import storage
from ..functions.exprs import balancing_key, count_ambiguous
from ..functions.hashing import copy_seed, sequence_hash
from ..functions.schema import UNKNOWN, Mutation, Oversampling
from .ordering import numbered_within


def classes(rows: DataFrame, rank: str = "genus") -> DataFrame:
    """Rows with `group` (kingdom or unknown), `key` (the class) and `size`, the class's rows."""
    named = rows.withColumn("group", F.coalesce("kingdom", F.lit(UNKNOWN))).withColumn("key", F.concat_ws("|", F.col("group"), balancing_key(rank)))
    return named.join(named.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")


def plan_copies(sizes: DataFrame, floor: int, most: int) -> DataFrame:
    """(group, key, size) with `copies`: up to the floor, at most `most` for each row; classes that need none go."""
    copies = F.least(F.greatest(F.lit(floor) - F.col("size"), F.lit(0)), F.lit(most) * F.col("size"))
    return sizes.withColumn("copies", copies.cast("long")).where("copies > 0")


def apportion(plan: DataFrame, budgets: DataFrame) -> DataFrame:
    """(group, key, copies) with `allotted`: as planned if a group's sum keeps to its budget, else by largest remainders.

    Each class gets the whole part of its share; what is left goes, one by one, to the
    largest fractions, ties to the smaller key. A group's classes are spread over many
    tasks. The plan with its budgets, a row for each class that wants copies, is written
    once: numbering sorts it, and each sum reads it again.
    """
    rows = storage.materialised(plan.join(budgets, "group"), "plan")
    rows = rows.join(rows.groupBy("group").agg(F.sum("copies").alias("_total")), "group")
    # whole numbers throughout: copies * budget = whole * total + rest
    rows = rows.withColumn("_whole", F.expr("copies * budget div _total")).withColumn("_rest", F.expr("copies * budget % _total"))
    rows = numbered_within(rows, "group", [F.desc("_rest"), "key"], "_place")
    rows = rows.join(rows.groupBy("group").agg(F.sum("_whole").alias("_given")), "group").withColumn("_left", F.col("budget") - F.col("_given"))
    share = F.col("_whole") + (F.col("_place") < F.col("_left")).cast("long")
    return rows.withColumn("allotted", F.when(F.col("_total") <= F.col("budget"), F.col("copies")).otherwise(share)).drop("_total", "_whole", "_rest", "_left", "_place", "_given")


def budgets(rows: DataFrame, ratio: float) -> DataFrame:
    """(group, budget): the whole part of ratio times a kingdom's rows."""
    named = rows.groupBy(F.coalesce("kingdom", F.lit(UNKNOWN)).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return named.select("group", F.floor(F.lit(ratio) * F.col("n")).cast("long").alias("budget"))


def distribute(members: DataFrame) -> DataFrame:
    """(key, seq_hash, size, allotted) with `copies` of each member: an even share, the remainder to the first hashes."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq_hash"))
    return members.withColumn("copies", F.expr("allotted div size") + (place <= F.expr("allotted % size")).cast("long")).where("copies > 0")


def named(train: DataFrame, rank: str, *more: str) -> DataFrame:
    """(more, group, key) of each row: its kingdom or unknown, and its class."""
    rows = train.select(*more, F.coalesce("kingdom", F.lit(UNKNOWN)).alias("group"), balancing_key(rank).alias("_key"))
    return rows.select(*more, "group", F.concat_ws("|", "group", "_key").alias("key"))


def allotted(members: DataFrame, config: Oversampling) -> tuple[DataFrame, DataFrame]:
    """Of rows with group and key: the classes' sizes, written, and what the classes get; budgets are sums of sizes."""
    sizes = storage.materialised(members.groupBy("group", "key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    budget = sizes.groupBy("group").agg(F.floor(F.lit(config.max_ratio) * F.sum("size")).cast("long").alias("budget"))
    return sizes, apportion(plan_copies(sizes, config.floor, config.max_copies), budget)


def planned(train: DataFrame, config: Oversampling = Oversampling()) -> DataFrame:
    """(seq_hash, key, group, size, allotted, copies) of the rows that get copies.

    The plan is made of one row for each class; rows meet it again by their class, and
    only those of small classes do. Hashes and classes of the rows are written once, so
    what `train` comes from is computed once.
    """
    members = storage.materialised(named(train, config.rank, "seq_hash"), "members")
    _, plan = allotted(members, config)
    return distribute(members.join(plan.where("allotted > 0").drop("copies", "budget"), ["group", "key"]))


# Mutations


def mutate(sequence: str, config: Mutation, rng: random.Random) -> str:
    """Substitutions at distinct places, each to another base; then deletions and insertions at distinct places, from the right, a deletion before an insertion."""
    bases = list(sequence)
    n = len(bases)
    for at in rng.sample(range(n), rng.binomialvariate(n, config.substitution)):
        bases[at] = rng.choice([b for b in "ACGT" if b != bases[at]])
    gone = {*rng.sample(range(n), rng.binomialvariate(n, config.deletion))}
    new = {at: rng.choice("ACGT") for at in rng.sample(range(n), rng.binomialvariate(n, config.insertion))}
    for at in sorted(gone | new.keys(), reverse=True):
        bases[at : at + 1] = ([new[at]] if at in new else []) + ([] if at in gone else [bases[at]])
    return "".join(bases)


def crop(sequence: str, low: int, high: int, rng: random.Random) -> str:
    """A window of random length at a random place; shorter sequences stay."""
    length = rng.randint(low, high)
    if len(sequence) <= length:
        return sequence
    at = rng.randint(0, len(sequence) - length)
    return sequence[at : at + length]


def augment(sequence: str, config: Mutation, rng: random.Random) -> str:
    """Crop, mutate, turn round, each with its chance."""
    if rng.random() < config.crop_probability:
        sequence = crop(sequence, config.crop_min, config.crop_max, rng)
    sequence = mutate(sequence, config, rng) or sequence[:1]
    if rng.random() < config.reverse_complement:
        from ..functions.schema import COMPLEMENTS, NUCLEOTIDES

        sequence = sequence.translate(str.maketrans(NUCLEOTIDES, COMPLEMENTS))[::-1]
    return sequence


def copy_of(sequence: str, parent: bytes, copy: int, config: Oversampling) -> str:
    """The copy of that number, always the same, never the sequence itself."""
    out = augment(sequence, config.mutation, random.Random(copy_seed(parent, copy, config.seed)))
    return out if out != sequence else ("C" if sequence[0] == "A" else "A") + sequence[1:]


def parents(dataset: DataFrame, plan: DataFrame) -> DataFrame:
    """The training rows that get copies."""
    return dataset.where("split = 'train'").join(plan.select("seq_hash"), "seq_hash", "left_semi")


def fresh(made: DataFrame, dataset: DataFrame) -> DataFrame:
    """(seq_hash, parent_seq_hash, _copy, ...) that equal no row of the dataset; of equal ones the first by parent and number."""
    first = Window.partitionBy("seq_hash").orderBy("parent_seq_hash", "_copy")
    return made.join(dataset.select("seq_hash"), "seq_hash", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def synthesised(dataset: DataFrame, plan: DataFrame, config: Oversampling = Oversampling()) -> DataFrame:
    """Synthetic rows in the dataset's columns, parent_seq_hash and synthetic.

    Copies come from a hash of parent and number, so a lost task makes them again just
    so. A copy equal to any real sequence, of whatever split, is left out, and of equal
    copies the first by parent and number stays.
    """
    numbered = parents(dataset, plan).join(plan.select("seq_hash", "copies"), "seq_hash")
    numbered = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).drop("copies")
    schema = T.StructType([*numbered.schema, T.StructField("_made", T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            made = [copy_of(s, bytes(h), c, config) for s, h, c in zip(batch.column(at("sequence")).to_pylist(), batch.column(at("seq_hash")).to_pylist(), batch.column(at("_copy")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema.names)

    made = numbered.mapInArrow(run, schema)
    made = made.withColumn("parent_seq_hash", F.col("seq_hash")).withColumn("sequence", F.col("_made")).withColumn("seq_hash", sequence_hash("_made"))
    own = {"length": F.length("sequence").cast("int"), "n_ambiguous": count_ambiguous("sequence").cast("int"), "n_records": F.lit(1).cast("int")}
    return fresh(made, dataset).select(*(own.get(c, F.col(f"`{c}`")).alias(c) for c in dataset.columns), "parent_seq_hash", F.lit(True).alias("synthetic"))


def training_frame(dataset: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real training rows and synthetic ones."""
    real = dataset.where("split = 'train'").withColumn("parent_seq_hash", F.lit(None).cast("binary")).withColumn("synthetic", F.lit(False))
    return real.unionByName(synthetic)


def planned_frame(dataset: DataFrame, plan: DataFrame) -> DataFrame:
    """T11 as planned: real training rows, and each parent's row once for each copy that it is to get, also for copies that `fresh` leaves out."""
    train = dataset.where("split = 'train'")
    copies = train.join(plan.select("seq_hash", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")), "seq_hash").drop("_copy")
    return train.withColumn("synthetic", F.lit(False)).unionByName(copies.withColumn("synthetic", F.lit(True)))


def report(train: DataFrame, config: Oversampling = Oversampling(), n_synthetic: int | None = None) -> DataFrame:
    """(n_real, n_planned, ratio, n_classes, below_floor_before, below_floor_after); with n_synthetic also the collisions."""
    sizes, plan = allotted(named(train, config.rank), config)
    both = sizes.join(plan.select("key", "allotted"), "key", "left").withColumn("allotted", F.coalesce("allotted", F.lit(0)))
    out = both.agg(
        F.sum("size").alias("n_real"),
        F.sum("allotted").alias("n_planned"),
        F.round(F.sum("allotted") / F.sum("size"), 4).alias("ratio"),
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("size") < config.floor).alias("below_floor_before"),
        F.count_if(F.col("size") + F.col("allotted") < config.floor).alias("below_floor_after"),
    )
    return out if n_synthetic is None else out.withColumn("collisions", F.col("n_planned") - n_synthetic)
