"""What is shuffled, sorted and sent by the queries over the merged records."""

import itertools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from cladewise.functions import storage
from cladewise.functions.schema import LEVELS, RANKS
from cladewise.operators import labels, merge, oversampling, parsers, training
from cladewise.plans import adapters, merge_queries, training_queries

from .oracle import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_not_broadcast(spark):
    """The parts' file is small, their sequences aren't."""
    told = plan(adapters.staged(spark, SF).select("sequence", "ordinal"))
    assert "SortMergeJoin [l_partkey" in told


def test_records_are_merged_once(spark):
    """G08 and all that split the merged rows: the split reads what was written."""
    told = plan(merge_queries.labelled(spark, SF))
    assert "lineitem" not in told and "sequence:" not in told


def test_records_carry_no_keys(spark):
    told = plan(merge.merged(adapters.staged(spark, SF)).select("seq_hash", "kingdom", "species"))
    assert "concat_ws(;" not in told


def test_records_are_merged_as_they_come(spark):
    """C06, T12, T10 and all over the merged rows: records sorted by their parts are not shuffled and sorted once more."""
    told = plan(merge_queries.merged(spark, SF).select("seq_hash", "kingdom", "species"))
    assert told.count("Exchange hashpartitioning") == 2 and told.count("Sort [") == 2


def test_another_key_of_the_same_groups(spark):
    rows = adapters.staged(spark, SF, "l_partkey")
    by_hash, by_part = merge.merged(rows), merge.merged(rows, key="l_partkey")
    assert by_hash.columns == by_part.columns
    assert by_hash.exceptAll(by_part).count() == by_part.exceptAll(by_hash).count() == 0


@pytest.mark.parametrize("query", [training_queries.t16, training_queries.t18])
def test_sequences_are_not_written(spark, monkeypatch, query):
    """Of the merged rows they want hashes only."""
    seen, write = [], storage.materialised
    monkeypatch.setattr(storage, "materialised", lambda df, name="table": seen.append(df.columns) or write(df, name))
    query(spark, SF)
    assert seen and not any({"sequence", "accessions"} & {*c} for c in seen)


def test_conflicts_by_names_and_gaps(spark):
    """Each pair of lineages of names, empty names and nulls, against keys in Python."""
    lineages = [(a, b, c) for a in ("x", "y") for b in (None, "", "p", "q") for c in (None, "s", "t")]
    rows = []
    for n, pair in enumerate(itertools.product(lineages, repeat=2)):
        for k, (domain, phylum, genus) in enumerate(pair):
            names = {r: None for r in RANKS} | {"domain": domain, "phylum": phylum, "genus": genus}
            rows.append((f"{n:04}", "ACGT", 4, 0, "s", f"{k}", "Fungi", *(names[r] for r in RANKS)))
    frame = spark.createDataFrame(rows, "seq_hash string, sequence string, length int, n_ambiguous int, source string, accession string, kingdom string, " + ", ".join(f"`{r}` string" for r in RANKS))
    found = {r.seq_hash: r for r in merge.merged(frame).collect()}
    at = {r: 7 + i for i, r in enumerate(RANKS)}
    for n in range(len(rows) // 2):
        pair = rows[2 * n : 2 * n + 2]
        keys = {r: {";".join(x[at[u]] or "" for u in RANKS[: i + 1]) for x in pair if x[at[r]] is not None} for i, r in enumerate(RANKS)}
        cut = next((i for i, r in enumerate(RANKS) if len(keys[r]) > 1), len(RANKS))
        got = found.get(f"{n:04}")
        if cut == 0:
            assert got is None
            continue
        assert got.label_conflict == (cut < len(RANKS))
        for i, r in enumerate(RANKS):
            assert got[r] == (max((x[at[r]] for x in pair if x[at[r]] is not None), default=None) if i < cut else None)


def test_some_levels_alone_are_encoded(spark):
    """A join for each level asked for."""
    rows = merge_queries.labelled(spark, SF)
    coded = labels.encode(rows, labels.label_space(rows, 1), ["seq_hash"], ("class",))
    assert coded.columns == ["seq_hash", "y_class"] and len(LEVELS) > 1
    assert coded.where(F.col("y_class") < 0).count() == rows.where("class is null").count()


def test_planned_copies_count_also_if_equal(spark):
    """A row for each planned copy; of copies too short to differ `synthesised` keeps some."""
    rows = spark.createDataFrame([(bytes([k]), "ACGT", 4, 0, 1, "train") for k in range(3)], "seq_hash binary, sequence string, length int, n_ambiguous int, n_records int, split string")
    plan = rows.select("seq_hash", F.lit(40).cast("long").alias("copies"))
    assert oversampling.synthesised(rows, plan).count() < 120
    frame = oversampling.planned_frame(rows, plan)
    assert sorted(map(tuple, frame.groupBy("seq_hash", "synthetic").count().collect())) == sorted((bytes([k]), s, 40 if s else 1) for k in range(3) for s in (False, True))


@pytest.mark.parametrize("parser, pattern", [(parsers.midori, "_[0-9]+$"), (parsers.unite, "Incertae_sedis$")])
def test_names_are_made_once(spark, parser, pattern):
    """Each regular expression stands once in the plan."""
    rows = spark.range(1).select(F.col("id").alias("ordinal"), F.concat("id", F.lit(";")).alias("header"), F.lit("ACGT").alias("sequence"))
    assert parser(rows)._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1


def test_few_probabilities_at_a_time(monkeypatch):
    """Rows of a batch by the classes of all levels, none lost."""
    monkeypatch.setattr(training, "CELLS", 100)
    params = training.init(4, [10, 20], 3, 1)
    batch = pa.RecordBatch.from_pydict({"x": list(range(11))})
    parts = list(training.slices([batch, batch.slice(0, 0)], params, 2))
    assert [b.num_rows for b in parts] == [3, 3, 3, 2] and np.concatenate([b.column(0).to_numpy() for b in parts]).tolist() == list(range(11))
