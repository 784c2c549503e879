"""The commands' plans: download, build, augment, cache."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import storage
from ..functions.schema import RANKS, Filters, Oversampling, Split
from ..operators import backbone, batches, labels, merge, oversampling, parsers, reports, split, staging
from ..sources import bank, remote
from ..sources.fasta import DataError, read_fasta, read_fasta_member
from ..sources.taxdump import read_dump


@dataclass(frozen=True)
class Layout:
    """Where everything lies under one folder."""

    top: str

    def raw(self, source: remote.Source) -> Path:
        return Path(self.top) / "raw" / source.slug

    def staged(self, slug: str) -> str:
        return f"{self.top}/interim/{slug}"

    @property
    def dataset(self) -> str:
        return f"{self.top}/processed/dataset"

    @property
    def synthetic(self) -> str:
        return f"{self.top}/processed/train_synthetic"

    @property
    def tokens(self) -> str:
        return f"{self.top}/processed/tokens"

    def report(self, name: str) -> str:
        return f"{self.top}/processed/{name}.json"


@dataclass(frozen=True)
class Build:
    sources: Sequence[remote.Source]
    taxonomy: remote.Source | None
    filters: Filters = field(default_factory=Filters)
    split: Split = field(default_factory=Split)
    rows_a_file: int = 1_000_000


def download(layout: Layout, sources: Sequence[remote.Source], opener: remote.Opener = remote.https) -> None:
    for s in sources:
        for wanted, _ in s.inputs:
            fetch = remote.fetch if isinstance(wanted, remote.PagedQuery) else remote.download
            fetch(wanted, layout.raw(s), opener)


def need_files(layout: Layout, sources: Sequence[remote.Source]) -> None:
    """A12"""
    lacking = [str(p) for s in sources for p in (layout.raw(s) / i.filename for i, _ in s.inputs) if not p.exists()]
    if lacking:
        raise DataError("missing: " + ", ".join(lacking))


def parsed(spark: SparkSession, layout: Layout, source: remote.Source) -> DataFrame:
    frames = []
    for wanted, told in source.inputs:
        path = layout.raw(source) / wanted.filename
        rows = read_fasta_member(spark, str(path), source.member) if source.member else read_fasta(spark, str(path))
        frames.append(parsers.PARSERS[source.parser](rows, **dict(told)).withColumn("ordinal", F.struct(F.lit(len(frames)).alias("file"), F.col("ordinal.part").alias("part"), F.col("ordinal.at").alias("at"))))
    return staging.union_all(frames)


def stage(spark: SparkSession, layout: Layout, config: Build, sources: Sequence[remote.Source], entries: DataFrame) -> dict[str, dict[str, int]]:
    """Each source's records through the backbone and the filters into Parquet; what was read and left out, by source."""
    told = {}
    for s in sources:
        rows = staging.filtered(backbone.harmonise(parsed(spark, layout, s), entries), config.filters)
        # counted once parsed: the counts come from what parsing wrote, not from parsing again
        path = f"{layout.staged(s.slug)}-all"
        storage.write_parquet(rows, path, config.rows_a_file)
        held = spark.read.parquet(path)
        storage.write_parquet(staging.staged(held), layout.staged(s.slug), config.rows_a_file)
        counted = staging.counts(held).drop("source").first()
        told[s.slug] = counted.asDict() if counted else {}
    return told


@storage.cleaning
def build(spark: SparkSession, layout: Layout, config: Build) -> dict:
    """Raw files to the dataset: the taxonomy, backbone sources, then the others; then one merge and split.

    The backbone is written before the others look names up in it: whether a name is
    unique in its domain takes all of it.
    """
    sources = list(config.sources)
    need_files(layout, sources + ([config.taxonomy] if config.taxonomy else []))
    entries = []
    n_taxa = 0
    if config.taxonomy:
        taxa = read_dump(spark, str(layout.raw(config.taxonomy) / config.taxonomy.inputs[0][0].filename))
        n_taxa = storage.write_parquet(backbone.entries_of_lineages(taxa), f"{layout.top}/interim/taxonomy")
        entries.append(spark.read.parquet(f"{layout.top}/interim/taxonomy"))
    empty = spark.createDataFrame([], "kind string, name string, lineage " + parsers.LINEAGE + ", kingdom string")
    told = {}
    for s in (x for x in sources if x.backbone):
        told |= stage(spark, layout, config, [s], staging.union_all([empty, *entries]))
        # only records that passed the filters feed the backbone
        own = spark.read.parquet(f"{layout.staged(s.slug)}-all").where("exclusion is null")
        storage.write_parquet(backbone.entries_of_records(own), f"{layout.top}/interim/{s.slug}-backbone")
        entries.append(spark.read.parquet(f"{layout.top}/interim/{s.slug}-backbone"))
    told |= stage(spark, layout, config, [x for x in sources if not x.backbone], staging.union_all([empty, *entries]))
    rows = staging.union_all([spark.read.parquet(layout.staged(s.slug)).withColumn("source_ordinal", F.lit(i)) for i, s in enumerate(sources)])
    merged_path = f"{layout.top}/interim/merged"
    storage.write_parquet(merge.merged(rows), merged_path, config.rows_a_file)
    merged = spark.read.parquet(merged_path)
    storage.write_parquet(split.with_split(merged, config.split), layout.dataset, config.rows_a_file, sort=["seq_hash"])
    dataset = spark.read.parquet(layout.dataset)
    counts = lambda df, key: {r[key]: r["n"] for r in df.collect()}  # noqa: E731  a row for each split, kingdom, marker or rank
    report = {
        "taxa": n_taxa,
        "sources": told,
        "merge": merge.merge_report(rows, merged).first().asDict(),
        "splits": counts(reports.split_counts(dataset), "split"),
        "kingdoms": counts(reports.kingdom_counts(dataset), "kingdom"),
        "markers": counts(reports.marker_counts(dataset), "marker"),
        "ranks": counts(reports.rank_coverage(dataset), "rank"),
    }
    storage.write_json(layout.report("build_report"), report)
    return report


def need_dataset(layout: Layout, *paths: str) -> None:
    lacking = [p for p in (layout.dataset, *paths) if not Path(p).exists()]
    if lacking:
        raise DataError("missing: " + ", ".join(lacking))


@storage.cleaning
def augment(spark: SparkSession, layout: Layout, config: Oversampling) -> dict:
    """The dataset's synthetic training rows and their report."""
    need_dataset(layout)
    dataset = spark.read.parquet(layout.dataset)
    train = dataset.where("split = 'train'")
    made = oversampling.synthesised(dataset, oversampling.planned(train, config), config)
    n = storage.write_parquet(made, layout.synthetic, sort=["seq_hash"])
    report = oversampling.report(train, config, n).first().asDict() | {"n_synthetic": n}
    report["kingdoms"] = {r["kingdom"]: r["n"] for r in reports.by_kingdom(spark.read.parquet(layout.synthetic)).collect()}
    storage.write_json(layout.report("augment_report"), report)
    return report


def load_training(spark: SparkSession, layout: Layout, min_count: int = 3, samples: int | None = None, seed: int = 20260923) -> dict[str, DataFrame]:
    """Label space (from real rows), training rows with targets and frequencies, validation rows with targets; marker where the dataset has one."""
    need_dataset(layout, layout.synthetic)
    dataset = spark.read.parquet(layout.dataset)
    frame = oversampling.training_frame(dataset, spark.read.parquet(layout.synthetic))
    space = labels.label_space(frame.where("not synthetic"), min_count)
    extra = ["marker"] if "marker" in dataset.columns else []
    train = labels.encode(batches.class_frequencies(frame), space, ["seq_hash", "sequence", "length", "frequency"])
    held = dataset.where("split = 'val'")
    held = held if samples is None else batches.validation_subset(held, samples, seed)
    return {"space": space, "train": train, "validation": labels.encode(held, space, ["seq_hash", "sequence", "length", *extra])}


@storage.cleaning
def cache(spark: SparkSession, layout: Layout, min_count: int = 3) -> dict[str, int]:
    """Label space and token banks, unless those there are of the same rows in order.

    A bank is a table, NAME, and flat files read by position, NAME.bank, with the targets;
    the files are checked on disk before the bank counts as there.
    """
    data = load_training(spark, layout, min_count)
    storage.write_text(layout.report("label_space"), labels.to_json(data["space"], min_count))
    out = {}
    for name in ("train", "validation"):
        # an order-free sum of hashes tells whether the rows are the same ones; order is by hash
        told = data[name].agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("seq_hash", *(c for c in data[name].columns if c.startswith("y_"))).cast("decimal(38,0)")).alias("s")).first()
        mark, path, flat = f"{told.n}:{told.s}", f"{layout.tokens}/{name}", f"{layout.tokens}/{name}.bank"
        manifest = Path(f"{path}.json")
        if not (manifest.exists() and manifest.read_text().strip() == f'"{mark}"' and Path(path).exists() and Path(flat).exists()):
            storage.write_parquet(batches.token_bank(data[name], ["seq_hash"]).drop("sequence"), path)
            bank.write_bank(data[name], flat, ["seq_hash"], [c for c in data[name].columns if c.startswith("y_")])
            if not bank.bank_check(spark, flat).first().whole:
                raise DataError(f"{flat} is not whole on disk")
            storage.write_json(manifest, mark)
        out[name] = told.n
    return out


__all__ = ["RANKS", "Build", "Layout", "augment", "build", "cache", "download", "load_training"]
