"""A taxonomy dump as rows of taxa with their lineages."""

from __future__ import annotations

import zipfile

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from ..functions.exprs import split_organism, truncated
from ..functions.schema import RANKS
from .ranges import DataError, LineReader, file_system, load, whole_lines

MEMBERS = ("nodes.dmp", "rankedlineage.dmp")
FIELDS = 10
#: The dump's field of each rank's name.
PLACES = {"genus": 3, "family": 4, "order": 5, "class": 6, "phylum": 7, "domain": 9}


class DumpReader(LineReader):
    def batches(self, span):
        stop = span.high if span.packed else span.stop - span.low
        for at, text in whole_lines(span):
            if at >= stop and not span.packed:
                return
            cut = 0 if span.packed else text.find(b"\n", max(stop - 1 - at, 0)) + 1
            lines = (text[:cut] if cut else text).decode("utf-8", "replace").removesuffix("\n").split("\n")
            fields = pa.array([x.removesuffix("\r").removesuffix("\t|").split("\t|\t") for x in lines], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([fields], ["f"])
            if cut:
                return


class DumpSource(DataSource):
    """spark.read.format("taxdump"): a row for each line, its fields in `f`; options as those of the FASTA source."""

    @classmethod
    def name(cls):
        return "taxdump"

    def schema(self):
        return "f array<string>"

    def reader(self, schema):
        return DumpReader(self.options)


def rows_of(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """Each line's fields, of a file or folder or of an archive's member."""
    return load(spark, DumpSource, [path], member)


def read_dump(spark: SparkSession, archive: str, domain: str = "Eukaryota") -> DataFrame:
    """read_taxa of a dump's zip archive, read where it is; an error names what it lacks."""
    system, inner = file_system(archive)
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as held:
        for member in MEMBERS:
            if member not in held.namelist():
                raise DataError(f"{archive} has no {member}")
    return _taxa(*(rows_of(spark, archive, m) for m in MEMBERS), domain)


def read_taxa(spark: SparkSession, nodes: str, lineages: str, domain: str = "Eukaryota") -> DataFrame:
    """(seven ranks, kingdom) of the domain's taxa at a canonical rank; species only if their name is a binomial."""
    return _taxa(rows_of(spark, nodes), rows_of(spark, lineages), domain)


def _taxa(nodes: DataFrame, lineages: DataFrame, domain: str) -> DataFrame:
    ranked = nodes.select(F.col("f")[0].alias("tax_id"), F.col("f")[2].alias("rank")).where(F.col("rank").isin(*RANKS[1:]))
    told = lineages.where((F.size("f") == FIELDS) & (F.try_element_at("f", F.lit(FIELDS)) == domain))
    joined = told.select(F.col("f")[0].alias("tax_id"), "f").join(ranked, "tax_id")
    name, rank = F.col("f")[1], F.col("rank")
    joined = joined.where((rank != "species") | (split_organism(name)["species"] == name))
    depth = F.array_position(F.array(*map(F.lit, RANKS)), rank) - 1
    own = {r: F.when(rank == r, name).otherwise(F.nullif(F.col("f")[PLACES[r]], F.lit("")) if r in PLACES else F.lit(None).cast("string")) for r in RANKS}
    kingdom = F.when(F.col("f")[8] == "Metazoa", "Animalia").when(F.col("f")[8] == "Fungi", "Fungi").when(F.col("f")[8] == "Viridiplantae", "Plantae").otherwise("Protista")
    return joined.select(*(c.alias(r) for r, c in truncated(depth, own).items()), kingdom.alias("kingdom"))
