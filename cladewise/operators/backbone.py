"""The taxonomic backbone, and records mapped onto it by joins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.exprs import lineage_key, split_organism, truncated
from ..functions.schema import RANKS


def lineage() -> Column:
    return F.struct(*(F.col(f"`{r}`").alias(r) for r in RANKS))


def entries_of_lineages(taxa: DataFrame) -> DataFrame:
    """(kind, name, lineage, kingdom) of (seven ranks, kingdom): each at its deepest rank; domains alone have none."""
    deepest = F.coalesce(*(F.when(F.nullif(F.col(f"`{r}`"), F.lit("")).isNotNull(), F.lit(r)) for r in reversed(RANKS)))
    name = F.coalesce(*(F.when(F.col("_deepest") == r, F.col(f"`{r}`")) for r in RANKS))
    kind = F.when(F.col("_deepest") == "species", "species").otherwise("taxon")
    return taxa.withColumn("_deepest", deepest).where("_deepest <> 'domain'").select(kind.alias("kind"), name.alias("name"), lineage().alias("lineage"), "kingdom")


def entries_of_records(records: DataFrame) -> DataFrame:
    """(kind, name, lineage, kingdom) of records with source_lineage, seven ranks and kingdom.

    Each taxon of a record is an entry: the species under the name in the lineage, with
    all of it; another canonical rank, if the lineage has a name there, with the lineage
    cut at it; a taxon without rank with the lineage cut at the last canonical rank
    before it. That rank counts even where the lineage has no name there.
    """
    number = F.array_position(F.array(*map(F.lit, RANKS)), F.col("t.rank")) - 1
    keyed = records.withColumn("_id", F.struct("accession", "source", "ordinal") if "ordinal" in records.columns else F.struct("accession", "source"))
    taxa = keyed.select("*", F.posexplode("source_lineage").alias("_pos", "t")).withColumn("_own", F.when(F.col("t.rank").isNotNull() & (F.col("t.rank") != "species"), number))
    last = Window.partitionBy("_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    taxa = taxa.withColumn("_depth", F.last("_own", ignorenulls=True).over(last))
    species = F.col("t.rank") == "species"
    names = {r: F.col(f"`{r}`") for r in RANKS}
    there = F.coalesce(*(F.when(F.col("_own") == i, names[r].isNotNull()) for i, r in enumerate(RANKS)), F.lit(True))
    cut = truncated(F.col("_depth"), names)
    rows = taxa.where(F.when(F.coalesce(species, F.lit(False)), F.col("species").isNotNull()).otherwise(F.col("_depth").isNotNull() & there))
    is_species = F.coalesce(species, F.lit(False))
    return rows.select(
        F.when(is_species, "species").otherwise("taxon").alias("kind"),
        F.when(is_species, F.col("species")).otherwise(F.col("t.name")).alias("name"),
        F.struct(*(F.when(is_species, names[r]).otherwise(cut[r]).alias(r) for r in RANKS)).alias("lineage"),
        "kingdom",
    ).distinct()


def size(entries: DataFrame) -> DataFrame:
    """The number of distinct names, of taxa and of species."""
    return entries.agg(F.count_distinct(F.struct("kind", "name")).alias("n"))


def key_of(lineage: Column) -> Column:
    """A lineage as one key."""
    return F.concat_ws(";", *(F.coalesce(F.concat(F.lit("+"), lineage[r]), F.lit("-")) for r in RANKS))


def unique_in_domain(entries: DataFrame) -> DataFrame:
    """(kind, name, domain, lineage) where a name has exactly one lineage in a domain."""
    key = key_of(F.col("lineage"))
    found = entries.groupBy("kind", "name", F.col("lineage.domain").alias("domain")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.first("lineage").alias("lineage"))
    return found.where("low = high").drop("low", "high")


def kingdoms(entries: DataFrame) -> DataFrame:
    """(lineage_key, kingdom) where a lineage was recorded with exactly one kingdom."""
    known = entries.where("kingdom is not null").groupBy(key_of(F.col("lineage")).alias("lineage_key")).agg(F.min("kingdom").alias("kingdom"), F.max("kingdom").alias("_high"))
    return known.where("kingdom = _high").drop("_high")


def first_match(rows: DataFrame, unique: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, mapped): the lineage of the first candidate of each row that the backbone knows in the row's domain.

    Rows of one domain and one list of candidates share their answer, so each distinct
    list is asked once: lists are told apart before the shuffle, so one that a third of
    the rows have is a row for each task. Each candidate meets its one entry (kind, name,
    domain); a list's choice is the least position that hit. Rows meet the answer by
    their list, the many rows of a hot one split by Spark's skew join. `ids` tell rows apart.
    """
    listed = rows.where(F.size("candidates") > 0).select("domain_name", "candidates").distinct()
    asked = listed.select("domain_name", "candidates", F.posexplode("candidates").alias("pos", "c")).select("candidates", F.col("domain_name").alias("domain"), "pos", F.col("c.kind").alias("kind"), F.col("c.name").alias("name"))
    hits = asked.join(unique, ["kind", "name", "domain"])
    told = hits.groupBy(F.col("domain").alias("domain_name"), "candidates").agg(F.min_by("lineage", "pos").alias("mapped"))
    return rows.select(*ids, "domain_name", "candidates").join(told, ["domain_name", "candidates"]).select(*ids, "mapped")


def located(rows: DataFrame, unique: DataFrame, ids: list[str]) -> DataFrame:
    """Rows with `lineage`: that of their first match, species before other candidates as they stand, else their domain alone."""
    alone = F.struct(F.col("domain_name").alias("domain"), *(F.lit(None).cast("string").alias(r) for r in RANKS[1:]))
    return rows.join(first_match(rows, unique, ids), ids, "left").withColumn("lineage", F.coalesce("mapped", alone)).drop("mapped")


def harmonise(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """Parsed rows with seven ranks and a kingdom: J04 to J07 in one set of joins for all sources.

    Rows with a lineage of their own keep it. For rows with an organism (SILVA), J06: a
    species is added if the mapped lineage has a genus and the species' unique lineage,
    cut at the genus, is that lineage.
    """
    unique = unique_in_domain(entries)
    rows = parsed.withColumn("_row", F.struct("source", "marker", "ordinal"))
    rows = located(rows.withColumn("candidates", F.when(F.col("exclusion").isNull(), F.col("candidates"))), unique, ["_row"])
    rows = rows.withColumn("lineage", F.coalesce("own", "lineage")).drop("own")
    name = F.when(F.col("lineage")["genus"].isNotNull(), split_organism(F.coalesce("organism", F.lit("")))["species"])
    rows = rows.withColumn("_species", name)
    species = unique.where("kind = 'species'").select(F.col("name").alias("_species"), F.col("domain").alias("_domain"), F.col("lineage").alias("_full"))
    rows = rows.join(species, (rows["_species"] == species["_species"]) & (F.col("lineage")["domain"] == F.col("_domain")), "left").drop("_species", "_domain")
    same = F.lit(True)
    for r in RANKS[:-1]:
        same = same & F.col("_full")[r].eqNullSafe(F.col("lineage")[r])
    rows = rows.withColumn("lineage", F.when(F.col("_full").isNotNull() & same & F.col("lineage")["species"].isNull(), F.col("_full")).otherwise(F.col("lineage"))).drop("_full")
    rows = rows.withColumn("lineage_key", key_of(F.col("lineage"))).join(kingdoms(entries), "lineage_key", "left").withColumn("kingdom", F.coalesce("own_kingdom", "kingdom"))
    return rows.select(*[c for c in parsed.columns if c not in ("own", "own_kingdom", "candidates", "organism", "domain_name")], *(F.col("lineage")[r].alias(r) for r in RANKS), "kingdom")


__all__ = ["entries_of_lineages", "entries_of_records", "first_match", "harmonise", "key_of", "kingdoms", "lineage_key", "located", "size", "unique_in_domain"]
