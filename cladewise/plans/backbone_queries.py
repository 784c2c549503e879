"""J: the backbone over the staged adapter's lineages."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions.exprs import lineage_key, split_organism
from ..functions.schema import RANKS
from ..operators import backbone
from .adapters import STAGED_SQL, q, read, staged
from .catalog import query

NAMES = ", ".join(q(r) for r in RANKS)
KEY = " || ';' || ".join(f"coalesce('+' || {q(r)}, '-')" for r in RANKS)
DEEPEST = "coalesce(" + ", ".join(q(r) for r in reversed(RANKS)) + ")"
TAXA_SQL = f"SELECT DISTINCT {NAMES}, kingdom FROM ({STAGED_SQL})"
ENTRIES_SQL = f"SELECT CASE WHEN species IS NOT NULL THEN 'species' ELSE 'taxon' END AS kind, {DEEPEST} AS name, domain, {KEY} AS lineage_key, kingdom FROM ({TAXA_SQL}) WHERE coalesce(" + ", ".join(q(r) for r in RANKS[1:]) + ") IS NOT NULL"
UNIQUE_SQL = f"SELECT kind, name, domain, any_value(lineage_key) AS lineage_key FROM ({ENTRIES_SQL}) GROUP BY 1, 2, 3 HAVING count(DISTINCT lineage_key) = 1"


def taxa(spark, sf):
    return staged(spark, sf).select(*(f"`{r}`" for r in RANKS), "kingdom").distinct()


def entries(spark, sf):
    return backbone.entries_of_lineages(taxa(spark, sf))


def told(df):
    return df.withColumn("lineage_key", backbone.key_of(F.col("lineage")))


@query("J01_add_records", f"SELECT DISTINCT CASE WHEN i = 6 THEN 'species' ELSE 'taxon' END AS kind, name, domain FROM (SELECT domain, unnest([{', '.join(q(r) for r in RANKS)}]) AS name, unnest(range(7)) AS i FROM (SELECT DISTINCT {NAMES} FROM ({STAGED_SQL}))) WHERE name IS NOT NULL")
def j01(spark, sf):
    named = F.array(*(F.struct(F.col(f"`{r}`").alias("name"), F.lit(r).alias("rank")) for r in RANKS))
    rows = staged(spark, sf).withColumn("source_lineage", F.filter(named, lambda t: t["name"].isNotNull()))
    return backbone.entries_of_records(rows).select("kind", "name", F.col("lineage.domain").alias("domain")).distinct()


@query("J02_add_lineages", ENTRIES_SQL)
def j02(spark, sf):
    return told(entries(spark, sf)).select("kind", "name", F.col("lineage.domain").alias("domain"), "lineage_key", "kingdom")


@query("J03_unique_in_domain", UNIQUE_SQL)
def j03(spark, sf):
    return told(backbone.unique_in_domain(entries(spark, sf))).select("kind", "name", "domain", "lineage_key")


ASKED = f"SELECT id, domain, unnest([{q('species')}, {q('genus')}, {q('class')}, {q('phylum')}]) AS name, unnest(['species', 'taxon', 'taxon', 'taxon']) AS kind, unnest([0, 1, 2, 3]) AS pos FROM (SELECT DISTINCT accession || '|' || {KEY} AS id, {NAMES} FROM ({STAGED_SQL}))"


@query("J04_first_match", f"SELECT id, domain, arg_min(lineage_key, pos) AS lineage_key FROM (SELECT a.id, a.domain, a.pos, u.lineage_key, {', '.join('a.' + c for c in ('name', 'kind'))} FROM ({ASKED}) a JOIN ({UNIQUE_SQL}) u ON a.kind = u.kind AND a.name = u.name AND a.domain = u.domain) GROUP BY id, domain")
def j04(spark, sf):
    rows = staged(spark, sf).select("accession", *(f"`{r}`" for r in RANKS)).distinct()
    wanted = F.array(*(F.struct(F.lit("species" if r == "species" else "taxon").alias("kind"), F.col(f"`{r}`").alias("name")) for r in ("species", "genus", "class", "phylum")))
    asked = rows.select(F.concat_ws("|", "accession", lineage_key()).alias("id"), F.col("domain").alias("domain_name"), wanted.alias("candidates"))
    found = backbone.first_match(asked, backbone.unique_in_domain(entries(spark, sf)), ["id", "domain_name"])
    return found.select("id", F.col("domain_name").alias("domain"), backbone.key_of(F.col("mapped")).alias("lineage_key"))


NARROW = f"SELECT DISTINCT accession || '|' || {KEY} AS id, {NAMES} FROM ({STAGED_SQL})"


@query("J05_species_first", f"WITH n AS ({NARROW}), u AS ({UNIQUE_SQL}) SELECT n.id, coalesce(s.lineage_key, g.lineage_key, coalesce('+' || n.domain, '-') || ';-;-;-;-;-;-') AS lineage_key FROM n LEFT JOIN u s ON s.kind = 'species' AND s.name = n.species AND s.domain = n.domain LEFT JOIN u g ON g.kind = 'taxon' AND g.name = n.genus AND g.domain = n.domain")
def j05(spark, sf):
    """Species, then genus, then the domain alone."""
    rows = staged(spark, sf).select("accession", *(f"`{r}`" for r in RANKS)).distinct()
    wanted = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(r).alias("name")) for kind, r in (("species", "species"), ("taxon", "genus"))))
    asked = rows.select(F.concat_ws("|", "accession", lineage_key()).alias("id"), F.col("domain").alias("domain_name"), wanted.alias("candidates"))
    found = backbone.located(asked, backbone.unique_in_domain(entries(spark, sf)), ["id"])
    return found.select("id", backbone.key_of(F.col("lineage")).alias("lineage_key"))


@query("J07_kingdom_of", f"SELECT lineage_key, any_value(kingdom) AS kingdom FROM ({ENTRIES_SQL}) WHERE kingdom IS NOT NULL GROUP BY 1 HAVING count(DISTINCT kingdom) = 1")
def j07(spark, sf):
    return backbone.kingdoms(entries(spark, sf))


@query("J08_backbone_size", f"SELECT count(*) AS n FROM (SELECT DISTINCT kind, name FROM ({ENTRIES_SQL}))")
def j08(spark, sf):
    return backbone.size(entries(spark, sf))


@query("J12_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j12(spark, sf):
    few = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(few, "o_custkey", "left_semi")


@query("J13_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J15_dictionary_join", "SELECT p_partkey, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey")
def j15(spark, sf):
    return read(spark, sf, "part").join(read(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey")).select("p_partkey", "n_name")


@query("S04_customers", "SELECT c_custkey AS k, coalesce(nullif(split_part(c_name, ' ', 1), ''), '') AS genus FROM customer")
def s04_customers(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), split_organism("c_name")["genus"].alias("genus"))
