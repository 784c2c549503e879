"""FASTA headers of each source as one set of columns.

Every parser maps rows of (header, sequence, ordinal) to: accession, sequence,
source_lineage (array of name and rank), candidates (array of kind and name, in the
order they are looked up), own (the record's own lineage, backbone sources only),
organism (for a species found later), kingdom, marker and exclusion. One step then
looks all of them up in the backbone.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.exprs import clean_name, cut_at, is_placeholder, normalize_sequence, prokaryote_kingdom, split_organism, strip, valid_sequence
from ..functions.schema import RANKS

TAXON = "struct<name:string,rank:string>"
CANDIDATE = "struct<kind:string,name:string>"
LINEAGE = "struct<" + ",".join(f"`{r}`:string" for r in RANKS) + ">"
#: Fixed values of the formats.
GTDB_TAGS = ("d__", "p__", "c__", "o__", "f__", "g__", "s__")
PR2_RANKS = ("domain", None, "phylum", None, "class", "order", "family", "genus", "species")
PR2_TARGET = ("18S_rRNA", "nucleus", "Eukaryota")
ORGANELLES = ("Chloroplast", "Mitochondria")
TAGS = {"k": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
EUKARYOTA = "Eukaryota"


def taxon(name: Column, rank: str | None) -> Column:
    return F.struct(name.alias("name"), F.lit(rank).cast("string").alias("rank")).cast(TAXON)


def wanted(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name")).cast(CANDIDATE)


def asked(species: Column, *names: Column) -> Column:
    """Candidates: the species first, then names; nulls and empty names go."""
    every = F.array(wanted("species", species), *(wanted("taxon", n) for n in names))
    return F.filter(every, lambda c: c["name"].isNotNull() & (c["name"] != ""))


def parsed(rows: DataFrame, source: str, marker: str, malformed: Column, accession: Column, lineage: Column, candidates: Column, domain: Column, *, exclusion: Column | None = None, own: Column | None = None, organism: Column | None = None, kingdom: Column | None = None) -> DataFrame:
    """The columns every parser gives. What comes first decides: the header, then the source's own exclusion, then the sequence."""
    none = F.lit(None).cast("string")
    sequence = normalize_sequence("sequence")
    reason = F.when(malformed, "malformed_header").when(none.isNotNull() if exclusion is None else exclusion.isNotNull(), none if exclusion is None else exclusion).when(~valid_sequence(sequence), "invalid_sequence")
    return rows.select(
        "ordinal",
        F.lit(source).alias("source"),
        accession.alias("accession"),
        sequence.alias("sequence"),
        lineage.cast(f"array<{TAXON}>").alias("source_lineage"),
        candidates.cast(f"array<{CANDIDATE}>").alias("candidates"),
        domain.alias("domain_name"),
        (F.lit(None) if own is None else own).cast(LINEAGE).alias("own"),
        (none if organism is None else organism).alias("organism"),
        (none if kingdom is None else kingdom).alias("own_kingdom"),
        F.lit(marker).alias("marker"),
        reason.alias("exclusion"),
    )


def gtdb(rows: DataFrame, marker: str = "ssu") -> DataFrame:
    """`accession d__..;p__..;..;s__.. [more]`; its own lineage is the backbone."""
    head = cut_at("header", " ")
    fields = F.split(cut_at(head["tail"], " [")["head"], ";")
    names = [F.nullif(strip(F.substring(F.try_element_at(fields, F.lit(i + 1)), 4, 1 << 20)), F.lit("")) for i in range(7)]
    tags = F.lit(True)
    for i, tag in enumerate(GTDB_TAGS):
        tags = tags & F.coalesce(F.try_element_at(fields, F.lit(i + 1)).startswith(tag), F.lit(False))
    malformed = ~head["found"] | (F.size(fields) != 7) | ~tags | names[0].isNull()
    lineage = F.filter(F.array(*(taxon(n, r) for n, r in zip(names, RANKS))), lambda t: t["name"].isNotNull())
    own = F.struct(*(n.alias(r) for n, r in zip(names, RANKS)))
    return parsed(rows, "gtdb", marker, malformed, head["head"], lineage, F.array().cast(f"array<{CANDIDATE}>"), names[0], own=own, kingdom=prokaryote_kingdom(names[0]))


def pr2(rows: DataFrame, marker: str = "ssu") -> DataFrame:
    """4 fields and 9 names between bars; only nuclear 18S of eukaryotes."""
    fields = F.split("header", r"\|")
    at = lambda i: F.try_element_at(fields, F.lit(i + 1))
    target = F.struct(at(1), at(2), at(4)).eqNullSafe(F.struct(*map(F.lit, PR2_TARGET)))
    lineage = F.filter(F.array(*(taxon(at(4 + i), r) for i, r in enumerate(PR2_RANKS))), lambda t: t["name"] != "")
    names = [clean_name(at(4 + i)) for i in range(7, 0, -1)]
    return parsed(rows, "pr2", marker, F.size(fields) != 13, at(0), lineage, asked(clean_name(at(12), species=True), *names), at(4), exclusion=F.when(~target, "off_target"))


def refseq(rows: DataFrame, domain: str, locus: str, marker: str = "ssu") -> DataFrame:
    """`accession organism <locus> ribosomal RNA ...`."""
    head = cut_at("header", " ")
    organism = F.regexp_extract(head["tail"], rf"(?s)^(.*?) {locus} (?:ribosomal RNA|rRNA)(?U:\b)", 1)
    name = split_organism(organism)
    lineage = F.array(taxon(F.lit(domain), "domain"), taxon(organism, None))
    return parsed(rows, "refseq", marker, strip(organism) == "", head["head"], lineage, asked(name["species"], name["genus"]), F.lit(domain), kingdom=prokaryote_kingdom(F.lit(domain)))


def genbank(rows: DataFrame, marker: str, domain: str = EUKARYOTA) -> DataFrame:
    """`accession [UNVERIFIED: ]organism ...`."""
    head = cut_at("header", " ")
    organism = strip(F.regexp_replace(head["tail"], "^UNVERIFIED: ", ""))
    name = split_organism(organism)
    lineage = F.array(taxon(F.lit(domain), "domain"), taxon(organism, None))
    return parsed(rows, "genbank", marker, (head["head"] == "") | (organism == ""), head["head"], lineage, asked(name["species"], name["genus"]), F.lit(domain))


def eukribo(rows: DataFrame, marker: str = "ssu") -> DataFrame:
    """`accession Eukaryota|clade|...|g:Genus|Genus+epithet`."""
    head = cut_at("header", " ")
    fields = F.split(head["tail"], r"\|")
    clades = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))
    first = lambda x: F.try_element_at(x, F.lit(1))
    genus = F.regexp_replace(first(F.filter(clades, lambda c: c.startswith("g:"))), "^g:", "")
    name = split_organism(F.coalesce(F.replace(first(F.filter(clades, lambda c: c.contains("+"))), F.lit("+"), F.lit(" ")), F.lit("")))
    plain = F.transform(F.filter(F.reverse(clades), lambda c: c.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$")), lambda c: wanted("taxon", c))
    lineage = F.concat(F.array(taxon(F.lit(EUKARYOTA), "domain")), F.transform(clades, lambda c: taxon(c, None)))
    malformed = ~head["found"] | (first(fields) != EUKARYOTA)
    return parsed(rows, "eukribo", marker, malformed, head["head"], lineage, F.concat(asked(name["species"], genus, name["genus"]), plain), F.lit(EUKARYOTA))


def silva(rows: DataFrame, marker: str = "ssu") -> DataFrame:
    """`accession.start.end taxon;...;organism`; organelles are left out."""
    head = cut_at("header", " ")
    fields = F.split(head["tail"], ";")
    taxa = F.slice(fields, F.lit(1), F.size(fields) - 1)
    below = F.slice(taxa, F.lit(2), F.greatest(F.size(taxa) - 1, F.lit(0)))
    malformed = ~head["found"] | ~head["head"].rlike(r"^.+\.[0-9]+\.[0-9]+$") | (F.size(taxa) < 1) | F.exists(taxa, lambda t: strip(t) == "")
    organelle = F.when(F.arrays_overlap(taxa, F.array(*map(F.lit, ORGANELLES))), "organelle")
    domain = F.try_element_at(taxa, F.lit(1))
    candidates = F.transform(F.filter(F.reverse(below), lambda t: ~is_placeholder(t)), lambda t: wanted("taxon", t))
    lineage = F.concat(F.array(taxon(domain, "domain")), F.transform(below, lambda t: taxon(t, None)))
    return parsed(rows, "silva", marker, malformed, head["head"], lineage, candidates, domain, exclusion=organelle, organism=F.try_element_at(fields, F.lit(-1)), kingdom=prokaryote_kingdom(domain))


def ranked(rows: DataFrame, named: Column, tags: dict[str, str]) -> tuple[DataFrame, dict[str, Column], Column]:
    """rows with `named`, (tag, name) in order, as a column and each rank's last name as another; these names, and (name, rank) of the ranks in the order of their first places.

    Columns of their own, for Spark works out an expression again at each place within
    lambdas that names it.
    """
    rows = rows.withColumn("_named", F.filter(named, lambda f: f["tag"].isin(*tags)))
    of = lambda tag: F.try_element_at(F.filter("_named", lambda f: f["tag"] == tag), F.lit(-1))["name"]
    rows = rows.withColumns({f"_{rank}": of(tag) for tag, rank in tags.items()})
    names = {rank: F.col(f"_{rank}") for rank in tags.values()}
    value = lambda t: F.coalesce(*(F.when(t == tag, names[rank]) for tag, rank in tags.items()))
    rank = lambda t: F.coalesce(*(F.when(t == tag, F.lit(r)) for tag, r in tags.items()))
    firsts = F.array_distinct(F.transform("_named", lambda f: f["tag"]))
    return rows, names, F.transform(firsts, lambda t: F.struct(value(t).alias("name"), rank(t).alias("rank")))


def midori(rows: DataFrame, marker: str = "coi") -> DataFrame:
    """`accession;tax=k:Domain_id,p:...,s:...;`."""
    rows = rows.withColumn("_cut", cut_at(F.regexp_replace("header", ";+$", ""), ";tax="))
    head = F.col("_cut")
    fields = F.transform(F.split(head["tail"], ",(?=[kpcofgs]:)"), lambda f: cut_at(f, ":"))
    values = F.transform(fields, lambda f: F.struct(f["head"].alias("tag"), strip(F.regexp_replace(f["tail"], "_[0-9]+$", "")).alias("name")))
    named = F.filter(values, lambda f: (f["name"] != "") & ~f["name"].rlike("^(phylum|class|order|family|genus)_"))
    rows, names, lineage = ranked(rows, named, TAGS)
    species = split_organism(F.coalesce(names["species"], F.lit("")))["species"]
    malformed = ~head["found"] | (head["head"] == "") | names["domain"].isNull()
    return parsed(rows, "midori2", marker, malformed, head["head"], lineage, asked(species, *(names[r] for r in ("genus", "family", "order", "class", "phylum"))), names["domain"])


def unite(rows: DataFrame, marker: str = "its") -> DataFrame:
    """`name|accession|SH|type|k__..;p__..;..;s__..`."""
    rows = rows.withColumn("_parts", F.split("header", r"\|"))
    parts = F.col("_parts")
    fields = F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("")), ";"), lambda f: cut_at(f, "__"))
    good = F.filter(fields, lambda f: (f["tail"] != "") & ~f["tail"].rlike("_(kgd|phy|cls|ord|fam|gen)_Incertae_sedis$"))
    named = F.transform(good, lambda f: F.struct(f["head"].alias("tag"), F.when(f["head"] == "s", F.replace(f["tail"], F.lit("_"), F.lit(" "))).otherwise(f["tail"]).alias("name")))
    rows, names, lineage = ranked(rows, named, {t: r for t, r in TAGS.items() if t != "k"})
    organism = F.coalesce(names["species"], F.lit(""))
    species = F.when(~organism.endswith(" sp"), split_organism(organism)["species"])
    lineage = F.concat(F.array(taxon(F.lit(EUKARYOTA), "domain")), lineage)
    accession = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return parsed(rows, "unite", marker, (F.size(parts) != 5) | (accession == ""), accession, lineage, asked(species, *(names[r] for r in ("genus", "family", "order", "class", "phylum"))), F.lit(EUKARYOTA))


PARSERS: dict[str, Callable[..., DataFrame]] = {"gtdb": gtdb, "pr2": pr2, "refseq": refseq, "eukribo": eukribo, "silva": silva, "midori2": midori, "unite": unite, "genbank": genbank}
