"""Column functions: sequences, organisms, taxa, tokens, rates. All built-in expressions."""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column

from .schema import COMPLEMENTS, NUCLEOTIDES, RANKS

SPACE = r"(?U)[\s\x1c-\x1f]+"
UNNAMED = "(?i)uncultured|unidentified|metagenome|environmental|unknown|unclassified"
UNNAMED_EPITHETS = ("bacterium", "archaeon", "eukaryote")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# Sequences


def normalize_sequence(c: Column | str) -> Column:
    """No white space, upper case, U as T."""
    return F.translate(F.upper(F.regexp_replace(col(c), SPACE, "")), "U", "T")


def valid_sequence(c: Column | str) -> Column:
    """Whether a normalised sequence is one: not empty, IUPAC letters only."""
    return col(c).rlike(f"^[{NUCLEOTIDES}]+$")


def count_ambiguous(c: Column | str) -> Column:
    """Letters other than A, C, G and T."""
    return F.length(F.regexp_replace(col(c), "[ACGT]+", ""))


def reverse_complement(c: Column | str) -> Column:
    """S03"""
    return F.reverse(F.translate(col(c), NUCLEOTIDES, COMPLEMENTS))


def tokens(c: Column | str) -> Column:
    """1 to 4 for A, C, G and T, 5 for any other letter; a byte each."""
    known = F.translate(F.regexp_replace(col(c), "[^ACGT]", "N"), "ACGTN", "\x01\x02\x03\x04\x05")
    return F.encode(known, "ISO-8859-1")


def token_array(c: Column | str) -> Column:
    """Tokens as an array of numbers."""
    return F.transform(F.split(col(c), ""), lambda x: F.coalesce(F.nullif(F.instr(F.lit("ACGT"), x), F.lit(0)), F.lit(5)).cast("int"))


# Organisms


def split_organism(c: Column | str) -> Column:
    """struct(genus, species); species is null unless the name is a proper binomial."""
    words = F.filter(F.split(F.regexp_replace(strip(c), "^Candidatus ", ""), SPACE), lambda w: w != "")
    genus = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    epithet = F.try_element_at(words, F.lit(2))
    named = epithet.rlike("^[a-z][a-z-]+$") & ~epithet.isin(*UNNAMED_EPITHETS) & ~col(c).rlike(UNNAMED)
    return F.struct(genus.alias("genus"), F.when(named, F.concat_ws(" ", genus, epithet)).alias("species"))


def is_placeholder(c: Column | str) -> Column:
    """Names that SILVA gives in place of a taxon."""
    name = F.lower(strip(c))
    return (name == "incertae sedis") | name.startswith("uncultured") | name.startswith("unidentified") | name.endswith("--other")


def clean_name(c: Column | str, species: bool = False) -> Column:
    """A PR2 name; null for placeholders and, for species, for unnamed ones."""
    name = strip(c)
    good = (name != "") & ~name.rlike("_X+$")
    if species:
        return F.when(good & ~name.contains("_sp."), F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(good, name)


def cut_at(c: Column | str, separator: str) -> Column:
    """struct(head, found, tail) at the first separator."""
    at = F.instr(col(c), F.lit(separator))
    head = F.when(at > 0, F.substring(col(c), F.lit(1), at - 1)).otherwise(col(c))
    tail = F.when(at > 0, F.substring(col(c), at + len(separator), F.length(col(c)))).otherwise(F.lit(""))
    return F.struct(head.alias("head"), (at > 0).alias("found"), tail.alias("tail"))


def tagged(fields: Column, name, tag: str) -> Column:
    """The value of the last field with a tag whose name isn't null."""
    kept = F.filter(F.transform(fields, lambda f: F.struct(f["head"].alias("tag"), name(f).alias("name"))), lambda f: (f["tag"] == tag) & f["name"].isNotNull())
    return F.try_element_at(kept, F.lit(-1))["name"]


# Taxa


def taxon_key(rank: str) -> Column:
    """The names down to a rank, joined by ';', empty where null; null if the rank's own name is."""
    upto = RANKS[: RANKS.index(rank) + 1]
    return F.when(F.col(f"`{rank}`").isNotNull(), F.concat_ws(";", *(F.coalesce(F.col(f"`{r}`"), F.lit("")) for r in upto)))


def level_key(level: str) -> Column:
    return F.col("kingdom") if level == "kingdom" else taxon_key(level)


def balancing_key(rank: str = "genus") -> Column:
    """The key of the deepest named rank down to `rank`; an error if there is none."""
    upto = RANKS[: RANKS.index(rank) + 1]
    return F.coalesce(*map(taxon_key, reversed(upto)), F.raise_error(F.lit("a row has no name at any rank")).cast("string"))


def lineage_key(prefix: str = "") -> Column:
    """All seven names; nulls told apart from empty names."""
    return F.concat_ws(";", *(F.coalesce(F.concat(F.lit("+"), F.col(f"`{prefix}{r}`")), F.lit("-")) for r in RANKS))


def deepest_rank() -> Column:
    """The last rank with a name that isn't empty."""
    return F.coalesce(*(F.when(F.nullif(F.col(f"`{r}`"), F.lit("")).isNotNull(), F.lit(r)) for r in reversed(RANKS)))


def truncated(depth: Column, names: dict[str, Column]) -> dict[str, Column]:
    """Names down to the rank of number `depth` (domain: 0), null below."""
    return {r: F.when(F.lit(i) <= depth, names[r]) for i, r in enumerate(RANKS)}


def prokaryote_kingdom(domain: Column | str) -> Column:
    """S11"""
    return F.when(col(domain).isin("Bacteria", "Archaea"), col(domain))


# Rates and weights


def level_accuracy(hits: Column | str, known: Column | str) -> Column:
    """Hits over known; NaN without any known."""
    return F.when(col(known) == 0, F.lit(float("nan"))).otherwise(col(hits) / col(known))


def learning_rate_factor(step: Column | str, total: int, warmup: int) -> Column:
    """A linear rise over the warm-up, then half a cosine down to zero."""
    past = (col(step) - warmup) / max(1, total - warmup)
    return F.when(col(step) < warmup, (col(step) + 1) / max(1, warmup)).otherwise(0.5 * (1 + F.cos(math.pi * F.least(F.lit(1.0), past))))


def raw_weight(frequency: Column | str, power: float) -> Column:
    """Frequency to the power -power."""
    if not 0 <= power <= 1:
        raise ValueError("power must lie in [0, 1]")
    return F.pow(col(frequency), F.lit(-power))
