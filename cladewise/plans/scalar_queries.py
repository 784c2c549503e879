"""S and F: scalar functions and filters over documents, parts and customers."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import exprs
from ..functions.hashing import draw, sequence_hash
from ..functions.schema import COMPLEMENTS, NUCLEOTIDES, Filters
from ..operators import parsers, staging
from ..operators.batches import sampling_weights
from .adapters import SEQUENCES_SQL, STAGED_SQL, key_sql, balancing_sql, q, read, sequences, staged
from .catalog import query

SEQ = f"({SEQUENCES_SQL}) s"
NORMAL = r"replace(upper(regexp_replace(replace(text, 'ß', 'SS'), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', '', 'g')), 'U', 'T')"


@query("S01_normalize_sequence", f"SELECT doc_id, md5({NORMAL}) AS normalized, regexp_full_match({NORMAL}, '[{NUCLEOTIDES}]+') AS valid FROM documents")
def s01(spark, sf):
    n = exprs.normalize_sequence("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(n).alias("normalized"), exprs.valid_sequence(n).alias("valid"))


@query("S02_count_ambiguous", f"SELECT doc_id, CAST(length(regexp_replace(sequence, '[ACGT]', '', 'g')) AS INT) AS n_ambiguous FROM {SEQ}")
def s02(spark, sf):
    return sequences(spark, sf).select("doc_id", exprs.count_ambiguous("sequence").alias("n_ambiguous"))


@query("S03_reverse_complement", f"SELECT doc_id, md5(reverse(translate(sequence, '{NUCLEOTIDES}', '{COMPLEMENTS}'))) AS turned FROM {SEQ}")
def s03(spark, sf):
    return sequences(spark, sf).select("doc_id", F.md5(exprs.reverse_complement("sequence")).alias("turned"))


#: Organism names of every shape, from parts.
ORGANISM = "CASE p_partkey % 11 WHEN 0 THEN concat('Candidatus ', upper(substr(p_name, 1, 1)), substr(p_name, 2), ' sp. 1') WHEN 1 THEN concat('uncultured ', p_name) WHEN 2 THEN p_name WHEN 3 THEN concat('  ', p_name, '  x') WHEN 4 THEN concat(p_brand, ' bacterium') WHEN 5 THEN split_part(p_name, ' ', 1) WHEN 6 THEN concat(p_name, ' METAGENOME') WHEN 7 THEN concat(p_type, ' vulgaris strain 7') WHEN 8 THEN concat('Candidatus ', p_name) WHEN 9 THEN 'Incertae Sedis' ELSE concat(p_name, '--other') END"
WORDS = r"list_filter(string_split_regex(regexp_replace(trim(o), '^Candidatus ', ''), '\s+'), lambda x: x <> '')"


@query(
    "S04_split_organism",
    f"SELECT k, o AS organism, coalesce(w[1], '') AS genus, CASE WHEN len(w) >= 2 AND NOT regexp_matches(o, '(?i)uncultured|unidentified|metagenome|environmental|unknown|unclassified') AND regexp_full_match(w[2], '[a-z][a-z-]+') AND w[2] NOT IN ('bacterium', 'archaeon', 'eukaryote') THEN w[1] || ' ' || w[2] END AS species FROM (SELECT *, {WORDS} AS w FROM (SELECT p_partkey AS k, {ORGANISM} AS o FROM part))",
)
def s04(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(ORGANISM).alias("organism"))
    return rows.withColumn("x", exprs.split_organism("organism")).select("k", "organism", "x.genus", "x.species")


@query("S05_sequence_hash_md5", f"SELECT doc_id, md5(sequence) AS seq_hash FROM {SEQ}")
def s05_md5(spark, sf):
    return sequences(spark, sf).select("doc_id", F.lower(F.hex(sequence_hash("sequence", "md5"))).alias("seq_hash"))


@query("S05_sequence_hash")
def s05(spark, sf):
    return sequences(spark, sf).select("doc_id", F.lower(F.hex(sequence_hash("sequence"))).alias("seq_hash"))


@query("S06_unit_interval_md5", f"SELECT doc_id, round(CAST('0x' || substr(md5(md5(sequence) || '|1|sequence'), 1, 15) AS BIGINT) / 1152921504606846976.0, 12) AS draw FROM {SEQ}")
def s06_md5(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(draw(F.md5("sequence"), 1, "sequence", "md5"), 12).alias("draw"))


@query("S06_unit_interval")
def s06(spark, sf):
    return sequences(spark, sf).select("doc_id", draw(sequence_hash("sequence"), 1, "sequence").alias("draw"))


@query("S07_taxon_key", f"SELECT accession, {key_sql('class')} AS class_key, {key_sql('genus')} AS genus_key FROM ({STAGED_SQL})")
def s07(spark, sf):
    return staged(spark, sf).select("accession", exprs.taxon_key("class").alias("class_key"), exprs.taxon_key("genus").alias("genus_key"))


@query("S08_balancing_key", f"SELECT accession, {balancing_sql()} AS balancing_key FROM ({STAGED_SQL})")
def s08(spark, sf):
    return staged(spark, sf).select("accession", exprs.balancing_key().alias("balancing_key"))


DEEPEST = "CASE " + " ".join(f"WHEN nullif({q(r)}, '') IS NOT NULL THEN '{r}'" for r in ("species", "genus", "family", "order", "class", "phylum", "domain")) + " END"


@query("S09_deepest_rank", f"SELECT accession, {DEEPEST} AS deepest FROM ({STAGED_SQL})")
def s09(spark, sf):
    return staged(spark, sf).select("accession", exprs.deepest_rank().alias("deepest"))


@query("S10_truncate", f"SELECT accession, domain, phylum, \"class\", CASE WHEN p >= 4 THEN \"order\" END AS \"order\", CASE WHEN p >= 5 THEN family END AS family, CASE WHEN p >= 6 THEN genus END AS genus, CASE WHEN p >= 7 THEN species END AS species FROM (SELECT *, 3 + length % 5 AS p FROM ({STAGED_SQL}))")
def s10(spark, sf):
    from ..functions.schema import RANKS

    names = {r: F.col(f"`{r}`") for r in RANKS}
    cut = exprs.truncated(F.lit(2) + F.col("length") % 5, names)
    return staged(spark, sf).select("accession", *(c.alias(r) for r, c in cut.items()))


@query("S11_prokaryote_kingdom", "SELECT k, d, CASE WHEN d IN ('Bacteria', 'Archaea') THEN d END AS kingdom FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Bacteria' WHEN 1 THEN 'Archaea' WHEN 2 THEN 'Eukaryota' END AS d FROM customer)")
def s11(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Bacteria' WHEN 1 THEN 'Archaea' WHEN 2 THEN 'Eukaryota' END").alias("d"))
    return rows.withColumn("kingdom", exprs.prokaryote_kingdom("d"))


@query("S12_is_placeholder", f"SELECT k, o, (lower(trim(o)) = 'incertae sedis' OR starts_with(lower(trim(o)), 'uncultured') OR starts_with(lower(trim(o)), 'unidentified') OR ends_with(lower(trim(o)), '--other')) AS placeholder FROM (SELECT p_partkey AS k, {ORGANISM} AS o FROM part)")
def s12(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(ORGANISM).alias("o"))
    return rows.withColumn("placeholder", exprs.is_placeholder("o"))


RAW_NAME = "CASE p_partkey % 5 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_XX') WHEN 1 THEN concat(replace(p_name, ' ', '_'), '_sp.') WHEN 2 THEN '  ' WHEN 3 THEN concat(' ', replace(p_name, ' ', '_'), ' ') ELSE p_type END"


@query("S13_clean_name", f"SELECT k, CASE WHEN g THEN n END AS name, CASE WHEN g AND NOT contains(n, '_sp.') THEN replace(n, '_', ' ') END AS species FROM (SELECT k, trim(r) AS n, trim(r) <> '' AND NOT regexp_matches(trim(r), '_X+$') AS g FROM (SELECT p_partkey AS k, {RAW_NAME} AS r FROM part))")
def s13(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(RAW_NAME).alias("r"))
    return rows.select("k", exprs.clean_name("r").alias("name"), exprs.clean_name("r", species=True).alias("species"))


@query("S14_partition", "SELECT page_id, CASE WHEN p > 0 THEN substr(url, 1, p - 1) ELSE url END AS head, p > 0 AS found, CASE WHEN p > 0 THEN substr(url, p + 1) ELSE '' END AS tail FROM (SELECT page_id, url, instr(url, '?') AS p FROM pages)")
def s14(spark, sf):
    return read(spark, sf, "pages").withColumn("x", exprs.cut_at("url", "?")).select("page_id", "x.head", "x.found", "x.tail")


@query("S15_tagged_ranks", "SELECT k, p AS phylum, g AS genus, s AS species FROM (SELECT p_partkey AS k, nullif(trim(p_type), '') AS p, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS g, p_name AS s FROM part)")
def s15(spark, sf):
    header = F.concat(F.lit("k:Eukaryota_2759,p:"), F.col("p_type"), F.lit("_77,g:"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("genus_"), F.col("p_brand"))).otherwise(F.col("p_brand")), F.lit("_12,s:"), F.col("p_name"), F.lit("_9"))
    fields = F.transform(F.split(header, ",(?=[kpcofgs]:)"), lambda f: exprs.cut_at(f, ":"))

    def name(f):
        value = exprs.strip(F.regexp_replace(f["tail"], "_[0-9]+$", ""))
        return F.when((value != "") & ~value.rlike("^(phylum|class|order|family|genus)_"), value)

    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), exprs.tagged(fields, name, "p").alias("phylum"), exprs.tagged(fields, name, "g").alias("genus"), exprs.tagged(fields, name, "s").alias("species"))


TOKENS_SQL = "translate(regexp_replace(sequence, '[^ACGT]', 'N', 'g'), 'ACGTN', '12345')"


@query("S16_tokens", f"SELECT doc_id, CAST(length({TOKENS_SQL}) AS INT) AS n, md5({TOKENS_SQL}) AS tokens FROM {SEQ}")
def s16(spark, sf):
    digits = F.translate(F.decode(exprs.tokens("sequence"), "ISO-8859-1"), "\x01\x02\x03\x04\x05", "12345")
    return sequences(spark, sf).select("doc_id", F.octet_length(exprs.tokens("sequence")).alias("n"), F.md5(digits).alias("tokens"))


@query("S17_encode_sequence", f"SELECT doc_id, md5({TOKENS_SQL}) AS tokens FROM {SEQ} WHERE sequence <> ''")
def s17(spark, sf):
    return sequences(spark, sf).where("sequence <> ''").select("doc_id", F.md5(F.array_join(exprs.token_array("sequence"), "")).alias("tokens"))


@query("S18_level_accuracy", "SELECT p_brand AS g, round(CASE WHEN sum(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) = 0 THEN 'NaN'::DOUBLE ELSE sum(CASE WHEN p_size > 48 THEN 1 ELSE 0 END) / sum(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) END, 9) AS accuracy FROM part GROUP BY p_brand")
def s18(spark, sf):
    counts = read(spark, sf, "part").groupBy(F.col("p_brand").alias("g")).agg(F.count_if(F.col("p_size") > 48).alias("h"), F.count_if(F.col("p_size") > 45).alias("n"))
    return counts.select("g", F.round(exprs.level_accuracy("h", "n"), 9).alias("accuracy"))


@query("S19_learning_rate", "SELECT CAST(i AS BIGINT) AS step, round(CASE WHEN i < 50 THEN (i + 1) / 50.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (i - 50) / 950.0))) END, 9) AS factor FROM range(1000) t(i)")
def s19(spark, sf):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(exprs.learning_rate_factor("id", 1000, 50), 9).alias("factor"))


@query("S19_learning_rate_of_orders", "SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 500 THEN (o_orderkey + 1) / 500.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (o_orderkey - 500) / 9500.0))) END, 9) AS factor FROM orders")
def s19_orders(spark, sf):
    """Each order's key as a step of 10 000, 500 of them warm-up."""
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.round(exprs.learning_rate_factor("o_orderkey", 10_000, 500), 9).alias("factor"))


@query("S20_objective", "SELECT round(avg(acc), 9) AS objective FROM (SELECT length(p_type) % 2 AS level, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS acc FROM part GROUP BY 1)")
def s20(spark, sf):
    from ..operators.metrics import objective

    level = F.when(F.length("p_type") % 2 == 0, "genus").otherwise("species")
    levels = read(spark, sf, "part").groupBy(level.alias("level")).agg(F.avg((F.col("p_size") > 25).cast("double")).alias("accuracy"))
    return objective(levels).select(F.round("objective", 9).alias("objective"))


@query("S21_sampling_weights", "SELECT p_partkey AS k, round(pow(f, -0.5) * count(*) OVER () / sum(pow(f, -0.5)) OVER (), 8) AS weight FROM (SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand) AS DOUBLE) AS f FROM part)")
def s21(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.count(F.lit(1)).over(Window.partitionBy("p_brand")).cast("double").alias("f"))
    return sampling_weights(rows, "f", 0.5).select("k", F.round("weight", 8).alias("weight"))


@query("S23_refseq_locus", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' voucher' END AS organism, CASE WHEN p_partkey % 3 = 2 THEN 'malformed_header' END AS exclusion FROM part")
def s23_refseq(spark, sf):
    """The organism that the parser finds before the locus; another locus is a malformed header."""
    head = F.expr("concat('A', p_partkey, ' ', CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' 16S ribosomal RNA, partial') WHEN 1 THEN concat(p_name, ' voucher 16S rRNA gene') ELSE concat(p_name, ' 23S ribosomal RNA') END)")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), head.alias("header"), F.lit("ACGT").alias("sequence"))
    found = parsers.refseq(rows, "Bacteria", "16S")
    return found.select(F.col("ordinal").alias("k"), F.when(F.col("exclusion").isNull(), F.col("source_lineage")[1]["name"]).alias("organism"), "exclusion")


@query("S23_locus_match", "SELECT k, CASE WHEN k % 3 = 0 THEN n WHEN k % 3 = 1 THEN n || ' voucher' ELSE '' END AS organism FROM (SELECT p_partkey AS k, p_name AS n FROM part)")
def s23(spark, sf):
    head = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' 16S ribosomal RNA, partial') WHEN 1 THEN concat(p_name, ' voucher 16S rRNA gene') ELSE concat(p_name, ' 23S ribosomal RNA') END")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.regexp_extract(head, r"(?s)^(.*?) 16S (?:ribosomal RNA|rRNA)\b", 1).alias("organism"))


LOW = "CASE marker WHEN 'coi' THEN 400 WHEN 'its' THEN 300 WHEN 'rbcl' THEN 400 WHEN 'matk' THEN 400 ELSE 500 END"
HIGH = "CASE marker WHEN 'coi' THEN 2500 WHEN 'its' THEN 1500 WHEN 'rbcl' THEN 1600 WHEN 'matk' THEN 1800 ELSE 4000 END"
LENGTH = f"CASE WHEN length < {LOW} THEN 'too_short' WHEN length > {HIGH} THEN 'too_long' END"
AMBIGUITY = "CASE WHEN length(regexp_replace(sequence, '[ACGT]', '', 'g')) > CAST(0.01 AS DOUBLE) * length THEN 'too_ambiguous' END"


@query("F01_length_filter", f"SELECT doc_id, {LENGTH} AS reason FROM {SEQ}")
def f01(spark, sf):
    return sequences(spark, sf).select("doc_id", staging.length_reason(Filters()).alias("reason"))


@query("F02_ambiguity_filter", f"SELECT doc_id, {AMBIGUITY} AS reason FROM {SEQ}")
def f02(spark, sf):
    return sequences(spark, sf).select("doc_id", staging.ambiguity_reason(Filters(), exprs.count_ambiguous("sequence")).alias("reason"))


@query("F03_first_exclusion", f"SELECT doc_id, coalesce({LENGTH}, {AMBIGUITY}) AS exclusion FROM {SEQ}")
def f03(spark, sf):
    rows = sequences(spark, sf).withColumn("exclusion", F.lit(None).cast("string"))
    return staging.filtered(rows, Filters()).select("doc_id", "exclusion")


@query("G01_staging_counts", f"SELECT lang AS source, count(*) AS n_read, count(*) FILTER (e IS NULL) AS n_kept, count(*) FILTER (e = 'too_short') AS too_short, count(*) FILTER (e = 'too_long') AS too_long, count(*) FILTER (e = 'too_ambiguous') AS too_ambiguous, count(*) FILTER (e IS NULL AND doc_id % 2 = 0) AS depth_genus, count(*) FILTER (e IS NULL AND doc_id % 2 = 1) AS depth_domain FROM (SELECT *, coalesce({LENGTH}, {AMBIGUITY}) AS e FROM {SEQ}) GROUP BY lang")
def g01(spark, sf):
    from ..functions.schema import RANKS

    rows = sequences(spark, sf).withColumn("exclusion", F.lit(None).cast("string")).withColumn("source", F.col("lang"))
    named = rows.withColumns({r: F.lit(None).cast("string") for r in RANKS}).withColumns({"domain": F.lit("Eukaryota"), "genus": F.when(F.col("doc_id") % 2 == 0, F.lit("G"))})
    return staging.counts(staging.filtered(named, Filters())).select("source", "n_read", "n_kept", "too_short", "too_long", "too_ambiguous", "depth_genus", "depth_domain")
