"""The driver's tables in the engine's schemas, for Spark and as SQL for DuckDB.

None of the tables holds DNA: lineages come from parts, nations and regions, sequences
from hashes or from the letters of documents. Each column is one expression that both
engines read the same way. Hashes are md5 here, a substitute for BLAKE2b.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import RANKS

#: staged: a record for each line item. Depth is cut by line number; some suppliers disagree about genus, domain or kingdom.
STAGED = {
    "source": "CASE l_returnflag WHEN 'A' THEN 'gtdb' WHEN 'N' THEN 'silva' ELSE 'pr2' END",
    "source_ordinal": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 1 END",
    "ordinal": "concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_suppkey AS STRING))",
    "accession": "concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_suppkey AS STRING))",
    "seq_hash": "md5(CAST(l_partkey AS STRING))",
    "sequence": "repeat(translate(md5(CAST(l_partkey AS STRING)), '0123456789abcdef', CASE WHEN l_partkey % 9 = 0 THEN 'ACGTACGTACGTACGN' ELSE 'ACGTACGTACGTACGT' END), CAST(p_size AS INT) + 1)",
    "domain": "CASE WHEN l_partkey % 100 = 3 AND l_suppkey % 10 = 1 THEN 'Elsewhere' ELSE r_name END",
    "phylum": "CASE WHEN l_linenumber % 7 <= 5 THEN n_name END",
    "class": "CASE WHEN l_linenumber % 7 <= 4 AND NOT (l_partkey % 40 = 1 AND l_linenumber = 2) THEN p_brand END",
    "order": "CASE WHEN l_linenumber % 7 <= 3 THEN p_type END",
    "family": "CASE WHEN l_linenumber % 7 <= 2 THEN concat('F', CAST(p_size % 7 AS STRING)) END",
    "genus": "CASE WHEN l_linenumber % 7 <= 1 THEN CASE WHEN l_suppkey = 7 THEN concat(p_name, ' alt') ELSE p_name END END",
    "species": "CASE WHEN l_linenumber % 7 <= 0 THEN concat(p_name, ' ', CAST(l_partkey AS STRING)) END",
    "kingdom": "CASE WHEN l_suppkey % 97 = 11 THEN 'Protista' WHEN l_partkey % 4 = 0 THEN 'Animalia' WHEN l_partkey % 4 = 1 THEN 'Fungi' WHEN l_partkey % 4 = 2 THEN 'Plantae' END",
    "marker": "CASE (l_partkey + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'ssu' WHEN 1 THEN 'coi' WHEN 2 THEN 'its' WHEN 3 THEN 'rbcl' ELSE 'matk' END",
}
FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTRYSWKMBDHVNACGTACGTNCA"
#: sequences: the letters of documents folded to nucleotides.
SEQUENCE = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '' /*g*/)), '{FOLDED[0]}', '{FOLDED[1]}')"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The records, with columns of the line item that `more` names.

    The sequence hangs on the part alone, so it is made once for each part, before the join.

    Both sides are sorted to be joined: by their file's size Spark takes the parts for a
    small table, and would broadcast them with all their letters.
    """
    own = ("seq_hash", "sequence")
    parts = read(spark, sf_dir, "part").withColumns({n: F.expr(STAGED[n].replace("l_partkey", "p_partkey")) for n in own})
    parts = parts.withColumns({"length": F.length("sequence"), "n_ambiguous": F.length(F.regexp_replace("sequence", "[ACGT]+", ""))})
    items = read(spark, sf_dir, "lineitem").join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    named = items.join(read(spark, sf_dir, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(*(F.col(n) if n in own else F.expr(e).alias(n) for n, e in STAGED.items()), "length", "n_ambiguous", *more)


STAGED_SQL = "SELECT *, CAST(length(sequence) AS INT) AS length, CAST(length(replace(sequence, 'N', 'NN')) - length(sequence) AS INT) AS n_ambiguous FROM (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in STAGED.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(SEQUENCE).alias("sequence"), "lang")
    marker = F.when(F.col("lang") == "en", "ssu").when(F.col("lang") == "de", "coi").when(F.col("lang") == "fr", "its").otherwise("rbcl")
    return rows.withColumn("length", F.length("sequence")).withColumn("marker", marker)


SEQUENCES_SQL = "SELECT doc_id, sequence, lang, CAST(length(sequence) AS INT) AS length, CASE lang WHEN 'en' THEN 'ssu' WHEN 'de' THEN 'coi' WHEN 'fr' THEN 'its' ELSE 'rbcl' END AS marker FROM (SELECT doc_id, lang, " + SEQUENCE.replace("'' /*g*/", "'', 'g'") + " AS sequence FROM documents)"


def q(name: str) -> str:
    return f'"{name}"'


def key_sql(rank: str) -> str:
    """taxon_key in SQL."""
    upto = RANKS[: RANKS.index(rank) + 1]
    return f"CASE WHEN {q(rank)} IS NOT NULL THEN " + " || ';' || ".join(f"coalesce({q(r)}, '')" for r in upto) + " END"


def balancing_sql(rank: str = "genus") -> str:
    return "coalesce(" + ", ".join(key_sql(r) for r in reversed(RANKS[: RANKS.index(rank) + 1])) + ")"


def merged_sql() -> str:
    """The merge in SQL, with distinct counts in place of least and greatest keys."""
    conflicts = {r: f"count(DISTINCT {key_sql(r)}) > 1" for r in RANKS}
    inner = ["seq_hash", "any_value(sequence) AS sequence", "any_value(length) AS length", "any_value(n_ambiguous) AS n_ambiguous", "arg_min(marker, (source_ordinal, ordinal)) AS marker"]
    inner += [f"max({q(r)}) AS n_{r}, ({c}) AS c_{r}" for r, c in conflicts.items()]
    inner += ["max(kingdom) AS k, count(DISTINCT kingdom) > 1 AS c_k", "array_to_string(list_sort(list_distinct(list(source))), ',') AS sources", "array_to_string(list_sort(list(source || ':' || accession)), ',') AS accessions", "CAST(count(*) AS INT) AS n_records"]
    cut = {r: "(" + " OR ".join(f"c_{x}" for x in RANKS[: i + 1]) + ")" for i, r in enumerate(RANKS)}
    outer = ["seq_hash", "sequence", "length", "n_ambiguous", "marker", "sources", "accessions", "n_records", "CASE WHEN NOT c_k THEN k END AS kingdom", f"({cut['species']} OR c_k) AS label_conflict"]
    outer += [f"CASE WHEN NOT {cut[r]} THEN n_{r} END AS {q(r)}" for r in RANKS]
    return f"SELECT * FROM (SELECT {', '.join(outer)} FROM (SELECT {', '.join(inner)} FROM ({STAGED_SQL}) GROUP BY seq_hash)) WHERE domain IS NOT NULL"


def draw_sql(key: str, seed: int, purpose: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '|{seed}|{purpose}'), 1, 15) AS BIGINT) / 1152921504606846976.0"


def dataset_sql(share: float = 0.05, size: int = 3) -> str:
    """The merged rows with their splits, in SQL."""
    novel = f"SELECT genus_key FROM (SELECT *, count(*) OVER (PARTITION BY family_key) AS sib FROM (SELECT {key_sql('genus')} AS genus_key, {key_sql('family')} AS family_key, count(*) AS n FROM m WHERE genus IS NOT NULL GROUP BY 1, 2)) WHERE sib > 1 AND n >= {size} AND family_key IS NOT NULL AND {draw_sql('genus_key', 20260922, 'novel-genus')} < {share}"
    split = f"CASE WHEN {key_sql('genus')} IN (SELECT genus_key FROM novel) THEN 'test_novel_genus' WHEN d < 0.05 THEN 'val' WHEN d < 0.1 THEN 'test' ELSE 'train' END"
    return f"WITH m AS ({merged_sql()}), novel AS ({novel}) SELECT * EXCLUDE (d), {split} AS split FROM (SELECT *, {draw_sql('seq_hash', 20260922, 'sequence')} AS d FROM m)"
