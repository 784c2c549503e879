"""A and P: FASTA files, sinks and header parsers over headers made from the driver's tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions import storage
from ..operators import parsers
from ..sources.fasta import read_fasta, read_fasta_member
from .adapters import SEQUENCES_SQL, read, sequences
from .catalog import query


MEMBER = "in/sequences.fasta"
ARCHIVE_BYTES = 16 << 20


def archived(batches):
    """Tar archives with one FASTA member, each a row; one is closed when its text reaches ARCHIVE_BYTES."""
    import io
    import tarfile

    import pyarrow as pa

    def archive(texts):
        out, text = io.BytesIO(), "".join(texts).encode()
        with tarfile.open(fileobj=out, mode="w") as tar:
            info = tarfile.TarInfo(MEMBER)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["value"])

    texts, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            texts.append(text)
            size += len(text)
            if size >= ARCHIVE_BYTES:
                yield archive(texts)
                texts, size = [], 0
    if texts:
        yield archive(texts)


@query("A01_fasta_scan", f"SELECT 'doc ' || doc_id AS header, md5(sequence) AS sequence FROM ({SEQUENCES_SQL}) WHERE sequence <> ''")
def a01(spark, sf):
    """The documents' sequences written as FASTA in lines of 60 and scanned back."""
    lines = F.regexp_replace("sequence", "(.{1,60})", "$1\n")
    text = sequences(spark, sf).where("sequence <> ''").select(F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), lines).alias("value"))
    path = storage.scratch(spark, "fasta")
    text.write.text(path)
    return read_fasta(spark, path).select("header", F.md5("sequence").alias("sequence"))


@query("A02_fasta_gzip", f"SELECT 'doc ' || doc_id AS header, md5(sequence) AS sequence FROM ({SEQUENCES_SQL}) WHERE sequence <> ''")
def a02(spark, sf):
    text = sequences(spark, sf).where("sequence <> ''").select(F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("sequence")).alias("value"))
    path = storage.scratch(spark, "fasta-gz")
    text.write.option("compression", "gzip").text(path)
    return read_fasta(spark, path, partitions=8).select("header", F.md5("sequence").alias("sequence"))


@query("A03_fasta_member", f"SELECT 'doc ' || doc_id AS header, md5(sequence) AS sequence FROM ({SEQUENCES_SQL}) WHERE sequence <> ''")
def a03(spark, sf):
    """The documents' sequences as FASTA members of tar archives, one archive for each part of the rows, read as ranges of the members."""
    text = sequences(spark, sf).where("sequence <> ''").select(F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("sequence", "(.{1,60})", "$1\n")).alias("value"))
    path = storage.scratch(spark, "fasta-tar")
    text.mapInArrow(archived, "value binary").select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return read_fasta_member(spark, path, MEMBER).select("header", F.md5("sequence").alias("sequence"))


@query("A13_parquet_sink", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def a13(spark, sf):
    path = storage.scratch(spark, "sink")
    storage.write_parquet(read(spark, sf, "orders"), path, rows_a_file=50_000)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("A14_lazy_sink", "SELECT o_orderkey, o_custkey, year(o_orderdate) AS year FROM orders WHERE o_totalprice > 100000")
def a14(spark, sf):
    """A plan that is only run by its writer; the rows it wrote."""
    path = storage.scratch(spark, "lazy")
    rows = read(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    storage.write_parquet(rows, path)
    return spark.read.parquet(path)


@query("A15_sorted_sink", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, 0 AS overlaps FROM customer")
def a15(spark, sf):
    """Rows written in the order of a column: how many files begin before the one before them ends."""
    path = storage.scratch(spark, "sorted")
    storage.write_parquet(read(spark, sf, "customer"), path, sort=["c_mktsegment", "c_custkey"])
    key = F.struct("c_mktsegment", "c_custkey")
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
    before = files.withColumn("before", F.lag("high").over(Window.orderBy("file")))  # a row for each file
    return before.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count_if(F.col("low") < F.col("before")).cast("int").alias("overlaps"))


@query("A07_batches", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def a07(spark, sf):
    """Rows in Arrow batches of bounded size."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return read(spark, sf, "orders").select("o_orderkey").mapInArrow(run, "n long").agg(F.sum("n").alias("n"))


def headers(spark, sf, header: str) -> DataFrame:
    """(ordinal, header, sequence) for each part: the header from an expression, a good sequence but for each 13th."""
    rows = read(spark, sf, "part")
    sequence = F.when(F.col("p_partkey") % 13 == 0, "ACGT-Z").otherwise("acgu ACGT")
    return rows.select(F.col("p_partkey").alias("ordinal"), F.expr(header).alias("header"), sequence.alias("sequence"))


def shown(df: DataFrame) -> DataFrame:
    """What a parser made of a row that isn't malformed."""
    bad = F.col("exclusion").eqNullSafe("malformed_header")
    lineage = F.array_join(F.transform("source_lineage", lambda t: F.concat_ws("=", F.coalesce(t["rank"], F.lit("-")), t["name"])), ",")
    asked = F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["kind"], c["name"])), ",")
    return df.select("ordinal", F.coalesce("exclusion", F.lit("")).alias("exclusion"), F.when(~bad, F.col("accession")).alias("accession"), F.when(~bad, lineage).alias("lineage"), F.when(~bad, asked).alias("candidates"))


SEQ_BAD = "CASE WHEN k % 13 = 0 THEN 'invalid_sequence' ELSE '' END"


def expected(malformed: str, accession: str, lineage: str, candidates: str, excluded: str = "NULL") -> str:
    """SQL of what a parser should give, from the part's own columns."""
    base = "SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS STRING) AS size FROM part"
    return f"SELECT k AS ordinal, CASE WHEN {malformed} THEN 'malformed_header' ELSE coalesce({excluded}, {SEQ_BAD}) END AS exclusion, CASE WHEN NOT ({malformed}) THEN {accession} END AS accession, CASE WHEN NOT ({malformed}) THEN {lineage} END AS lineage, CASE WHEN NOT ({malformed}) THEN {candidates} END AS candidates FROM ({base})"


GTDB = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey, ' d__Bacteria;p__', p_type) WHEN p_partkey % 7 = 1 THEN concat('A', p_partkey, ' d__;p__x;c__;o__;f__;g__;s__') ELSE concat('A', p_partkey, ' d__Bacteria;p__', p_type, ';c__', p_brand, ';o__;f__F', p_size, ';g__G;s__', CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END, ' [x=1] [y=2]') END"


@query("P01_gtdb", expected("k % 7 IN (0, 1)", "'A' || k", "'domain=Bacteria,phylum=' || type || ',class=' || brand || ',family=F' || size || ',genus=G' || CASE WHEN k % 2 = 0 THEN ',species=' || name ELSE '' END", "''"))
def p01(spark, sf):
    return shown(parsers.gtdb(headers(spark, sf, GTDB)))


PR2 = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey, '|18S_rRNA|nucleus') ELSE concat('A', p_partkey, '|', CASE WHEN p_partkey % 5 = 0 THEN '16S_rRNA|plastid' ELSE '18S_rRNA|nucleus' END, '||Eukaryota|Obazoa||Fungi|', p_type, '|', p_brand, '_XX|Fam|Gen|', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 2 = 0 THEN '_sp.' ELSE '' END) END"


@query("P02_pr2", expected("k % 7 = 0", "'A' || k", "'domain=Eukaryota,-=Obazoa,-=Fungi,class=' || type || ',order=' || brand || '_XX,family=Fam,genus=Gen,species=' || replace(name, ' ', '_') || CASE WHEN k % 2 = 0 THEN '_sp.' ELSE '' END", "CASE WHEN k % 2 = 1 THEN 'species=' || name || ',' ELSE '' END || 'taxon=Gen,taxon=Fam,taxon=' || type || ',taxon=Fungi,taxon=Obazoa'", "CASE WHEN k % 5 = 0 THEN 'off_target' END"))
def p02(spark, sf):
    return shown(parsers.pr2(headers(spark, sf, PR2)))


REFSEQ = "concat('A', p_partkey, ' Genus ', CASE WHEN p_partkey % 2 = 0 THEN 'vulgaris' ELSE 'sp. 3' END, CASE WHEN p_partkey % 5 = 0 THEN ' 23S ribosomal RNA' WHEN p_partkey % 5 = 1 THEN ' 16S rRNA gene' ELSE ' 16S ribosomal RNA, partial' END)"
ORG = "'Genus ' || CASE WHEN k % 2 = 0 THEN 'vulgaris' ELSE 'sp. 3' END"
ORG_ASKED = "CASE WHEN k % 2 = 0 THEN 'species=Genus vulgaris,' ELSE '' END || 'taxon=Genus'"


@query("P03_refseq", expected("k % 5 = 0", "'A' || k", f"'domain=Bacteria,-=' || {ORG}", ORG_ASKED))
def p03(spark, sf):
    return shown(parsers.refseq(headers(spark, sf, REFSEQ), "Bacteria", "16S"))


EUKRIBO = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey) WHEN p_partkey % 7 = 1 THEN concat('A', p_partkey, ' Bacteria|x') ELSE concat('A', p_partkey, ' Eukaryota|Clade-1|strain=', p_size, '|g:Genus', CASE WHEN p_partkey % 2 = 0 THEN '|Genus+vulgaris' ELSE '' END) END"


@query("P04_eukribo", expected("k % 7 IN (0, 1)", "'A' || k", "'domain=Eukaryota,-=Clade-1,-=strain=' || size || ',-=g:Genus' || CASE WHEN k % 2 = 0 THEN ',-=Genus+vulgaris' ELSE '' END", "CASE WHEN k % 2 = 0 THEN 'species=Genus vulgaris,taxon=Genus,taxon=Genus,' ELSE 'taxon=Genus,' END || 'taxon=Clade-1'"))
def p04(spark, sf):
    return shown(parsers.eukribo(headers(spark, sf, EUKRIBO)))


SILVA = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey, ' Bacteria;x;y') WHEN p_partkey % 7 = 1 THEN concat('A', p_partkey, '.1.24 Bacteria') ELSE concat('A', p_partkey, '.1.24 Bacteria;', p_type, ';', CASE WHEN p_partkey % 5 = 0 THEN 'Chloroplast' ELSE 'Incertae Sedis' END, ';uncultured;Gen;', p_name) END"


@query("P05_silva", expected("k % 7 IN (0, 1)", "'A' || k || '.1.24'", "'domain=Bacteria,-=' || type || ',-=' || CASE WHEN k % 5 = 0 THEN 'Chloroplast' ELSE 'Incertae Sedis' END || ',-=uncultured,-=Gen'", "'taxon=Gen,' || CASE WHEN k % 5 = 0 THEN 'taxon=Chloroplast,' ELSE '' END || 'taxon=' || type", "CASE WHEN k % 5 = 0 THEN 'organelle' END"))
def p05(spark, sf):
    return shown(parsers.silva(headers(spark, sf, SILVA)))


MIDORI = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey) WHEN p_partkey % 7 = 1 THEN concat('A', p_partkey, ';tax=p:x_1') ELSE concat('A<1>', p_partkey, ';tax=k:Eukaryota_2759,p:', p_type, '_77,c:class_', p_brand, '_5,g:Gen_9,s:', CASE WHEN p_partkey % 2 = 0 THEN 'Gen vulgaris' ELSE 'Gen sp. 1' END, '_8;') END"


@query("P06_midori", expected("k % 7 IN (0, 1)", "'A<1>' || k", "'domain=Eukaryota,phylum=' || type || ',genus=Gen,species=' || CASE WHEN k % 2 = 0 THEN 'Gen vulgaris' ELSE 'Gen sp. 1' END", "CASE WHEN k % 2 = 0 THEN 'species=Gen vulgaris,' ELSE '' END || 'taxon=Gen,taxon=' || type"))
def p06(spark, sf):
    return shown(parsers.midori(headers(spark, sf, MIDORI)))


UNITE = "CASE WHEN p_partkey % 7 = 0 THEN concat('n|A', p_partkey, '|SH') WHEN p_partkey % 7 = 1 THEN 'n||SH|refs|k__Fungi' ELSE concat('n|A', p_partkey, '|SH|refs|k__Fungi;p__', p_type, ';c__X_cls_Incertae_sedis;g__Gen;s__', CASE WHEN p_partkey % 2 = 0 THEN 'Gen_vulgaris' ELSE 'Gen_sp' END) END"


@query("P07_unite", expected("k % 7 IN (0, 1)", "'A' || k", "'domain=Eukaryota,phylum=' || type || ',genus=Gen,species=' || CASE WHEN k % 2 = 0 THEN 'Gen vulgaris' ELSE 'Gen sp' END", "CASE WHEN k % 2 = 0 THEN 'species=Gen vulgaris,' ELSE '' END || 'taxon=Gen,taxon=' || type"))
def p07(spark, sf):
    return shown(parsers.unite(headers(spark, sf, UNITE)))


GENBANK = "CASE WHEN p_partkey % 7 = 0 THEN concat('A', p_partkey) ELSE concat('A', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' UNVERIFIED: ' ELSE ' ' END, 'Genus ', CASE WHEN p_partkey % 2 = 0 THEN 'vulgaris' ELSE 'sp. 3' END) END"


@query("P08_genbank", expected("k % 7 = 0", "'A' || k", f"'domain=Eukaryota,-=' || {ORG}", ORG_ASKED))
def p08(spark, sf):
    return shown(parsers.genbank(headers(spark, sf, GENBANK), "rbcl"))
