"""The whole build over small files in each collection's format, written here."""

import json
import zipfile
from pathlib import Path

import pyspark.sql.functions as F
import pytest

from cladewise.functions.schema import Filters, Oversampling, Split
from cladewise.plans import build as plan
from cladewise.sources.bank import read_bank
from cladewise.sources.fasta import DataError, read_fasta
from cladewise.sources.remote import RemoteFile, Source

TAXA = [
    (1, "phylum", "Ascomycota", "", "", "", "", "", "Fungi"),
    (2, "class", "Sordariomycetes", "", "", "", "", "Ascomycota", "Fungi"),
    (3, "order", "Sordariales", "", "", "", "Sordariomycetes", "Ascomycota", "Fungi"),
    (4, "family", "Podosporaceae", "", "", "Sordariales", "Sordariomycetes", "Ascomycota", "Fungi"),
    (5, "genus", "Podospora", "", "Podosporaceae", "Sordariales", "Sordariomycetes", "Ascomycota", "Fungi"),
    (6, "species", "Podospora anserina", "Podospora", "Podosporaceae", "Sordariales", "Sordariomycetes", "Ascomycota", "Fungi"),
    (7, "species", "Podospora sp. 1", "Podospora", "Podosporaceae", "Sordariales", "Sordariomycetes", "Ascomycota", "Fungi"),
    (8, "class", "Dinophyceae", "", "", "", "", "", ""),
    (9, "phylum", "Chlorophyta", "", "", "", "", "", "Viridiplantae"),
    (10, "genus", "Micromonas", "", "", "", "", "Chlorophyta", "Viridiplantae"),
    (11, "species", "Micromonas pusilla", "Micromonas", "", "", "", "Chlorophyta", "Viridiplantae"),
    (12, "kingdom", "Fungi", "", "", "", "", "", ""),
]
E_COLI = "d__Bacteria;p__Pseudomonadota;c__Gammaproteobacteria;o__Enterobacterales;f__Enterobacteriaceae;g__Escherichia;s__Escherichia coli"
PSEUDO = "d__Bacteria;p__Pseudomonadota;c__Gammaproteobacteria;o__Pseudomonadales;f__Pseudomonadaceae;g__Pseudomonas;s__Pseudomonas aeruginosa"
FILES = {
    "gtdb.fna": f">R1 {E_COLI} [x=1]\nAAGCCCAATAAA\nCCACTCTGACTG\n\n>R2 {E_COLI} [x=1]\nAAGCCCAATAAACCACTCTGACTG\n>R3 {PSEUDO} [x]\nGCCGAATAGGGATATAGGCAACGA\n>R4 d__Bacteria;p__Pseudomonadota [x]\nTGAAGGAGTCTAGCAGCCGCAGTA\n>R5 {E_COLI}\nCTATT\n",
    "silva.fasta": ">S1.1.24 Bacteria;Pseudomonadati;Pseudomonadota;Gammaproteobacteria;Pseudomonadales;Pseudomonadaceae;Pseudomonas;Pseudomonas sp.\nAAGCCCAATAAACCACTCTGACTG\n>S2.1.24 Bacteria;X;Chloroplast;Zea mays\nGGCTGTTTCTCAGGACGCCCAACT\n>S3.1.24 Bacteria;Pseudomonadota;Gammaproteobacteria;Pseudomonadales;Pseudomonadaceae;Pseudomonas;Pseudomonas aeruginosa\nCTGGAGGUGAAGCGAAUGGUAUCG\n>bad\nACGTACGTACGT\n",
    "pr2.fasta": ">P1|18S_rRNA|nucleus||Eukaryota|Obazoa|Opisthokonta|Fungi|Ascomycota|Pezizomycotina|Sordariomycetes|Podospora|Podospora_anserina\nAGGCACAATACCTCGTCCGTGTTA\n>P2|18S_rRNA|nucleus|s|Eukaryota|TSAR|Alveolata|Dinoflagellata|Dinophyceae|Dinophyceae_X|Dinophyceae_XX|Dinophyceae_XXX|Dinophyceae_XXX_sp.\nCCAGACCAAACAAGACGTCCTCTT\n>P3|16S_rRNA|plastid||Eukaryota:plas|A|B|C|D|E|F|G|H\nCAATGTTTAAAT\n",
    "midori.fasta": ">M<1>;tax=k:Eukaryota_2759,p:Ascomycota_4890,g:Podospora_5144,s:Podospora anserina_5145;\nACGTACGTACGTGGAA\n",
}


def source(slug, parser, name, **more):
    return Source(slug, parser, ((RemoteFile(f"https://example.org/{name}"), ()),), **more)


SOURCES = [source("gtdb", "gtdb", "gtdb.fna", backbone=True), source("pr2", "pr2", "pr2.fasta"), source("silva", "silva", "silva.fasta"), source("midori", "midori2", "midori.fasta")]
TAXONOMY = source("ncbi", "taxdump", "dump.zip")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    layout = plan.Layout(str(top))
    for s in SOURCES:
        layout.raw(s).mkdir(parents=True)
        name = s.inputs[0][0].filename
        (layout.raw(s) / name).write_text(FILES[name])
    layout.raw(TAXONOMY).mkdir(parents=True)
    with zipfile.ZipFile(layout.raw(TAXONOMY) / "dump.zip", "w") as z:
        z.writestr("nodes.dmp", "".join(f"{t[0]}\t|\t1\t|\t{t[1]}\t|\tx\t|\n" for t in TAXA))
        z.writestr("rankedlineage.dmp", "".join("\t|\t".join([str(t[0]), t[2], "", *t[3:8], t[8], "Eukaryota"]) + "\t|\n" for t in TAXA))
    config = plan.Build(SOURCES, TAXONOMY, Filters(10, 100, 0.01, ()), Split(0.3, 0.1, seed=3))
    return layout, plan.build(spark, layout, config), config


def test_report(built):
    _, report, _ = built
    assert report["taxa"] == 10
    assert report["sources"]["gtdb"] | {"n_read": 5, "n_kept": 3, "malformed_header": 1, "too_short": 1, "depth_species": 3} == report["sources"]["gtdb"]
    assert report["sources"]["silva"] | {"n_read": 4, "n_kept": 2, "organelle": 1, "malformed_header": 1} == report["sources"]["silva"]
    assert report["sources"]["pr2"] | {"n_read": 3, "n_kept": 2, "off_target": 1, "depth_species": 1, "depth_class": 1} == report["sources"]["pr2"]
    assert report["merge"] == {"staged": 8, "unique": 6, "kept": 6, "merged": 1, "conflicts": 1, "domain_conflicts": 0}
    assert report["kingdoms"] == {"Bacteria": 3, "Archaea": 0, "Animalia": 0, "Fungi": 2, "Plantae": 0, "Protista": 1, "unknown": 0}


def test_conflict_is_cut_at_the_common_ancestor(spark, built):
    layout = built[0]
    row = spark.read.parquet(layout.dataset).where("n_records = 3").first()
    assert row["sources"] == ["gtdb", "silva"] and row["class"] == "Gammaproteobacteria" and row["order"] is None and row["label_conflict"]
    assert row["accessions"] == ["gtdb:R1", "gtdb:R2", "silva:S1.1.24"]


def test_species_is_added_where_the_genus_agrees(spark, built):
    rows = spark.read.parquet(built[0].staged("silva")).where("accession = 'S3.1.24'").collect()
    assert rows[0]["species"] == "Pseudomonas aeruginosa" and rows[0]["sequence"] == "CTGGAGGTGAAGCGAATGGTATCG"


def test_augment_and_cache(spark, built):
    layout = built[0]
    report = plan.augment(spark, layout, Oversampling(floor=3))
    made = spark.read.parquet(layout.synthetic)
    assert report["n_synthetic"] == made.count() == report["n_planned"] - report["collisions"] > 0
    assert made.where(F.col("seq_hash") == F.col("parent_seq_hash")).count() == 0
    assert made.select("seq_hash").distinct().count() == made.count()
    again = plan.augment(spark, layout, Oversampling(floor=3))
    assert again == report
    first = plan.cache(spark, layout, 1)
    assert plan.cache(spark, layout, 1) == first
    bank = spark.read.parquet(f"{layout.tokens}/train")
    assert bank.where("octet_length(tokens) <> length").count() == 0
    assert json.loads(Path(layout.report("label_space")).read_text())["levels"]["domain"]


def test_cache_has_flat_banks(spark, built):
    layout = built[0]
    plan.augment(spark, layout, Oversampling(floor=3))
    assert plan.cache(spark, layout, 1)["train"] > 0
    table = spark.read.parquet(f"{layout.tokens}/train").orderBy("seq_hash").collect()
    targets = [c for c in table[0].asDict() if c.startswith("y_")]
    flat = read_bank(spark, f"{layout.tokens}/train.bank").orderBy("ordinal").collect()
    assert targets and [[r.offset, bytes(r.tokens), *(r[c] for c in targets)] for r in flat] == [[r.offset, bytes(r.tokens), *(r[c] for c in targets)] for r in table]


def test_missing_files_are_named(spark, tmp_path):
    with pytest.raises(DataError, match="gtdb.fna"):
        plan.build(spark, plan.Layout(str(tmp_path)), plan.Build(SOURCES, None))


@pytest.mark.parametrize("text, said", [("ACGT\n>a\nAC\n", "before the first header"), (">\nACGT\n", "empty header"), (">a\n>b\nACGT\n", "no sequence"), (">a\nAC\n>b\n", "no sequence")])
def test_fatal_fasta(spark, tmp_path, text, said):
    path = tmp_path / "x.fasta"
    path.write_text(text)
    with pytest.raises(Exception, match=said):
        read_fasta(spark, str(path)).collect()


def test_fasta_lines(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_bytes(b"\n>a <1>2\r\n AC\r\n\r\nGT \n>b>c\nA\n\n")
    assert [(r.header, r.sequence) for r in read_fasta(spark, str(path)).orderBy("ordinal").collect()] == [("a <1>2", "ACGT"), ("b>c", "A")]
