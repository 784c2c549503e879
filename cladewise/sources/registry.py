"""The public collections in the order that decides merges, and the taxonomy."""

from __future__ import annotations

from .remote import PagedQuery, RemoteFile, Source

# Addresses, releases and checksums of the public collections.
TAXONOMY = Source("ncbi_taxonomy_2026-09-01", "taxdump", ((RemoteFile("https://ftp.ncbi.nlm.nih.gov/pub/taxonomy/taxdump_archive/new_taxdump_2026-09-01.zip", "6b0670e633daee01196e2c15305771e39b5050d30c1b7ff4567dd635b37a9c76"), ()),))
SOURCES = (
    Source("gtdb_r232", "gtdb", ((RemoteFile("https://data.gtdb.ecogenomic.org/releases/release232/232.0/genomic_files_all/ssu_all_r232.fna.gz", "dc5268786cc6e758283b03f851e9c7478608afda4e7bf31c6f533b429e18919c"), ()),), backbone=True),
    Source("pr2_5.1.1", "pr2", ((RemoteFile("https://github.com/pr2database/pr2database/releases/download/v5.1.1/pr2_version_5.1.1_SSU_taxo_long.fasta.gz", "b9cef85537b49bf54d1033ad38a6cce1875123fb9f7c7c8f442aadccd2bbb8f5"), ()),)),
    Source("refseq_16s", "refseq", ((RemoteFile("https://ftp.ncbi.nlm.nih.gov/refseq/TargetedLoci/Bacteria/bacteria.16SrRNA.fna.gz"), (("domain", "Bacteria"), ("locus", "16S"))), (RemoteFile("https://ftp.ncbi.nlm.nih.gov/refseq/TargetedLoci/Archaea/archaea.16SrRNA.fna.gz"), (("domain", "Archaea"), ("locus", "16S"))))),
    Source("refseq_fungi_18s", "refseq", ((RemoteFile("https://ftp.ncbi.nlm.nih.gov/refseq/TargetedLoci/Fungi/fungi.18SrRNA.fna.gz"), (("domain", "Eukaryota"), ("locus", "18S"))),)),
    Source("eukribo_2", "eukribo", ((RemoteFile("https://zenodo.org/records/6896896/files/46346_EukRibo-02_full_seqs_2022-07-22.fas.gz", "62b19ff1dd1add45d6b4aed338a93bbbb6467da6b3549bec8bc93da2ee7dcf72"), ()),)),
    Source("silva_144", "silva", ((RemoteFile("https://www.arb-silva.de/fileadmin/silva_databases/release_144/Exports/SILVA_144_SSURef_tax_silva_trunc.fasta.gz", "2e8ce1f937ae81771c2b27d001f1bc5c09e09998fcca83a4a3b12c28df14b078"), ()),)),
    Source("midori2_gb272_coi", "midori2", ((RemoteFile("https://www.reference-midori.info/download/Databases/GenBank272_2026-06-07/SINTAX_sp/uniq/MIDORI2_UNIQ_NUC_SP_GB272_CO1_SINTAX.fasta.gz", "9f65efc6160d6c02d5f09bc1919212580c9ff3ea1e3dce1e86fa0de802cdf194"), (("marker", "coi"),)),)),
    Source("unite_2025-02-19", "unite", ((RemoteFile("https://s3.hpc.ut.ee/plutof-public/original/b02db549-5f04-43fc-afb6-02888b594d10.tgz", "b07021870a6a14cc5d4f0a3fe81b5cf41a3c16fb71525c7265f973f2c6750458"), ()),), member="sh_general_release_dynamic_s_all_19.02.2025.fasta"),
    Source("genbank_rbcl_2026-09-01", "genbank", ((PagedQuery("rbcL[Gene Name] AND Viridiplantae[Organism] AND 400:2000[SLEN] AND 1900/01/01:2026/09/01[PDAT]", "rbcl.fasta.gz"), (("marker", "rbcl"),)),)),
    Source("genbank_matk_2026-09-01", "genbank", ((PagedQuery("matK[Gene Name] AND Viridiplantae[Organism] AND 400:2500[SLEN] AND 1900/01/01:2026/09/01[PDAT]", "matk.fasta.gz"), (("marker", "matk"),)),)),
)
