"""The operators that are left: filters, null-safe joins, harmonisation, dumps, mutations, encoders, training, search."""

from __future__ import annotations

import tempfile
from dataclasses import replace

import pyspark.sql.functions as F

from ..functions import storage
from ..functions.exprs import tokens
from ..functions.schema import LEVELS, RANKS, Mutation, Oversampling, Training
from ..operators import backbone, batches, encoders, labels, oversampling, parsers, split, staging, trainer, training, tuning
from ..sources.taxdump import read_taxa
from .adapters import STAGED_SQL, balancing_sql, dataset_sql, key_sql, merged_sql, q, read, sequences, staged
from .catalog import query
from .merge_queries import dataset, labelled, merged
from .training_queries import BUCKETS, ENCODED, SPACE, hashed, made, train


@query("F04_split_filter", f"SELECT seq_hash FROM ({dataset_sql()}) WHERE split = 'train'")
def f04(spark, sf):
    return labelled(spark, sf).where("split = 'train'").select("seq_hash")


@query("F05_domain_filter", f"SELECT count(*) AS kept FROM ({merged_sql()}) WHERE domain IS NOT NULL")
def f05(spark, sf):
    return merged(spark, sf).where("domain is not null").agg(F.count(F.lit(1)).alias("kept"))


@query("F06_real_rows", f"SELECT count(*) AS n FROM ({dataset_sql()}) WHERE split = 'train'")
def f06(spark, sf):
    return oversampling.training_frame(*made(spark, sf)).where("not synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("M03_first_names", f"SELECT seq_hash, max(phylum) AS phylum, max(kingdom) AS kingdom FROM ({STAGED_SQL}) GROUP BY seq_hash HAVING count(DISTINCT domain) = 1 AND count(DISTINCT {key_sql('phylum')}) = 1 AND count(DISTINCT kingdom) = 1")
def m03(spark, sf):
    return merged(spark, sf).where("phylum is not null and kingdom is not null").select("seq_hash", "phylum", "kingdom")


@query("M06_cut_below_conflict", f"SELECT seq_hash, {', '.join(q(r) for r in RANKS)} FROM ({merged_sql()}) WHERE label_conflict")
def m06(spark, sf):
    return merged(spark, sf).where("label_conflict").select("seq_hash", *(f"`{r}`" for r in RANKS))


@query("M07_kingdom_conflict", f"SELECT seq_hash, kingdom FROM ({merged_sql()}) WHERE kingdom IS NULL")
def m07(spark, sf):
    return merged(spark, sf).where("kingdom is null").select("seq_hash", "kingdom")


@query("M08_label_conflict", f"SELECT label_conflict, count(*) AS n FROM ({merged_sql()}) GROUP BY 1")
def m08(spark, sf):
    return merged(spark, sf).groupBy("label_conflict").agg(F.count(F.lit(1)).alias("n"))


@query("J10_null_safe_join", f"WITH g AS (SELECT DISTINCT {key_sql('genus')} AS genus_key, {key_sql('family')} AS family_key FROM ({merged_sql()}) WHERE genus IS NOT NULL), f AS (SELECT family_key, count(*) AS n_siblings FROM g GROUP BY family_key) SELECT g.genus_key, g.family_key, f.n_siblings FROM g LEFT JOIN f ON g.family_key IS NOT DISTINCT FROM f.family_key")
def j10(spark, sf):
    genera = split.genus_sizes(merged(spark, sf)).select("genus_key", "family_key")
    siblings = genera.groupBy(F.col("family_key").alias("f")).agg(F.count(F.lit(1)).alias("n_siblings"))
    return genera.join(siblings, F.col("family_key").eqNullSafe(F.col("f")), "left").drop("f")


@query("J14_dictionary_default", f"WITH s AS ({SPACE}) SELECT v.seq_hash, coalesce(s.class_index, -100) AS y FROM ({dataset_sql()}) v LEFT JOIN s ON s.level = 'class' AND s.class_key = {key_sql('class')}")
def j14(spark, sf):
    rows = labelled(spark, sf)
    return labels.encode(rows, labels.label_space(rows.where("split = 'train'"), 3), ["seq_hash"], ("class",)).select("seq_hash", F.col("y_class").alias("y"))




@query("J06_with_species", "SELECT k AS ordinal, CASE WHEN k % 10 < 6 THEN 'P' || k % 10 % 2 END AS phylum, CASE WHEN k % 10 < 6 THEN 'G' || k % 10 END AS genus, CASE WHEN k % 10 < 6 AND k % 3 = 0 THEN 'G' || k % 10 || ' szero' END AS species, CASE WHEN k % 10 < 6 AND k % 3 = 0 THEN 'Fungi' WHEN k % 10 < 6 THEN 'Plantae' END AS kingdom FROM (SELECT p_partkey AS k FROM part)")
def j06(spark, sf):
    """J05 to J07 in one: genera 0 to 5 are known, each in one phylum; 6 and 7 in two; only the first species is known."""
    taxa = spark.range(10).where("id < 8").select(
        F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("p")) for kind in ("genus", "species") for p in (0, 1)))).alias("t"), F.concat(F.lit("G"), "id").alias("genus"), "id"
    ).where("id >= 6 or t.p = id % 2")
    names = {r: F.lit(None).cast("string") for r in RANKS} | {"domain": F.lit("Eukaryota"), "phylum": F.concat(F.lit("P"), F.col("t.p").cast("string")), "genus": F.col("genus"), "species": F.when(F.col("t.kind") == "species", F.concat(F.col("genus"), F.lit(" szero")))}
    entries = backbone.entries_of_lineages(taxa.select(*(c.alias(r) for r, c in names.items()), F.when(F.col("t.kind") == "species", "Fungi").otherwise("Plantae").alias("kingdom")))
    header = "concat('A', p_partkey, '.1.9 Eukaryota;', p_type, ';G', p_partkey % 10, ';G', p_partkey % 10, ' s', element_at(array('zero', 'one', 'two'), CAST(p_partkey % 3 AS INT) + 1))"
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.expr(header).alias("header"), F.lit("ACGT").alias("sequence"))
    return backbone.harmonise(parsers.silva(rows), entries).select("ordinal", "phylum", "genus", "species", "kingdom")


@query("A04_taxdump", "SELECT 'Eukaryota' AS domain, r_name AS phylum, CAST(NULL AS STRING) AS genus, 'Protista' AS kingdom FROM region UNION ALL SELECT 'Eukaryota', r_name, n_name, CASE n_nationkey % 3 WHEN 0 THEN 'Animalia' WHEN 1 THEN 'Plantae' ELSE 'Protista' END FROM nation JOIN region ON n_regionkey = r_regionkey")
def a04(spark, sf):
    """A dump of regions as phyla and nations as genera, written as its two files and read back."""
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kingdom = F.when(F.col("n_nationkey") % 3 == 0, "Metazoa").when(F.col("n_nationkey") % 3 == 1, "Viridiplantae").otherwise("x")
    taxa = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit("phylum").alias("rank"), F.col("r_name").alias("name"), F.lit("").alias("phylum"), F.lit("").alias("kingdom"))
    taxa = taxa.unionByName(nations.select((F.col("n_nationkey") + 100).alias("id"), F.lit("genus").alias("rank"), F.col("n_name").alias("name"), F.col("r_name").alias("phylum"), kingdom.alias("kingdom")))
    taxa = taxa.unionByName(taxa.withColumn("rank", F.lit("clade")).withColumn("id", F.col("id") + 1000))  # not canonical
    line = lambda *fields: F.concat(F.concat_ws("\t|\t", *fields), F.lit("\t|")).alias("value")
    nodes, lineages, none = storage.scratch(spark, "nodes"), storage.scratch(spark, "lineages"), F.lit("")
    taxa.select(line(F.col("id").cast("string"), F.lit("1"), "rank", F.lit("x"))).write.text(nodes)
    taxa.select(line(F.col("id").cast("string"), "name", none, none, none, none, none, "phylum", "kingdom", F.lit("Eukaryota"))).write.text(lineages)
    return read_taxa(spark, nodes, lineages).select("domain", "phylum", "genus", "kingdom")


@query("J15_taxid_join", "SELECT p_type AS phylum, p_brand AS \"class\", p_name AS genus, CASE p_partkey % 4 WHEN 0 THEN 'Animalia' WHEN 1 THEN 'Fungi' WHEN 2 THEN 'Plantae' ELSE 'Protista' END AS kingdom FROM part WHERE p_partkey % 5 <> 0")
def j15_taxids(spark, sf):
    """Parts as taxa of a dump: their ranks in one file, their names in the other, joined by id; each fifth has a rank of no interest."""
    parts = read(spark, sf, "part")
    line = lambda *fields: F.concat(F.concat_ws("\t|\t", *fields), F.lit("\t|")).alias("value")
    own, none = F.col("p_partkey").cast("string"), F.lit("")
    kingdom = F.element_at(F.array(*map(F.lit, ("Metazoa", "Fungi", "Viridiplantae", "x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    nodes, lineages = storage.scratch(spark, "nodes"), storage.scratch(spark, "lineages")
    parts.select(line(own, F.lit("1"), F.when(F.col("p_partkey") % 5 == 0, "clade").otherwise("genus"), F.lit("x"))).write.text(nodes)
    parts.select(line(own, "p_name", none, none, none, none, "p_brand", "p_type", kingdom, F.lit("Eukaryota"))).write.text(lineages)
    return read_taxa(spark, nodes, lineages).select("phylum", "class", "genus", "kingdom")


@query("A16_report_json", f"SELECT split, count(*) AS n FROM ({dataset_sql()}) GROUP BY split")
def a16(spark, sf):
    """A report as JSON rows, written and read back."""
    path = storage.scratch(spark, "report")
    labelled(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct("split", "n")).alias("value")).write.text(path)
    return spark.read.schema("split string, n long").json(path)


@query("T05_synthesize")
def t05(spark, sf):
    return made(spark, sf)[1].select("parent_seq_hash", "seq_hash", "length")


@query("T06_mutations")
def t06(spark, sf):
    """How far copies are from their parents' lengths."""
    rows, copies = made(spark, sf)
    both = copies.join(rows.select(F.col("seq_hash").alias("parent_seq_hash"), F.col("length").alias("was")), "parent_seq_hash")
    return both.groupBy((F.col("length") - F.col("was")).alias("longer")).agg(F.count(F.lit(1)).alias("n"))


@query("T08_augmentation")
def t08(spark, sf):
    """Copies that are cropped and turned round as well."""
    config = Oversampling(rank="class", floor=12, max_ratio=0.5, mutation=Mutation(crop_probability=0.5, reverse_complement=0.5))
    rows = storage.materialised(hashed(spark, sf, "sequence", "length"), "dataset")
    return oversampling.synthesised(rows, oversampling.planned(rows.where("split = 'train'"), config), config).select("seq_hash", "parent_seq_hash", "length")


@query("T12_label_space_of_real_rows", SPACE)
def t12(spark, sf):
    rows = train(spark, sf).withColumn("synthetic", F.lit(False))
    return labels.label_space(rows.where("not synthetic"), 3)


@query("T22_batches_in_order", f"SELECT batch, count(*) AS n, max(length) AS longest FROM ({BUCKETS}) GROUP BY batch")
def t22(spark, sf):
    rows = batches.bucket_by_length(sequences(spark, sf), ["doc_id"], 16, 8)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy("batch")


def small(spark, sf, encoder):
    heads = encoders.Heads((5, 6, 25, 25), 16)
    rows = sequences(spark, sf).where("sequence <> ''").select("doc_id", tokens("sequence").alias("tokens"))
    return encoders.predict(rows, encoders.init(encoder, heads, 1), encoder, heads, threshold=0.05, key="doc_id")


@query("C01_cnn_inference")
def c01(spark, sf):
    """A small network of fresh weights over all sequences: the arithmetic, not its answers."""
    return small(spark, sf, encoders.Cnn(8, (8, 16), 5, (1, 2), 16))


@query("C02_transformer_inference")
def c02(spark, sf):
    return small(spark, sf, encoders.Transformer(8, 32, 8, 8, 2, 4, 2))


def learnable(spark, sf):
    rows = storage.materialised(dataset(spark, sf, "sequence"))
    space = storage.materialised(labels.label_space(rows.where("split = 'train'"), 3))
    coded = storage.materialised(labels.encode(batches.class_frequencies(rows.where("split = 'train'"), "class"), space, ["seq_hash", "sequence", "frequency"]))
    sizes = {r["level"]: r["n"] for r in labels.level_sizes(space).collect()}  # a row for each level
    return coded, labels.encode(rows.where("split = 'val'"), space, ["seq_hash", "sequence"]), [max(1, sizes.get(n, 0)) for n in LEVELS]


@query("C07_training_history")
def c07(spark, sf):
    """Two epochs of the chained heads; their history."""
    coded, held, sizes = learnable(spark, sf)
    _, history = training.fit(training.prepared(coded, 2, 0.5), training.prepared(held, 2), sizes, Training(epochs=2, learning_rate=0.1), steps_an_epoch=2)
    return spark.createDataFrame([(e.epoch, e.loss, e.val_loss, e.accuracy["domain"]) for e in history], "epoch int, loss double, val_loss double, domain_accuracy double")


def trained(spark, sf, encoder, epochs=1):
    """An encoder trained on mini-batches over all training rows of the dataset: (weights, history, net, validation rows)."""
    coded, held, sizes = learnable(spark, sf)
    lengths = storage.materialised(coded.withColumn("length", F.length("sequence")), "coded")
    heads = encoders.Heads(tuple(sizes), 8)
    config = Training(epochs=epochs, batch_size=64, learning_rate=0.01, log_every=1000, crop_min=64, crop_max=128)
    return *trainer.train(lengths, storage.materialised(held, "held"), encoder, heads, config, workers=trainer.most_tasks(spark)), trainer.Net(encoder, heads), held


def history_frame(spark, history):
    rows = [(r.epoch, r.loss, r.val_loss, *(r.accuracy[n] for n in LEVELS)) for r in history]
    return spark.createDataFrame(rows, "epoch int, loss double, val_loss double, " + ", ".join(f"{n}_accuracy double" for n in LEVELS))


@query("C07_minibatch_history")
def c07_minibatches(spark, sf):
    """Weighted draws, length buckets, crops and barrier stages; the history of two epochs of a small CNN."""
    return history_frame(spark, trained(spark, sf, encoders.Cnn(8, (8, 16), 5, (1, 2), 16), 2)[1])


@query("C10_search_trials")
def c10(spark, sf):
    """Two trials at once over all training rows, drawn, judged and journaled as a search does."""
    coded, held, sizes = learnable(spark, sf)
    rows, held = storage.materialised(coded.withColumn("length", F.length("sequence")), "coded"), storage.materialised(held, "held")
    base = Training(epochs=1, batch_size=128, crop_min=64, crop_max=128)
    space = {n: tuning.SHARED[n] for n in ("dropout", "weight_decay", "sampling_power")}
    made = lambda p: (encoders.Transformer(8, 16, 8, 8, 1, 2, 2, p["dropout"]), encoders.Heads(tuple(sizes), 8, p["dropout"]), replace(base, learning_rate=0.01, weight_decay=p["weight_decay"], sampling_power=p["sampling_power"]))
    with tempfile.TemporaryDirectory() as folder:  # the driver's own files
        done = tuning.search_encoders(rows, held, tuple(sizes), "Transformer", base, f"{folder}/journal", tuning.Search(trials=2, epochs=1, together=2, levels=("domain", "kingdom")), space=space, made=made)
    return spark.createDataFrame([(t.number, t.state, t.value, t.bracket, *(t.params[n] for n in space)) for t in done.values()], "number int, state string, value double, bracket int, " + ", ".join(f"{n} double" for n in space))


@query("C02_trained_transformer")
def c02_trained(spark, sf):
    """The history of an epoch of a small transformer."""
    return history_frame(spark, trained(spark, sf, encoders.Transformer(8, 16, 8, 8, 1, 2, 2))[1])


@query("C08_trained_predictions")
def c08_trained(spark, sf):
    """What the CNN of one epoch says of each validation row."""
    w, _, net, held = trained(spark, sf, encoders.Cnn(8, (8, 16), 5, (1, 2), 16))
    rows = held.select("seq_hash", tokens("sequence").alias("tokens"))
    return encoders.predict(rows, w, net.encoder, net.heads, threshold=0.05)


@query("C08_predictions")
def c08(spark, sf):
    coded, held, sizes = learnable(spark, sf)
    params = training.init(16, sizes, 16, 1)
    targets = F.array(*(F.col(f"y_{n}").cast("int") for n in LEVELS))
    rows = held.select("seq_hash", training.kmer_shares("sequence", 2).alias("features"), targets.alias("targets"))
    return training.predictions(rows, params, len(LEVELS))


@query("T23_training_data", f"WITH s AS ({SPACE}) SELECT * FROM (SELECT seq_hash, CAST(count(*) OVER (PARTITION BY {balancing_sql('class')}) AS DOUBLE) AS frequency FROM ({dataset_sql()}) WHERE split = 'train') JOIN ({ENCODED.replace(chr(39) + 'val' + chr(39), chr(39) + 'train' + chr(39))}) USING (seq_hash)")
def t23(spark, sf):
    coded, held, sizes = learnable(spark, sf)
    return coded.select("seq_hash", "frequency", *(f"y_{n}" for n in LEVELS))


@query("G01_filtered_staging", f"SELECT count(*) AS n FROM ({STAGED_SQL}) WHERE length >= CASE marker WHEN 'coi' THEN 400 WHEN 'its' THEN 300 WHEN 'rbcl' THEN 400 WHEN 'matk' THEN 400 ELSE 500 END AND length <= CASE marker WHEN 'coi' THEN 2500 WHEN 'its' THEN 1500 WHEN 'rbcl' THEN 1600 WHEN 'matk' THEN 1800 ELSE 4000 END AND n_ambiguous <= CAST(0.01 AS DOUBLE) * length")
def g01_filtered(spark, sf):
    from ..functions.schema import Filters

    rows = staged(spark, sf).withColumn("exclusion", F.lit(None).cast("string"))
    return staging.filtered(rows, Filters()).where("exclusion is null").agg(F.count(F.lit(1)).alias("n"))


