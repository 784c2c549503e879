"""The curation operators on small rows."""

import hashlib
import gzip
import json
import math
import random
import tarfile
from pathlib import Path

import numpy as np
import pyspark.sql.functions as F
import pytest

from cladewise.functions import exprs, hashing, storage
from cladewise.functions.schema import Filters, Mutation, Oversampling, Split, Training
from cladewise.operators import backbone, batches, encoders, labels, merge, metrics, oversampling, split, training
from cladewise.sources import remote
from cladewise.sources.fasta import DataError, read_fasta_member

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
ECOLI = ("Bacteria", "Pseudomonadota", "Gamma", "Enterobacterales", "Entero", "Escherichia", "E coli")
PSEUDO = ("Bacteria", "Pseudomonadota", "Gamma", "Pseudomonadales", "Pseudo", "Pseudomonas", None)
SCHEMA = "seq_hash string, source string, accession string, sequence string, length int, n_ambiguous int, marker string, source_ordinal int, ordinal int, kingdom string, " + ", ".join(f"`{r}` string" for r in RANKS)


def staged(spark, *rows):
    made = [(h, s, a, "ACGT", 4, 0, m, o, i, k, *names) for i, (h, s, a, names, k, m, o) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def row(h, s, a, names, kingdom="Bacteria", marker="ssu", ordinal=0):
    return h, s, a, names, kingdom, marker, ordinal


def one(spark, *rows):
    return merge.merged(staged(spark, *rows)).collect()


def names_of(r):
    return tuple(r[x] for x in RANKS)


def test_merge_of_equal_lineages(spark):
    (r,) = one(spark, row("a", "silva", "x", ECOLI, marker="its", ordinal=5), row("a", "gtdb", "y", ECOLI), row("a", "gtdb", "y", ECOLI))
    assert names_of(r) == ECOLI and not r.label_conflict and r.n_records == 3 and r.marker == "ssu"
    assert r.sources == ["gtdb", "silva"] and r.accessions == ["gtdb:y", "gtdb:y", "silva:x"]


def test_shallower_is_no_conflict(spark):
    (r,) = one(spark, row("a", "s", "x", ECOLI), row("a", "s", "y", ECOLI[:3] + (None,) * 4))
    assert names_of(r) == ECOLI and not r.label_conflict


def test_only_the_common_ancestor_stays(spark):
    (r,) = one(spark, row("a", "s", "x", ECOLI), row("a", "s", "y", PSEUDO))
    assert names_of(r) == ECOLI[:3] + (None,) * 4 and r.label_conflict


def test_a_missing_parent_conflicts_below(spark):
    (r,) = one(spark, row("a", "s", "x", ECOLI), row("a", "s", "y", ("Bacteria", None) + ECOLI[2:]))
    assert names_of(r) == ECOLI[:2] + (None,) * 5 and r.label_conflict


def test_domains_in_conflict_go(spark):
    rows = staged(spark, row("a", "s", "x", ECOLI), row("a", "s", "y", ("Archaea",) + ECOLI[1:]), row("b", "s", "z", PSEUDO, "Fungi"), row("b", "s", "w", PSEUDO, "Plantae"))
    out = merge.merged(rows)
    (r,) = out.collect()
    assert r.seq_hash == "b" and r.kingdom is None and r.label_conflict and names_of(r) == PSEUDO
    assert merge.merge_report(rows, out).first().asDict() == {"staged": 4, "unique": 2, "kept": 1, "merged": 1, "conflicts": 1, "domain_conflicts": 1}


def test_organisms(spark):
    cases = {
        "Escherichia coli strain K-12": ("Escherichia", "Escherichia coli"),
        "  Candidatus Novelbacter mysteriosus x": ("Novelbacter", "Novelbacter mysteriosus"),
        "Podospora sp. 1": ("Podospora", None),
        "uncultured bacterium": ("uncultured", None),
        "Metagenome thing": ("Metagenome", None),
        "Rhodo bacterium": ("Rhodo", None),
        "Genus": ("Genus", None),
        "": ("", None),
        "Genus Species": ("Genus", None),
        "Genus x": ("Genus", None),
        "Genus well-known": ("Genus", "Genus well-known"),
    }
    frame = spark.createDataFrame([(c,) for c in cases], "o string").select("o", exprs.split_organism("o").alias("x"))
    assert {r.o: (r.x.genus, r.x.species) for r in frame.collect()} == cases


def test_scalars(spark):
    frame = spark.createDataFrame([(" ac gu\nN",)], "s string")
    r = frame.select(exprs.normalize_sequence("s").alias("n")).select("n", exprs.valid_sequence("n").alias("v"), exprs.count_ambiguous("n").alias("a"), exprs.reverse_complement("n").alias("r"), exprs.tokens("n").alias("t"), exprs.token_array("n").alias("y")).first()
    assert (r.n, r.v, r.a, r.r, bytes(r.t), r.y) == ("ACGTN", True, 1, "NACGT", b"\1\2\3\4\5", [1, 2, 3, 4, 5])
    r = spark.createDataFrame([("a b c",), ("abc",)], "s string").select(exprs.cut_at("s", " ").alias("x")).collect()
    assert [tuple(x.x) for x in r] == [("a", True, "b c"), ("abc", False, "")]


def test_hashes(spark):
    frame = spark.createDataFrame([("ACGT",), (None,)], "s string").select(hashing.sequence_hash("s").alias("h"))
    assert frame.first().h.hex() == "f9f322ef1b905091d65847bc9eeec665" and frame.collect()[1].h is None
    assert hashing.unit_interval(b"key", 1, "sequence") == 0.20878325878459353
    assert hashing.unit_interval(b"key", 2, "sequence") == 0.2697834057223733
    assert hashing.unit_interval(b"key", 1, "novel-genus") == 0.21130222143800526
    assert hashing.copy_seed(b"parent", 0, 20260922) == 9376870525715860351
    assert abs(frame.where("h is not null").select(hashing.draw("h", 20260922, "sequence").alias("d")).first().d - 0.3688361705451472) < 1e-15


def test_split_is_by_hash_and_genus(spark):
    rows = [(f"{i:05d}".encode(), *("D", "P", "C", "O", f"F{i % 20}", f"G{i % 100}", None)) for i in range(5000)]
    frame = spark.createDataFrame(rows, "seq_hash binary, " + ", ".join(f"`{r}` string" for r in RANKS))
    out = {bytes(r.seq_hash): r.split for r in split.with_split(frame).collect()}
    again = {bytes(r.seq_hash): r.split for r in split.with_split(frame.orderBy(F.desc("seq_hash")).repartition(7)).collect()}
    assert out == again
    share = {s: sum(x == s for x in out.values()) / 5000 for s in ("train", "val", "test", "test_novel_genus")}
    assert share["train"] > 0.8 and 0.03 < share["val"] < 0.07 and 0.03 < share["test"] < 0.07
    novel = {r.genus_key for r in split.novel_genera(frame).collect()}
    assert all((f"D;P;C;O;F{i % 20};G{i % 100}" in novel) == (out[f"{i:05d}".encode()] == "test_novel_genus") for i in range(5000))


def test_only_children_are_not_held_out(spark):
    frame = spark.createDataFrame([(str(i).encode(), "D", "P", "C", "O", f"F{i % 50}", f"G{i % 50}", None) for i in range(500)], "seq_hash binary, " + ", ".join(f"`{r}` string" for r in RANKS))
    assert split.novel_genera(frame, Split(novel_genus=0.99)).count() == 0


def test_apportionment(spark):
    plan = spark.createDataFrame([("A", "a1", 3), ("A", "a2", 3), ("A", "a3", 3), ("B", "b1", 4)], "group string, key string, copies long")
    budgets = spark.createDataFrame([("A", 7), ("B", 10)], "group string, budget long")
    assert {r.key: r.allotted for r in oversampling.apportion(plan, budgets).collect()} == {"a1": 3, "a2": 2, "a3": 2, "b1": 4}
    members = spark.createDataFrame([("k", h, 3, 7) for h in "abc"], "key string, seq_hash string, size long, allotted long")
    assert {r.seq_hash: r.copies for r in oversampling.distribute(members).collect()} == {"a": 3, "b": 2, "c": 2}
    sizes = spark.createDataFrame([("g", "x", 1), ("g", "y", 8), ("g", "z", 50)], "group string, key string, size long")
    assert {r.key: r.copies for r in oversampling.plan_copies(sizes, 20, 5).collect()} == {"x": 5, "y": 12}


def test_mutations():
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(400))
    assert oversampling.mutate(s, Mutation(0, 0, 0), random.Random(1)) == s
    out = oversampling.mutate(s, Mutation(1.0, 0, 0), random.Random(1))
    assert len(out) == 400 and all(a != b for a, b in zip(s, out))
    assert oversampling.mutate(s, Mutation(0, 0, 1.0), random.Random(1)) == ""
    assert len(oversampling.mutate(s, Mutation(0, 1.0, 0), random.Random(1))) == 800
    assert oversampling.copy_of(s, b"p", 0, Oversampling()) == oversampling.copy_of(s, b"p", 0, Oversampling()) != oversampling.copy_of(s, b"p", 1, Oversampling())
    still = Oversampling(mutation=Mutation(0, 0, 0))
    assert oversampling.copy_of("ACGT", b"p", 0, still) == "CCGT" and oversampling.copy_of("CCGT", b"p", 0, still) == "ACGT"
    assert len(oversampling.crop(s, 20, 30, random.Random(1))) in range(20, 31) and oversampling.crop("ACG", 20, 30, rng) == "ACG"
    assert oversampling.augment("AACG", Mutation(0, 0, 0, reverse_complement=1.0), rng) == "CGTT"


def test_labels(spark):
    rows = [("D", "K", "P", "C", None, None, None, None)] * 3 + [("D", "K", "Q", None, None, None, None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, domain string, kingdom string, phylum string, `class` string, `order` string, family string, genus string, species string")
    space = labels.label_space(frame, 3)
    assert {(r.level, r.class_key): r.class_index for r in space.collect()} == {("domain", "D"): 0, ("kingdom", "K"): 0, ("phylum", "D;P"): 0, ("class", "D;P;C"): 0}
    coded = {r.i: (r.y_domain, r.y_phylum, r.y_class, r.y_species) for r in labels.encode(frame, space, ["i"]).collect()}
    assert coded[0] == (0, 0, 0, -100) and coded[3] == (0, -100, -100, -100)
    again = labels.from_json(spark, labels.to_json(space, 3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, space.collect()))


def test_level_report(spark):
    frame = spark.createDataFrame([("genus", t, p) for t, p in zip([0, 0, 1, 2, -100], [0, 1, 1, 1, 0])] + [("species", -100, 0)], "level string, target int, predicted int")
    r = metrics.level_report(metrics.class_counters(frame)).where("level = 'genus'").first()
    assert r.accuracy == 0.5 and r.support == 4 and r.classes == 3
    assert np.allclose([r.macro_precision, r.macro_recall, r.macro_f1], [(1 + 1 / 3) / 3, 0.5, (2 / 3 + 0.5) / 3])
    assert np.allclose([r.weighted_precision, r.weighted_f1], [(2 + 1 / 3) / 4, (4 / 3 + 0.5) / 4])


def test_batches(spark):
    frame = spark.createDataFrame([(i, "ACGT" * (1 + i % 5), 4 * (1 + i % 5)) for i in range(50)], "i int, sequence string, length int")
    bank = batches.token_bank(frame, ["i"]).orderBy("i").collect()
    at = 0
    for r in bank:
        assert r.offset == at and bytes(r.tokens) == b"\1\2\3\4" * (1 + r.i % 5)
        at += r.length
    made = batches.padded(batches.bucket_by_length(frame, ["i"], 4, 3), 12).collect()
    assert all(len(r.padded) == r.width <= 12 and r.n_tokens == min(12, r.length) for r in made)
    turns = batches.shuffled_batches(batches.bucket_by_length(frame, ["i"], 4, 3), 4, 1).orderBy("turn").collect()
    assert [r.size for r in turns] == [4] * 12 + [2]
    keyed = frame.withColumn("h", F.encode(F.col("i").cast("string"), "UTF-8")).withColumn("w", F.when(F.col("i") < 10, 9.0).otherwise(1.0))
    drawn = batches.weighted_sample(keyed, "w", 1300, 1, "h").groupBy(F.col("i") < 10).count().collect()
    assert {r[0]: round(r[1], -2) for r in drawn} == {True: 900, False: 400}
    assert batches.validation_subset(keyed, 7, 1, "h").count() == 7 and batches.validation_subset(keyed, 99, 1, "h").count() == 50


def test_weighted_sample_is_exact(spark, monkeypatch):
    """Each draw takes the row it falls on, a heavy row over many cells and rows without weight as well."""
    monkeypatch.setattr(batches, "MOST_CELLS", 7)
    weights = [0.0, 2.5, None, 40.0, 0.25, -1.0, 1.0, 0.0, 3.0]
    rows = spark.createDataFrame([(f"k{i}", w, "x" * i) for i, w in enumerate(weights)], "k string, w double, extra string")
    got = {r.draw: r.k for r in batches.weighted_sample(rows, "w", 500, 3, "k", "md5").collect()}
    units = [max(0, round((w or 0) * batches.WEIGHT_UNITS)) for w in weights]
    for i in range(500):
        point = int(int(hashlib.md5(f"{i}|3|sample".encode()).hexdigest()[:15], 16) / 2**60 * sum(units))
        at = next(k for k in range(len(units)) if sum(units[: k + 1]) > point)
        assert got[i] == f"k{at}"
    assert len(got) == 500
    assert batches.weighted_sample(rows, "w", 0, 3, "k", "md5").count() == 0
    assert batches.weighted_sample(rows.where("w = 0"), "w", 5, 3, "k", "md5").count() == 0
    with pytest.raises(ValueError):
        batches.weighted_sample(rows, "w", -1, 3, "k")


def test_crops(spark):
    rows = spark.createDataFrame([(f"k{i}", "".join(random.Random(i).choices("ACGT", k=i))) for i in range(60)], "k string, sequence string").withColumn("length", F.length("sequence"))
    was = {r.k: r.sequence for r in rows.collect()}
    for impl in ("md5", "blake2b"):
        made = {r.k: r for r in batches.cropped(rows, 1.0, 5, 20, 1, "k", impl).collect()}
        assert all(r.length == len(r.sequence) and r.sequence in was[k] for k, r in made.items())
        assert all(r.sequence == was[k] for k, r in made.items() if len(was[k]) <= 5)
        assert all(5 <= r.length <= 20 for k, r in made.items() if len(was[k]) > 20)
        assert len({r.length for r in made.values()}) > 8
    assert batches.cropped(rows, 0.0, 5, 20, 1, "k", "md5").where(F.length("sequence") != F.substring("k", 2, 3).cast("int")).count() == 0
    with pytest.raises(ValueError):
        batches.cropped(rows, 0.5, 9, 8, 1, "k")


def test_chunks(spark):
    rows = spark.createDataFrame([(i,) for i in range(25)], "i int").repartition(5)
    told = list(batches.chunks(rows, ["i"], 10))
    assert [len(c) for c in told] == [10, 10, 5] and [r.i for c in told for r in c] == list(range(25))
    assert list(batches.chunks(rows.where("i < 0"), ["i"], 10)) == []
    with pytest.raises(ValueError):
        batches.chunked(rows, ["i"], 0)


def test_fingerprint(spark):
    hashes = [hashlib.md5(str(i % 40).encode()).hexdigest() for i in range(60)]
    told = lambda x, parts=3: batches.fingerprint(spark.createDataFrame([(h,) for h in x], "seq_hash string").repartition(parts)).first()[0]
    assert told(hashes) == told(hashes[::-1], 5) != told(hashes[1:])
    assert told(hashes[:40]) != told(hashes[:40] + hashes[:1])
    assert told([]) == hashlib.md5(b"").hexdigest()


@pytest.mark.parametrize("bad", [lambda: Filters(0, 5), lambda: Filters(5, 4), lambda: Split(validation=0.6, test=0.5), lambda: Split(seed=-1), lambda: Oversampling(rank="tribe"), lambda: Oversampling(floor=0), lambda: Mutation(substitution=2), lambda: Training(epochs=0), lambda: encoders.Cnn(kernel=4), lambda: encoders.Transformer(width=60), lambda: encoders.Heads(()), lambda: remote.RemoteFile("http://x.org/a"), lambda: remote.RemoteFile("https://x.org/a", "AB"), lambda: remote.PagedQuery(" ", "a.gz")])
def test_configurations(bad):
    with pytest.raises(ValueError):
        bad()


def test_backbone(spark):
    taxa = spark.createDataFrame([("Eu", "P", None, None, None, None, None, "Fungi"), ("Eu", "P", None, None, None, "G", None, "Fungi"), ("Eu", "Q", None, None, None, "G", None, "Plantae"), ("Eu", "P", None, None, None, "H", "H s", None), ("Ba", "Q", None, None, None, "G", None, None)], ", ".join(f"`{r}` string" for r in RANKS) + ", kingdom string")
    entries = backbone.entries_of_lineages(taxa)
    unique = {(r.kind, r.name, r.domain): r.lineage.phylum for r in backbone.unique_in_domain(entries).collect()}
    assert unique == {("taxon", "P", "Eu"): "P", ("species", "H s", "Eu"): "P", ("taxon", "G", "Ba"): "Q"}
    assert backbone.size(entries).first().n == 3
    assert {r.kingdom for r in backbone.kingdoms(entries).collect()} == {"Fungi", "Plantae"}


# Model


@pytest.mark.parametrize("encoder", [encoders.Cnn(8, (8, 12), 3, (1, 2), 10), encoders.Transformer(8, 16, 4, 2, 2, 2)])
def test_encoders(spark, encoder):
    heads = encoders.Heads((2, 3), 4)
    w = encoders.init(encoder, heads, 1)
    assert sum(x.size for x in w.values()) == encoders.count(encoder, heads)
    x = np.random.RandomState(0).randint(1, 5, 37).astype(np.uint8)
    features = encoders.encode(w, encoder, x)
    assert features.shape == (encoder.output,) and np.isfinite(features).all()
    assert np.isfinite(encoders.encode(w, encoder, x[:1])).all()
    p = encoders.chained(w, features, 2)
    assert [len(q) for q in p] == [2, 3] and all(abs(q.sum() - 1) < 1e-9 for q in p)
    frame = spark.createDataFrame([(b"a", bytearray(x)), (b"b", bytearray(x[:5]))], "seq_hash binary, tokens binary")
    out = encoders.predict(frame, w, encoder, heads).orderBy("seq_hash").collect()
    assert out[0].predicted == [int(q.argmax()) for q in p] and abs(out[0].confidence[0] - p[0].max()) < 1e-4
    assert encoders.predict(frame, w, encoder, heads, 1.0).first().predicted == [-1, -1]


def test_rotation_depends_on_distance():
    q = encoders.rotated(np.tile(np.random.RandomState(0).randn(1, 8), (9, 1)))
    assert np.allclose(q[1] @ q[3], q[5] @ q[7]) and abs(float(encoders.erf(np.array(0.5))) - 0.5204998778) < 1e-6


def test_slopes_are_those_of_the_loss():
    rng = np.random.RandomState(0)
    x, y, wt = rng.randn(6, 5), np.array([[0, 1, 2], [1, -100, 0], [0, 0, -100], [1, 2, 1], [-100, 1, 1], [0, 2, 2]]), rng.rand(6)
    p = training.init(5, [2, 3, 3], 4, 0)
    p = {n: a * 30 for n, a in p.items()}
    loss = lambda q: training.slopes(q, x, y, wt, 3)[1][:, 0].sum()
    grads, _ = training.slopes(p, x, y, wt, 3)
    for n in p:
        for at in [(0, 0), (p[n].shape[0] - 1, 1)]:
            up, down = ({**p, n: p[n].copy()} for _ in range(2))
            up[n][at] += 1e-5
            down[n][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grads[n][at]) < 1e-5 * (1 + abs(grads[n][at]))


def learnable(spark):
    rng = random.Random(0)
    rows = []
    for i in range(80):
        y = i % 2
        rows.append((str(i).encode(), "".join(rng.choices("ACGT", [8, 1, 1, 1] if y else [1, 1, 1, 8], k=60)), 60, 1.0 + y, 0, y, *([-100] * 6)))
    from cladewise.functions.schema import LEVELS

    return spark.createDataFrame(rows, "seq_hash binary, sequence string, length int, frequency double, " + ", ".join(f"y_{n} int" for n in LEVELS))


def test_training_learns_and_resumes(spark, tmp_path):
    frame = learnable(spark)
    train, held = training.prepared(frame, 2, 0.5), training.prepared(frame, 2)
    config = Training(epochs=4, learning_rate=0.3, weight_decay=0.0, warmup=0.0)
    sizes = [1, 2, 1, 1, 1, 1, 1, 1]
    _, whole = training.fit(train, held, sizes, config, str(tmp_path / "a"), steps_an_epoch=3)
    assert whole[-1].val_loss < whole[0].val_loss and whole[-1].accuracy["kingdom"] > 0.9
    training.fit(train, held, sizes, config, str(tmp_path / "b"), steps_an_epoch=3, watch=lambda e: e.epoch == 2)
    _, again = training.fit(train, held, sizes, config, str(tmp_path / "b"), steps_an_epoch=3, resume=True)
    assert [e.epoch for e in again] == [1, 2, 3, 4] and abs(again[-1].val_loss - whole[-1].val_loss) < 1e-9
    with pytest.raises(ValueError, match="another configuration"):
        training.fit(train, held, sizes, Training(epochs=5), str(tmp_path / "b"), steps_an_epoch=3, resume=True)


def test_search(tmp_path):
    def one(config, watch):
        if config.weight_decay > 0.15:
            raise ValueError
        for e in range(1, config.epochs + 1):
            if watch(training.Epoch(e, 1.0, 1.0, {"genus": config.sampling_power * e, "species": 0.0})):
                break

    done = training.search(one, Training(epochs=3), str(tmp_path), trials=25, seed=1)
    assert len(done) == 25 and {t["state"] for t in done} >= {"COMPLETE", "PRUNED"}
    best = json.loads((tmp_path / "best.json").read_text())
    assert best["value"] == max(t["value"] for t in done if t["state"] == "COMPLETE")
    assert training.choice(tmp_path / "best.json") == best["params"] == training.choice(tmp_path / "trials.json")
    assert training.choice(tmp_path / "trials.json", 3) == done[3]["params"]
    with pytest.raises(ValueError):
        training.choice(tmp_path / "trials.json", 99)


def test_search_goes_on(tmp_path):
    """A search stopped after some trials ends as one that wasn't."""
    def one(config, watch):
        for e in range(1, config.epochs + 1):
            if watch(training.Epoch(e, 1.0, 1.0, {"genus": config.sampling_power * e if config.warmup < 0.08 else math.nan, "species": 0.0})):
                break

    whole = training.search(one, Training(epochs=3), str(tmp_path / "a"), trials=12, seed=4)
    training.search(one, Training(epochs=3), str(tmp_path / "b"), trials=5, seed=4)
    again = training.search(one, Training(epochs=3), str(tmp_path / "b"), trials=12, seed=4)
    assert json.dumps(again) == json.dumps(whole) and len({t["params"]["learning_rate"] for t in again}) == 12
    lacking = [t for t in whole if t["params"]["warmup"] >= 0.08]
    assert lacking and all(t["state"] == "PRUNED" and len(t["epochs"]) == 1 for t in lacking)
    assert json.loads((tmp_path / "b" / "best.json").read_text())["params"]["warmup"] < 0.08
    assert len(training.search(one, Training(epochs=3), str(tmp_path / "b"), trials=3, seed=4)) == 12


def test_slopes_add_up_over_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(training, "FAN", 3)
    rng = np.random.RandomState(1)
    x, y, w = rng.randn(60, 4), rng.randint(0, 3, (60, 2)), rng.rand(60)
    rows = [(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, y, w)]
    params = training.init(4, [3, 3], 2, 0)
    grads, told = training.slopes(params, x, y, w, 2)
    for n in (1, 3, 10):
        frame = spark.createDataFrame(rows, "features array<double>, targets array<int>, weight double").repartition(n)
        got, sums = training.summed(frame, params, 2)
        assert all(np.allclose(got[k], grads[k]) for k in grads) and np.allclose(sums, told)


def test_text_helpers():
    assert training.duration(59) == "59 s" and training.duration(125) == "2 m 05 s" and training.duration(7260) == "2 h 01 m"
    assert training.bar(1, 2, 4) == "██░░"
    assert training.table([{"level": "genus", "accuracy": 0.5, "n": 3}], ("level", "accuracy", "n")) == "level  accuracy  n\ngenus    0.5000  3"


# Files and the network


def test_downloads(tmp_path):
    import hashlib

    body = b"hello" * 100
    good = remote.RemoteFile("https://x.org/d/a.gz", hashlib.sha256(body).hexdigest())
    calls = []

    def opener(url):
        calls.append(url)
        yield body[:7]
        yield body[7:]

    assert remote.download(good, tmp_path, opener).read_bytes() == body and remote.download(good, tmp_path, opener) and len(calls) == 1
    (tmp_path / "a.gz").write_bytes(b"other")
    with pytest.raises(remote.ChecksumMismatch):
        remote.download(good, tmp_path, opener)
    with pytest.raises(remote.ChecksumMismatch):
        remote.download(remote.RemoteFile("https://x.org/b.gz", "0" * 64), tmp_path, opener)
    assert not (tmp_path / "b.gz").exists() and not [*tmp_path.glob("*.part")]


def test_paged_query(tmp_path):
    pages, fails = {0: b">a\nAC\n>b\nGT", 2: b">c\nAA\n"}, [1]

    def opener(url):
        if "esearch" in url:
            return [json.dumps({"esearchresult": {"count": "3", "querykey": "1", "webenv": "W"}}).encode()]
        if fails:
            fails.pop()
            raise remote.DownloadError("busy")
        return [pages[int(url.split("retstart=")[1].split("&")[0])]]

    query, waits = remote.PagedQuery("x", "q.gz", batch=2), []
    path = remote.fetch(query, tmp_path, opener, 1.0, waits.append)
    assert gzip.open(path).read() == b">a\nAC\n>b\nGT\n>c\nAA\n" and waits[0] == 1.0
    pages[2] = b""
    with pytest.raises(remote.DownloadError, match="2 of 3"):
        remote.fetch(remote.PagedQuery("x", "r.gz", batch=2), tmp_path, opener, 0, waits.append)
    assert not (tmp_path / "r.gz").exists()


def test_tar_member(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a\nAC\nGT\n")
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        t.add(tmp_path / "x.fasta", "in/x.fasta")
    assert [tuple(r) for r in read_fasta_member(spark, str(tmp_path / "t.tgz"), "in/x.fasta", str(tmp_path / "out")).select("header", "sequence").collect()] == [("a", "ACGT")]
    with pytest.raises(DataError):
        read_fasta_member(spark, str(tmp_path / "t.tgz"), "nope", str(tmp_path / "out2"))


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.write_parquet(spark.range(10), path) == 10
    with pytest.raises(Exception):
        storage.write_parquet(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x")), path)
    assert spark.read.parquet(path).count() == 10 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_stream(spark, tmp_path):
    from cladewise.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fasta").write_text(">a x\nACGTACGTACGT\n>b\nACGTACGTACGT\n>c\nAC\n>d\nAC!T\n")
    rows = ingest.distinct_sequences(ingest.records(spark, str(folder), filters=Filters(10, 100, 0.01, ())))
    for _ in range(2):
        ingest.write(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 1 and out[0].length == 12


def test_cli(tmp_path):
    from cladewise.cli import main

    assert main(["nonsense"]) == 2 and main(["build", "--data-dir", str(tmp_path)]) == 1
    assert main(["augment", "--data-dir", str(tmp_path)]) == 1 and main(["train", "--data-dir", str(tmp_path)]) == 2
    assert not (Path(tmp_path) / "processed").exists()


def test_kmer_shares(spark):
    frame = spark.createDataFrame([("ACAC",), ("ANC",), ("A",), ("",)], "s string").select(training.kmer_shares("s", 2).alias("x"))
    out = [r.x for r in frame.collect()]
    assert out[0][1] == 2 / 3 and out[0][4] == 1 / 3 and sum(out[0]) == 1 and [sum(x) for x in out[1:]] == [0, 0, 0] and {len(x) for x in out} == {16}
