"""Sources by ranges of bytes: each record is read once, wherever the borders fall."""

import gzip
import io
import random
import tarfile
import zipfile

import pytest

from cladewise.sources import fasta, ranges, taxdump
from cladewise.sources.ranges import DataError

AWKWARD = b"\n  \n>a <1>2\r\n AC\r\n\r\nGT \n >b>c\nA\n>>d\nACG\n\xc2\xa0>e\xc3\xa9\n" + b"ACGT" * 9 + b"\n\n>f\nA>C\n>long " + b">" * 50 + b"\nT"


def plain(text):
    """(header, sequence), line by line."""
    out = []
    for line in map(str.strip, text.decode("utf-8", "replace").split("\n")):
        if line.startswith(">"):
            out.append([line[1:].strip(), ""])
        elif line:
            out[-1][1] += line
    return list(map(tuple, out))


def found(path, largest, member="", tasks=1 << 30):
    reader = fasta.FastaReader({"path": str(path), "member": member, "largest": largest, "tasks": tasks})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    places = [(r["ordinal"]["part"], r["ordinal"]["at"]) for r in rows]
    assert places == sorted(set(places))
    return [(r["header"], r["sequence"]) for r in rows], len(parts)


@pytest.mark.parametrize("block", [1, 3, 17, 1 << 20])
def test_every_border(tmp_path, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    path = tmp_path / "x.fasta"
    path.write_bytes(AWKWARD)
    for largest in range(1, len(AWKWARD) + 2):
        assert found(path, largest)[0] == plain(AWKWARD)


def test_random_files(tmp_path, monkeypatch):
    draw = random.Random(5)
    for k in range(60):
        monkeypatch.setattr(ranges, "BLOCK", draw.randint(1, 90))
        text = "".join(f">{i} {draw.choice(['x', '>', ''])}\n" + "".join("ACGT"[: draw.randint(1, 4)] * draw.randint(1, 30) + draw.choice(["\n", "\r\n", "\n\n"]) for _ in range(draw.randint(1, 4))) for i in range(draw.randint(0, 40))).encode()
        path = tmp_path / f"{k}.fasta"
        path.write_bytes(text)
        assert found(path, draw.randint(1, 200))[0] == plain(text)


@pytest.mark.parametrize("compression, kind", [("", "tar"), ("gz", "tar"), ("xz", "tar"), (zipfile.ZIP_STORED, "zip"), (zipfile.ZIP_DEFLATED, "zip")])
def test_members_stay_in_their_archives(tmp_path, compression, kind):
    path = tmp_path / "archive"
    held = {"in/other.fasta": b">no\nA\n", "in/x.fasta": AWKWARD, "in/after": b">no\nC\n"}
    if kind == "tar":
        with tarfile.open(path, f"w:{compression}") as archive:
            for name, text in held.items():
                info = tarfile.TarInfo(name)
                info.size = len(text)
                archive.addfile(info, io.BytesIO(text))
    else:
        with zipfile.ZipFile(path, "w", compression) as archive:
            for name, text in held.items():
                archive.writestr(name, text)
    rows, parts = found(path, 20, "in/x.fasta")
    assert rows == plain(AWKWARD)
    assert (parts > 5) == (compression in ("", zipfile.ZIP_STORED))
    with pytest.raises(DataError, match="has no nope"):
        found(path, 20, "nope")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["archive"]


def test_gzip_files(tmp_path):
    path = tmp_path / "x.fasta.gz"
    path.write_bytes(gzip.compress(AWKWARD[:40]) + gzip.compress(AWKWARD[40:]) + bytes(30))
    assert found(path, 5) == (plain(AWKWARD), 1)
    path.write_bytes(gzip.compress(AWKWARD)[:-9])
    with pytest.raises(DataError, match="within a member"):
        found(path, 5)


@pytest.mark.parametrize("text, said", [(b"ACGT\n>a\nAC\n", "before the first header"), (b" \n" * 20 + b"A\n", "before the first header"), (b"> \nACGT\n", "empty header at byte 0"), (b">a\n>b\nACGT\n", "no sequence: a"), (b">a\nAC\n>b\n \n", "no sequence: b")])
def test_faults_at_any_width(tmp_path, text, said):
    path = tmp_path / "x.fasta"
    path.write_bytes(text)
    for largest in range(1, len(text) + 1):
        with pytest.raises(DataError, match=said):
            found(path, largest)


def test_folders_and_small_files(tmp_path):
    for k in range(30):
        (tmp_path / f"{k:02}.fasta").write_bytes(b">%d\nAC\n" % k)
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / ".x.crc").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    rows, parts = found(tmp_path, 1000)
    assert rows == [(str(k), "AC") for k in range(30)] and parts == 1
    assert found(tmp_path, 16)[1] > 10
    with pytest.raises(DataError, match="does not exist"):
        found(tmp_path / "nope", 5)


@pytest.mark.parametrize("text", ["", "a\t|\tb\t|\n\t|\t\t|\n", "1\t|\t2\t|\r\n3\t|\n\n4\t|\t5"])
def test_dump_lines(tmp_path, text):
    path = tmp_path / "x.dmp"
    path.write_text(text, newline="")
    want = [x.removesuffix("\r").removesuffix("\t|").split("\t|\t") for x in text.removesuffix("\n").split("\n")] if text else []
    for largest in range(1, len(text) + 2):
        reader = taxdump.DumpReader({"path": str(path), "largest": largest, "tasks": 1 << 30})
        assert [r["f"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == want


def test_dump_in_its_zip(spark, tmp_path):
    line = lambda *fields: "\t|\t".join(fields) + "\t|\n"
    nodes = line("1", "0", "genus", "x") + line("2", "1", "species", "x") + line("3", "1", "clade", "x")
    names = line("1", "Gen", "", "", "Fam", "", "", "Phy", "Fungi", "Eukaryota") + line("2", "Gen vulgaris", "", "Gen", "Fam", "", "", "Phy", "Fungi", "Eukaryota") + line("3", "x", *[""] * 6, "", "Eukaryota")
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("nodes.dmp", nodes)
        archive.writestr("rankedlineage.dmp", names)
    rows = taxdump.read_dump(spark, str(tmp_path / "d.zip")).orderBy("species").collect()
    assert [(r.phylum, r.family, r.genus, r.species, r.kingdom) for r in rows] == [("Phy", "Fam", "Gen", None, "Fungi"), ("Phy", "Fam", "Gen", "Gen vulgaris", "Fungi")]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as archive:
        archive.writestr("nodes.dmp", nodes)
    with pytest.raises(DataError, match="no rankedlineage"):
        taxdump.read_dump(spark, str(tmp_path / "e.zip"))


def test_one_scan(spark, tmp_path):
    (tmp_path / "x.fasta").write_bytes(AWKWARD)
    out = fasta.read_fasta(spark, str(tmp_path / "x.fasta"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert [(r.header, r.sequence) for r in out.orderBy("ordinal").collect()] == plain(AWKWARD)
    named = spark.read.format("fasta").option("path", str(tmp_path / "x.fasta")).option("largest", 9).option("tasks", 99).load()
    assert sorted((r.header, r.sequence) for r in named.collect()) == sorted(plain(AWKWARD))
