"""Token banks: flat files written by many tasks, read by position."""

from pathlib import Path

import pytest
import pyspark.sql.functions as F

from cladewise.sources import bank

CODES = {"A": 1, "C": 2, "G": 3, "T": 4}


def sequence(i):
    return "".join("ACGTN"[(i * 7 + k * k) % 5] for k in range((i * 13) % 40))


def coded(text):
    return bytes(CODES.get(x, 5) for x in text or "")


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """200 rows in files of 16, and where they lie."""
    path = str(tmp_path_factory.mktemp("bank") / "train")
    rows = [(f"k{i:03d}", sequence(i) if i != 5 else None, i * 3, -100 if i % 2 else i) for i in range(200)]
    frame = spark.createDataFrame(rows, "key string, sequence string, y int, z long").repartition(7)
    bank.write_bank(frame, path, ["key"], ["y", "z"], 16)
    return path, rows


def test_round_trip(spark, held):
    path, rows = held
    found = bank.read_bank(spark, path)
    assert found.columns == ["ordinal", "offset", "length", "tokens", "y", "z"]
    at = 0
    for i, (r, (_, text, y, z)) in enumerate(zip(found.orderBy("ordinal").collect(), rows, strict=True)):
        want = coded(text)
        assert (r.ordinal, r.offset, r.length, bytes(r.tokens), r.y, r.z) == (i, at, len(want), want, y, z)
        at += len(want)
    assert bank.bank_check(spark, path).first().asDict() == {"n": 200, "n_tokens": at, "n_bytes": at, "whole": True}


def test_files_are_flat(spark, held):
    path, rows = held
    files = sorted(Path(path).glob("*.tokens"))
    assert len(files) == 13 and b"".join(f.read_bytes() for f in files) == b"".join(coded(r[1]) for r in rows)


def test_take(spark, held, monkeypatch):
    path, rows = held
    monkeypatch.setattr(bank, "REPEATS", 8)  # a hot ordinal is dealt to several tasks
    asked = [3, 199, 3, 0, 5, *[17] * 50]
    found = bank.take_from_bank(spark, path, spark.createDataFrame([(x,) for x in asked], "ordinal int"))
    want = sorted((x, coded(rows[x][1]), rows[x][2], rows[x][3]) for x in asked)
    assert sorted((r.ordinal, bytes(r.tokens), r.y, r.z) for r in found.collect()) == want
    assert bank.take_from_bank(spark, path, spark.createDataFrame([], "ordinal int")).count() == 0


@pytest.mark.parametrize("ordinal", [-1, 200, None])
def test_take_outside(spark, held, ordinal):
    with pytest.raises(Exception, match="not an ordinal"):
        bank.take_from_bank(spark, held[0], spark.createDataFrame([(ordinal,)], "ordinal int")).collect()


class Counted:
    def __init__(self, data):
        self.data, self.read = data, []

    def read_at(self, n, at):
        self.read.append((at, n))
        return self.data[at : at + n]


def test_only_ranges_asked_for_are_read():
    source = Counted(bytes(range(256)) * 4096)
    starts = [10, 30, 500_000, 900_000]
    found = list(bank.pieces(source, starts, [20, 40, 500_100, 900_000]))
    assert found == [source.data[10:20], source.data[30:40], source.data[500_000:500_100], b""]
    assert source.read == [(10, 30), (500_000, 100), (900_000, 0)]
    repeated = Counted(b"abcdef")
    assert list(bank.pieces(repeated, [1, 1, 2], [3, 3, 4])) == [b"bc", b"bc", b"cd"] and repeated.read == [(1, 3)]
    with pytest.raises(bank.DataError):
        list(bank.pieces(repeated, [4], [9]))


def test_other_files_are_not_opened(spark, held, tmp_path):
    path, rows = held
    copy = tmp_path / "copy"
    import shutil

    shutil.copytree(path, copy)
    for f in copy.iterdir():
        if f.suffix in (".tokens", ".index") and not f.name.startswith("000000000002-"):
            f.unlink()
    found = bank.take_from_bank(spark, str(copy), spark.createDataFrame([(40,)], "ordinal int")).first()
    assert bytes(found.tokens) == coded(rows[40][1])
    assert not bank.bank_check(spark, str(copy)).first().whole


def test_damage_is_told(spark, held, tmp_path):
    import shutil

    for kind, cut in (("tokens", 1), ("index", 8)):
        copy = tmp_path / kind
        shutil.copytree(held[0], copy)
        one = sorted(copy.glob(f"*.{kind}"))[3]
        one.write_bytes(one.read_bytes()[:-cut])
        (copy / f".{one.name}.crc").unlink(missing_ok=True)
        assert not bank.bank_check(spark, str(copy)).first().whole


def test_empty_replaced_and_refused(spark, tmp_path):
    path = str(tmp_path / "b")
    schema = "k int, sequence string, y int"
    bank.write_bank(spark.createDataFrame([(1, "ACGT", 1)], schema), path, ["k"], ["y"])
    bank.write_bank(spark.createDataFrame([], schema), path, ["k"], ["y"])
    assert bank.read_bank(spark, path).count() == 0 and bank.read_bank(spark, path).columns[-1] == "y"
    assert bank.bank_check(spark, path).first().asDict() == {"n": 0, "n_tokens": 0, "n_bytes": 0, "whole": True}
    with pytest.raises(Exception, match="holds a null"):
        bank.write_bank(spark.createDataFrame([(1, "ACGT", None)], schema), path, ["k"], ["y"])
    assert bank.bank_check(spark, path).first().n == 0 and not (tmp_path / "b.part").exists()  # the earlier one stays
    with pytest.raises(ValueError, match="whole numbers"):
        bank.write_bank(spark.createDataFrame([(1, "ACGT", 1)], schema), path, ["k"], ["sequence"])


def test_files_of_lost_attempts_go(spark, tmp_path):
    for name in ("a.tokens", "a.index", "b.tokens", "b.index", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    bank.swept(str(tmp_path), {"a"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.index", "a.tokens", "other.txt"]


def test_clashing_names(spark, tmp_path):
    path = str(tmp_path / "b")
    frame = spark.createDataFrame([(2, "GG", 7, 0), (1, "A", 8, 9)], "_ordinal int, sequence string, file int, _amount int")
    bank.write_bank(frame, path, ["_ordinal"], ["file", "_amount"])
    assert [(bytes(r.tokens), r.file, r._amount) for r in bank.read_bank(spark, path).orderBy("ordinal").collect()] == [(b"\1", 8, 9), (b"\3\3", 7, 0)]
    assert bank.read_bank(spark, path).where(F.col("length") > 1).count() == 1
