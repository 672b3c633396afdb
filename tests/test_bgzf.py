"""Block gzip: read in splits, equal to what any gzip tool reads."""

import glob
import gzip
import random

import pytest

from strandline.sources import bgzf, gfa, lines


def packed(data):
    return b"".join(bgzf.deflated(data[i : i + bgzf.MEMBER]) for i in range(0, len(data), bgzf.MEMBER)) + bgzf.LAST


@pytest.fixture
def small_splits(spark):
    """Splits of some 40 KB: a block or two each."""
    names = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def some_lines():
    """Empty and short lines, letters of two bytes, one line of 900,000 characters over many splits."""
    r = random.Random(1)
    out = ["".join(r.choice("ACGTäé\t ") for _ in range(r.choice([0, 1, 30, 300]))) for _ in range(3000)]
    out.insert(500, "".join(r.choice("ACGT") for _ in range(900_000)))
    return out


def values(df):
    return [r["value"] for r in df.orderBy("line_no").collect()]


@pytest.mark.parametrize("end", ["\n", "", "\n\n"])
def test_lines_over_splits(spark, small_splits, tmp_path, end):
    want, path = some_lines(), tmp_path / "a.bgz"
    data = ("\n".join(want) + end).encode()
    path.write_bytes(packed(data))
    assert gzip.open(path).read() == data
    df = bgzf.read(spark, str(path))
    assert values(df) == want + [""] * (end == "\n\n")
    assert df.select("file").distinct().count() == 1 and df.select("line_no").distinct().count() == df.count()


def test_two_blocks_two_tasks(spark, small_splits, tmp_path):
    r = random.Random(2)
    text = "\n".join("S\ts%d\t%s" % (i, "".join(r.choice("ACGT") for _ in range(1000))) for i in range(110))
    (tmp_path / "a.bgz").write_bytes(bgzf.deflated(text.encode()[:60000]) + bgzf.deflated(text.encode()[60000:]) + bgzf.LAST)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
    table = spark.read.option("lineSep", bgzf.HEADER.decode("latin-1")).option("encoding", "ISO-8859-1").text(str(tmp_path / "a.bgz"))
    assert sum(1 for n in table.rdd.glom().map(len).collect() if n) >= 2
    got = gfa.segments(bgzf.read(spark, str(tmp_path / "a.bgz")))
    assert [(x.node, x.len) for x in got.orderBy("node").collect()] == [(i, 1000) for i in range(110)]


def test_several_files_are_apart(spark, small_splits, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.bgz").write_bytes(packed("\n".join(f"{k} {i}" for i in range(k * 5000)).encode()))
    df = bgzf.read(spark, *(str(tmp_path / f"{k}.bgz") for k in range(4)))
    for k in range(4):
        assert values(df.filter(f"file like '%/{k}.bgz'")) == [f"{k} {i}" for i in range(k * 5000)]


def test_carriage_returns_and_nothing(spark, tmp_path):
    (tmp_path / "a.bgz").write_bytes(packed(b"x\r\n\r\ny\r\r\nz"))
    assert values(bgzf.read(spark, str(tmp_path / "a.bgz"))) == ["x", "", "y\r", "z"]
    for name, data in (("b.bgz", b""), ("c.bgz", bgzf.LAST)):
        (tmp_path / name).write_bytes(data)
        assert values(bgzf.read(spark, str(tmp_path / name))) == []


def test_damage_is_told(spark, tmp_path):
    whole = bytearray(packed("\n".join(str(i) for i in range(5000)).encode()))
    whole[-len(bgzf.LAST) - 6] ^= 1  # the checksum
    (tmp_path / "a.bgz").write_bytes(bytes(whole))
    with pytest.raises(Exception, match="checksum of a block"):
        bgzf.read(spark, str(tmp_path / "a.bgz"))
    (tmp_path / "b.bgz").write_bytes(bytes(whole[:-500]))  # cut within a block
    with pytest.raises(Exception, match="size of a block"):
        bgzf.read(spark, str(tmp_path / "b.bgz"))


def test_written_files_are_gzip(spark, small_splits, tmp_path):
    want = some_lines()
    bgzf.write(spark.createDataFrame([(x,) for x in want] + [(None,)], "value string").repartition(3), str(tmp_path / "out"))
    files = glob.glob(str(tmp_path / "out" / "part-*"))
    assert len(files) == 3
    plain = [x for f in files for x in gzip.open(f, "rt", newline="\n").read().split("\n")[:-1]]
    assert sorted(plain) == sorted(want + [""]) == sorted(values(bgzf.read(spark, str(tmp_path / "out"))))
    bgzf.write(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert values(bgzf.read(spark, str(tmp_path / "none"))) == []
    # a file that ends in .gz is a plain gzip file to Spark's own reader
    (tmp_path / "a.txt.gz").write_bytes(packed("\n".join(want).encode()))
    assert values(lines.read(spark, str(tmp_path / "a.txt.gz"))) == want
