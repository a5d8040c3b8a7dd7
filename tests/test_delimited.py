"""Delimited files in small byte ranges, against the csv module over whole files."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from attestor.sources import delimited


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "150b")
    spark.conf.set(keys[1], "1b")
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def wanted(text, separator=","):
    header, *rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r]
    return [{n: None if v in delimited.MISSING else v for n, v in zip(header, r, strict=True)} for r in rows]


def found(spark, folder):
    out = {}
    for r in delimited.read_ranges(spark, str(folder)).collect():
        out.setdefault(r.source_file, []).append((r.row, r["values"], r.error))
    return {k: sorted(v, key=lambda x: x[0] or 0) for k, v in out.items()}


@pytest.mark.parametrize(("inside", "separator", "line", "after"), [
    (False, ",", 'a,"b', True), (False, ",", 'a,b"c', False), (False, ",", '"a""",b', False), (True, ",", 'x",y', False), (True, ",", 'x""y', True), (False, ",", '"a"b,"c"', False),
    (True, ",", 'no quote', True), (False, "\t", '"a,\t', True), (False, " ", '"a', False), (True, ",", '",', False), (True, ",", '","', True), (False, ",", '""', False), (False, ",", '"""', True),
])
def test_open_cells(inside, separator, line, after):
    assert delimited.stays_open(line.encode(), separator.encode(), inside) is after


def test_ranges_cut_anywhere_give_the_rows_of_whole_files(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}, with a comma" for i in range(40))
    rows = [[str(i), f"name {i}", f'said "{i}"\nand more' if i % 7 == 3 else "plain", long if i in (5, 20) else ""] for i in range(60)]
    made = io.StringIO(newline="")
    csv.writer(made, lineterminator="\n").writerows([["id", "name", "note", "long"], *rows])
    text = made.getvalue()
    (tmp_path / "plain.csv").write_text(text, newline="")
    (tmp_path / "marked.CSV").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "gb.csv").write_bytes(text.replace("name", "材料").encode("gb18030"))
    (tmp_path / "dos.csv").write_text(text.replace("\n", "\r\n"), newline="")
    tabs = text.replace(",", "\t")
    (tmp_path / "t.tsv").write_text(tabs, newline="")
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "plain.csv"))
    assert lines.rdd.getNumPartitions() > 10  # many ranges a file
    got = found(spark, tmp_path)
    for name, want in (("plain.csv", wanted(text)), ("marked.CSV", wanted(text)), ("gb.csv", wanted(text.replace("name", "材料"))), ("t.tsv", wanted(tabs, "\t"))):
        assert [r for r, _, _ in got[name]] == list(range(1, 61)), name
        assert [v for _, v, _ in got[name]] == want, name
    assert [{k: v and v.replace("\r", "") for k, v in r.items()} for _, r, _ in got["dos.csv"]] == wanted(text)


def test_odd_files(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text("a,b\n1,2\n3,\"never\n" + "x\n" * 200)
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    (tmp_path / "wide.csv").write_text("a,b\n1,2,3\n\n4\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_text("only,header\n")
    (tmp_path / "twice.csv").write_text("a,a,\n1,2,3\n")
    (tmp_path / "stars.dat").write_text("# survey\nra dec\n1.5 2 # near\n\n\"q 3\n")
    (tmp_path / "other.txt").write_text("not read")
    got = found(spark, tmp_path)
    assert got["open.csv"] == [(None, None, delimited.UNCLOSED)] and got["bad.csv"] == [(None, None, delimited.UNDECODED)]
    assert got["wide.csv"] == [(1, None, delimited.TOO_LONG), (2, {"a": "4", "b": None}, None)]
    assert got["twice.csv"] == [(1, {"a": "1", "a.1": "2", "Unnamed: 2": "3"}, None)]
    assert got["stars.dat"] == [(1, {"ra": "1.5", "dec": "2"}, None), (2, {"ra": '"q', "dec": "3"}, None)]
    assert set(got) == {"open.csv", "bad.csv", "wide.csv", "twice.csv", "stars.dat"}


def test_nothing_to_read(spark, tmp_path):
    assert delimited.read_ranges(spark, str(tmp_path)).where(F.lit(True)).count() == 0
