"""CSV files read in splits against Python's reader: records over the ends of splits, quotes that open nothing, encodings, odd files."""

import csv
import io
import random

import pytest

from brindle.sources import sheets


def plain(data: bytes, encoding: str):
    body = data.decode(encoding)
    return [[c.strip() or None for c in r] for r in csv.reader(io.StringIO(body, newline=""), delimiter=sheets.delimiter(body[:65536]))]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "600")
    spark.conf.set(names[1], "0")
    spark.conf.set(names[2], "40")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def read(spark, path):
    rows = sheets.raw_csv(spark, str(path)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    return [r.cells for r in rows]


@pytest.mark.parametrize(("mark", "end", "encoding"), [(",", "\r\n", "utf-8-sig"), (";", "\n", "cp1252"), ("\t", "\n", "latin-1"), ("|", "\r\n", "utf-8")])
def test_splits_equal_one_reader(spark, tmp_path, small_splits, mark, end, encoding):
    r = random.Random(mark)
    cells = ["a", "", '5" pipe', "é", f'"x{mark}y"', '"say ""hi"""', f'"two{end}lines"', '"' + end.join(f"long {i}{mark}" for i in range(60)) + '"', '"a"b', " c "]
    if encoding == "latin-1":
        cells.append("\x81")
    text = end.join(mark.join(r.choices(cells, weights=[8, 3, 2, 3, 2, 2, 2, 0.4, 1, 2] + [1] * (len(cells) - 10), k=4)) for _ in range(400)) + end * r.randint(0, 1)
    data = (mark.join("abcd") + end + text).encode(encoding)
    (tmp_path / "t.csv").write_bytes(data)
    path = tmp_path / "t.csv"
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert read(spark, path) == plain(data, "utf-8-sig" if encoding == "utf-8" else encoding)


@pytest.mark.parametrize("data", [b"", b"a,b\n1,2", b"a,b\r1,2\r", b'a,b\n"open,2\n3,4', b"\n\na,b\n\n", b'"', "﻿ä,b\n1,2".encode()])
def test_odd_files(spark, tmp_path, data):
    (tmp_path / "t.csv").write_bytes(data)
    got, want = read(spark, tmp_path / "t.csv"), plain(data.replace(b"\r", b"\n") if b"\n" not in data else data, "utf-8-sig")
    assert got == want


def test_open_cells():
    for line, inside, left in [('a,"b', False, True), ('a,"b"', False, False), ('5" pipe,2', False, False), ('x",y', True, False), ('x"",y', True, True), ('x","y', True, True), ('"a"b"c,d', False, False), ('a,"",b', False, False), ('"""', False, True)]:
        assert sheets.stays_open(line, ",", inside) is left, line
