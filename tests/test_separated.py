"""Separated files read by ranges, against ``csv.DictReader`` over the whole text."""

import csv
import io
import random

import pytest

import graphloom as g
from graphloom.sources.separated import Records, quoted_after


def truth(path, separator=","):
    text = path.read_text(encoding="utf-8")
    return list(csv.DictReader(io.StringIO(text), delimiter=separator))


@pytest.fixture
def small_ranges(spark):
    """Splits of 160 bytes, each read by a task of its own."""
    settings = {"spark.sql.files.maxPartitionBytes": "160", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def random_text(seed, n=40):
    draw = random.Random(seed)
    cell = lambda: draw.choice(["", "a", "é", '"x"', '"a,b"', '"two\nlines"', '"three\r\nlines\r"', '""', '"say ""no"""', 'in"side', '"closed"open', "long" * 30, '"' + "wide\n" * 40 + '"', " "])
    line = lambda: ",".join(cell() for _ in range(draw.choice([0, 1, 2, 3, 3, 3, 4, 6])))
    return "id,name,note" + draw.choice(["\n", "\r\n"]) + "".join(line() + draw.choice(["\n", "\r\n", "\r"]) for _ in range(n)) + draw.choice(["", "last,one", '"never closed\nat all'])


@pytest.mark.parametrize("seed", range(4))
def test_random_files_over_many_ranges(spark, tmp_path, small_ranges, seed):
    path = tmp_path / "a.csv"
    path.write_bytes(random_text(seed).encode())
    got = Records(spark, str(path))
    assert list(got) == truth(path)
    assert [r["_row"] for r in got.frame.orderBy("_row").collect()] == list(range(len(got)))


@pytest.mark.parametrize("text", ["", "\n", "\nx,y\n1,2\n", "a,b", "a,a,b\n1,2,3\n4\n5,6,7,8\n", 'h\n"open', '"a\nb",c\n1,2\n', "x\n\n\n1\n"])
def test_odd_files(spark, tmp_path, text):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    assert list(Records(spark, str(path))) == truth(path)


def test_tabs_and_a_table_source(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('k\tv\n1\t"a\tb"\n2\tx,y\tmore\n3\n')
    source = g.ingest(spark, str(path))
    assert list(source.content) == truth(path, "\t") and source.content == truth(path, "\t") and source.content[-1] == {"k": "3", "v": None} and len(source.content) == 3
    rows = g.SourceBundle([source]).table(spark, "t").orderBy("_row").collect()
    assert [tuple(r) for r in rows] == [("1", "a\tb", 0), ("2", "x,y", 1), ("3", None, 2)]
    with pytest.raises(IndexError):
        source.content[3]


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "a.csv"
    path.write_text("k,v\n" + "".join(f'{i},"line {i}\nmore"\n' for i in range(200)))
    got = Records(spark, str(path))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert list(got) == truth(path)


def test_state_behind_a_line_is_that_of_the_reader():
    draw = random.Random(2)
    for _ in range(20_000):
        line, quoted = "".join(draw.choice('",;"a ') for _ in range(draw.randint(0, 9))), draw.random() < 0.5
        rows = list(csv.reader(io.StringIO(('"\n' if quoted else "") + line + "\nMARK,1\n"), delimiter=","))
        assert quoted_after(line, quoted, ",") == (rows[-1] != ["MARK", "1"])
