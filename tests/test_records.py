"""CSV files read by many tasks against Spark's reader of whole files."""

import random

import pytest

from caseloom.sources import records
from caseloom.sources.records import leaves_open, read_records
from caseloom.sources.tables import load_table


@pytest.fixture
def small_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def fields(rng):
    inside = ["a", '""', ",", "\n", "b c", "\r\n", "é", "\n\n"]

    def one():
        kind = rng.random()
        if kind < 0.3:
            return '"' + "".join(rng.choice(inside) for _ in range(rng.randrange(0, 12))) + '"'
        if kind < 0.4:
            return rng.choice(['5"', 'x"y"z', "", ' "q"', "na", '"ab"c'])
        return "".join(rng.choice("abcdef 123") for _ in range(rng.randrange(1, 9)))

    return [",".join(one() for _ in range(rng.choice((3, 3, 3, 2, 4)))) for _ in range(300)]


def same_rows(spark, path):
    one = spark.read.csv(path, header=True, escape='"', multiLine=True)
    many = read_records(spark, path)
    assert many.columns == one.columns
    found, wanted = (sorted(map(repr, map(tuple, df.collect()))) for df in (many, one))
    assert found == wanted
    return many


def write(path, rows, end="\n", last=True):
    path.write_bytes((end.join(rows) + (end if last else "")).encode())
    return str(path)


@pytest.mark.parametrize(("end", "last", "seed"), [("\n", True, 1), ("\n", False, 2), ("\r\n", True, 3), ("\r\n", False, 4)])
def test_cuts_inside_quoted_fields(spark, small_ranges, tmp_path, end, last, seed):
    path = write(tmp_path / "t.csv", ["h1,h2,h3", *fields(random.Random(seed))], end, last)
    assert same_rows(spark, path).rdd.getNumPartitions() > 8


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    rows = fields(random.Random(5))
    rows[100] = 'x,"' + "\n".join(f"long line {i}" for i in range(300)) + '",y'
    rows[200] = 'x,"' + "\n".join('""' if i % 3 else "," for i in range(500)) + '"'
    same_rows(spark, write(tmp_path / "t.csv", ["h1,h2,h3", *rows]))
    same_rows(spark, write(tmp_path / "open.csv", ["h1,h2,h3", *rows, 'never,"closed', "a,b,c", *rows]))


def test_files_without_open_quotes_are_read_by_lines(spark, small_ranges, tmp_path):
    rows = [f'{i},"a, b",{i}' for i in range(300)]
    many = same_rows(spark, write(tmp_path / "t.csv", ["h1,h2,h3", *rows]))
    assert "MapInArrow" not in many._jdf.queryExecution().toString() and many.rdd.getNumPartitions() > 8


def test_lines_that_readers_of_lines_take_otherwise(spark, small_ranges, tmp_path):
    """Blank lines of spaces, stray quotes in pairs, and line ends that change within a file."""
    rows = [f"a b{i},c" for i in range(60)]
    same_rows(spark, write(tmp_path / "a.csv", ["h1,h2", *rows, "   ", "", 'x,5" pipe', '"", "']))
    same_rows(spark, write(tmp_path / "b.csv", ["h1,h2", *rows, "x,y\r", *rows]))
    same_rows(spark, write(tmp_path / "c.csv", ["h1,h2", *rows], end="\r"))
    same_rows(spark, write(tmp_path / "d.csv", ["h1", "x"]))


def test_a_folder_of_files_with_their_own_line_ends(spark, small_ranges, tmp_path):
    (tmp_path / "in").mkdir()
    for i, end in enumerate(("\n", "\r\n", "\n")):
        write(tmp_path / "in" / f"{i}.csv", ["h1,h2,h3", *fields(random.Random(i + 7))], end)
    same_rows(spark, str(tmp_path / "in"))


def test_many_open_ranges_go_back_to_whole_files(spark, small_ranges, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "TOLD", 2)
    same_rows(spark, write(tmp_path / "t.csv", ["h1,h2,h3", *fields(random.Random(9))]))


def test_types_are_inferred_over_all_ranges(spark, small_ranges, tmp_path):
    rows = [f'{i},"line\nbreak {i}",{i / 4}' for i in range(200)]
    table = load_table(spark, write(tmp_path / "t.csv", ["n,text,x", *rows]))
    assert dict(table.dtypes) == {"n": "bigint", "text": "string", "x": "double"}
    assert table.count() == 200 and table.where("text = 'line\nbreak 7'").count() == 1


def test_state_at_the_end_of_a_line():
    cases = {"a,b": (False, True), '"a': (True, False), 'a,"b': (True, False), 'a"b': (False, False), '"a""': (True, False), '""': (False, True), 'x",y,"': (True, True)}
    assert {line: (leaves_open(line, False), leaves_open(line, True)) for line in cases} == cases
