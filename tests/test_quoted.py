"""Quoted texts over lines: many ranges give the rows that one reader gives."""

import random
from datetime import date

import pytest

from millrace.session import run_session
from millrace.sources.files import read_dated, read_files
from millrace.sources.quoted import Quotes, quoted_records, range_states, read_quoted, _lines
from tests.conftest import rows

OPTIONS = {"header": True, "inferSchema": True, "escape": '"', "preferDate": True, "mode": "FAILFAST"}


@pytest.fixture(scope="module")
def small(spark):
    """A session whose scans cut files every 4,000 bytes."""
    return run_session(spark, {"spark.sql.files.maxPartitionBytes": "4000",
                               "spark.sql.files.openCostInBytes": "1"})


def table(seed, count):
    rng = random.Random(seed)
    marks = ["a", '""', ",", "\n", "\r\n", " ", "b c", "7"]

    def cell():
        if rng.random() < 0.6:
            return '"' + "".join(rng.choices(marks, k=rng.randrange(14))) + '"'
        return rng.choice(["x", '5" pipe', "", "12", 'a"b', ' "q"'])

    long = "1000," + '"' + "long\n" * 2000 + '",y\n'
    body = "".join(f"{i},{cell()},{cell()}\n" for i in range(count))
    return 'key,"no\nte",z\n' + body + long + '1001,u,"end\nwithout"'


@pytest.mark.parametrize("chunk_chars", [50, 1 << 20])
def test_ranges_give_the_rows_of_one_reader(small, tmp_path, chunk_chars):
    path = tmp_path / "a.csv"
    path.write_bytes(table(4, 500).encode())
    found = read_quoted(small, [str(path)], chunk_chars=chunk_chars, **OPTIONS)
    wanted = small.read.options(**OPTIONS, multiLine=True).csv(str(path))
    assert found.schema == wanted.schema and rows(found) == rows(wanted)
    states = range_states(_lines(small, [str(path)], {}), Quotes(","))
    assert states.where("inside").count() > 1 and states.where("not inside").count() > 1


def test_large_files_are_read_in_pieces_by_themselves(small, tmp_path):
    (tmp_path / "a.csv").write_bytes(table(5, 300).encode())
    (tmp_path / "b.csv").write_text('key,note,z\n1,"x\ny",2\n')
    found = read_files(small, str(tmp_path), format="csv")
    assert "file_block_start" in found._jdf.queryExecution().toString()
    wanted = small.read.options(**OPTIONS, multiLine=True).csv([f"{tmp_path}/{n}.csv" for n in "ab"])
    assert rows(found) == rows(wanted)


def test_options_and_schema(small, tmp_path):
    (tmp_path / "a.csv").write_text('k;v\n1;"a\nb"\n2;none\n3;x;4\n' + '5;"c\nd"\n' * 1000)
    options = {"sep": ";", "multiLine": True, "nullValue": "none"}
    drop = read_files(small, str(tmp_path / "a.csv"), schema="k long, v string",
                      options={**options, "mode": "DROPMALFORMED"})
    assert rows(drop)[:3] == [(1, "a\nb"), (2, None), (5, "c\nd")] and drop.count() == 1002
    with pytest.raises(Exception, match="MALFORMED"):
        read_files(small, str(tmp_path / "a.csv"), schema="k long, v string", options=options).collect()


def test_days_of_several_layouts(small, tmp_path):
    for day, text in (("05", 'k,v\n' + '1,"a\nb"\n' * 900), ("06", "k,v\n2,c\n")):
        (tmp_path / f"d=2031-05-{day}.csv").write_text(text)
    found = read_dated(small, f"{tmp_path}/d={{{{today}}}}.csv", date(2031, 5, 5), date(2031, 5, 6))
    assert rows(found.groupBy("run_date").count().selectExpr("string(run_date)", "count")) == [
        ("2031-05-05", 900), ("2031-05-06", 1)]


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_state_functions(escape):
    quotes, quoted = Quotes(",", escape), escape + '"'
    for text in ("a,b", '"a', f'"a{quoted}', f'x"{quoted},"y', '"a"b,"c', 'a"', '"a","b', ""):
        for inside in (False, True):
            texts, still = quotes.pieces(text + "\nz", inside)
            assert quotes.after(text, inside) == (len(texts) == 1)
            assert still == quotes.after("z", quotes.after(text, inside))


def test_empty_files(small, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n")
    assert quoted_records(small, [str(tmp_path / "a.csv")]).count() == 0
    assert read_quoted(small, [str(tmp_path / "a.csv")], schema="k long", **{**OPTIONS}).count() == 0


def test_stray_carriage_returns_are_refused(small, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,v\r1,"a\rb"\r')
    with pytest.raises(Exception, match="lineSep"):
        quoted_records(small, [str(tmp_path / "a.csv")]).collect()
    (tmp_path / "b.csv").write_bytes(b'k,v\r\n1,"a\r\nb"\r\n')
    found = quoted_records(small, [str(tmp_path / "b.csv")])
    assert rows(found.select("value")) == [('1,"a\r\nb"',), ("k,v",)]
