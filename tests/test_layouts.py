"""Text files of every layout, lists of paths, folders at any depth, absent days."""

from datetime import date

import pytest

from millrace import run_pipeline
from millrace.sources import probe_source
from millrace.sources.catalog import describe_files
from millrace.sources.files import dated_days, read_dated, read_files
from tests.conftest import rows


@pytest.mark.parametrize("mark", [";", "|", "\t", ","])
def test_delimiters(spark, tmp_path, mark):
    (tmp_path / "a.csv").write_text(mark.join(["plot", '"kind, of; tree|"', "age"]) + "\n"
                                    + mark.join(["4", '"oak"', "70"]) + "\n")
    assert rows(read_files(spark, str(tmp_path / "a.csv"))) == [(4, "oak", 70)]


def test_quotes_over_lines_and_files_of_several_dialects(spark, tmp_path):
    folder = tmp_path / "plots.csv" / "zone=3"
    folder.mkdir(parents=True)
    (folder / "a b+c.csv").write_text('plot,note\n1,"two\nlines"\n')
    (folder / "[d].csv").write_text("plot;note\n2;plain\n")
    found = read_files(spark, str(tmp_path / "plots.csv"))
    assert rows(found) == [(1, "two\nlines", 3), (2, "plain", 3)]


@pytest.mark.parametrize("text, columns, found", [
    ("full name, city, zip|n\nAnn Lee, Rome, 1|3\nBo|4\n", ["full name, city, zip", "n"],
     [("Ann Lee, Rome, 1", 3), ("Bo", 4)]),
    ("note\nwell, then\nno\n", ["note"], [("no",), ("well, then",)]),
    ("seen (a, b)\nx\ny\n", ["seen (a, b)"], [("x",), ("y",)]),
    ("a;b\n1,5;2,5\n", ["a", "b"], [("1,5", "2,5")]),
    ("a,b;x,c\n1,2,3\n4,\"p;q\",6\n", ["a", "b;x", "c"], [(1, "2", 3), (4, "p;q", 6)]),
    ("a|b,c|d\n", ["a", "b,c", "d"], []),
])
def test_lines_decide_the_delimiter(spark, tmp_path, text, columns, found):
    (tmp_path / "a.csv").write_text(text)
    made = read_files(spark, str(tmp_path / "a.csv"))
    assert made.columns == columns and rows(made) == found


def test_a_delimiter_in_doubt_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b,c\n1;2,3\n")
    with pytest.raises(ValueError, match="a.csv.*sep"):
        read_files(spark, str(tmp_path / "a.csv"))
    given = read_files(spark, str(tmp_path / "a.csv"), options={"sep": ";"})
    assert rows(given) == [(1, "2,3")]


def test_a_first_line_alone_follows_files_that_begin_with_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rank, word, and more|key|price\n")
    with pytest.raises(ValueError, match="a.csv.*sep"):
        read_files(spark, str(tmp_path), format="csv")
    (tmp_path / "b.csv").write_text("rank, word, and more|key|price\n1, or HIGH|7|2.5\n")
    found = read_files(spark, str(tmp_path), format="csv")
    assert found.columns == ["rank, word, and more", "key", "price"] and rows(found) == [("1, or HIGH", 7, 2.5)]
    # Here the first line by itself would be cut at commas.
    (tmp_path / "c.csv").write_text("a, b, c|d\n")
    (tmp_path / "d.csv").write_text('a, b, c|d\n"x\ny"|5\nz|6\n')
    both = read_files(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")])
    assert both.columns == ["a, b, c", "d"] and rows(both) == [("x\ny", 5), ("z", 6)]
    # Lines of its own decide, and files of other first lines say nothing.
    (tmp_path / "e.csv").write_text("rank, word, and more|key|other\n")
    with pytest.raises(ValueError, match="e.csv.*sep"):
        read_files(spark, str(tmp_path), format="csv")


def test_a_row_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_files(spark, str(tmp_path / "a.csv")).collect()
    kept = read_files(spark, str(tmp_path / "a.csv"), options={"mode": "DROPMALFORMED"})
    assert rows(kept) == [(1, 2)]


@pytest.mark.parametrize("long_array", [False, True])
def test_json_layout_is_decided_for_each_file(spark, tmp_path, long_array):
    pad = " " * 4000 if long_array else ""
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "b.json").write_text(f'[\n  {{"k": 3, "v": "{pad}x"}},\n  {{"k": 4}}\n]\n')
    (tmp_path / "c.json").write_text('{\n  "k": 5\n}\n')
    (tmp_path / "d.json").write_text('[{"k": 6}, {"k": 7}]')
    (tmp_path / "e.json").write_text("")
    assert rows(read_files(spark, f"{tmp_path}/*.json").select("k")) == [(n,) for n in range(1, 8)]


def test_lists_of_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x\n")
    (tmp_path / "b.json").write_text('{"k": 2, "w": true}\n')
    (tmp_path / "c.tsv").write_text("k\tv\n3\ty\n")
    paths = [f"{tmp_path}/{name}" for name in ("a.csv", "b.json", "c.tsv")]
    found = read_files(spark, paths).select("k", "v", "w")
    assert rows(found) == [(1, "x", None), (2, None, True), (3, "y", None)]
    assert probe_source(spark, "file", {"path": paths})["message"] == "Found 3 file(s)"
    result = run_pipeline(spark, {"name": "lists", "source_config": {"path": paths},
                                  "source_type": "file", "sink_path": str(tmp_path / "out")})
    assert (result.rows_extracted, result.rows_written) == (3, 3)


def test_any_depth_before_a_folder(spark, tmp_path):
    for i, place in enumerate(["t/keep", "t/x/keep", "t/x/y/keep", "t/x/drop"]):
        spark.range(i, i + 1).write.parquet(str(tmp_path / place))
    assert rows(read_files(spark, f"{tmp_path}/t/**/keep/*.parquet")) == [(0,), (1,), (2,)]
    with pytest.raises(FileNotFoundError):
        read_files(spark, f"{tmp_path}/t/**/none/*.parquet")


def test_absent_days_are_told(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "d=2031-05-06"))
    template = f"{tmp_path}/d={{{{today}}}}"
    span = date(2031, 5, 5), date(2031, 5, 6)
    assert [r[0] for r in rows(dated_days(spark, template, *span).select("found"))] == [False, True]
    assert read_dated(spark, template, *span).count() == 2
    with pytest.raises(FileNotFoundError, match="2031-05-05"):
        read_dated(spark, template, *span, missing="fail")


def test_unreadable_paths_are_told(spark, tmp_path):
    ((_, column, error),) = rows(
        describe_files(spark, [f"{tmp_path}/none"], errors=True).select("path", "column", "error"))
    assert column is None and "none" in error


def test_layouts_are_decided_without_sorting_lines(spark, tmp_path, monkeypatch):
    """The table of lines is aggregated over numbers, in hash tables of few keys."""
    from pyspark.sql import DataFrame

    from millrace.sources import files

    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    (tmp_path / "a.csv").write_text("k,v\n" + "1,2\n" * 9)
    (tmp_path / "a.json").write_text('{"k": 1}\n' * 9)
    uri = f"file:{tmp_path}/a"
    assert [layout[:2] for layout in files._dialects(spark, [f"{uri}.csv"], {}, False)] == [(",", False)]
    assert [layout[:2] for layout in files._json_layouts(spark, [f"{uri}.json"], {})] == [("", False)]
    for plan in plans:
        # What is above the scan, up to the first shuffle.
        below = plan.split("== Physical Plan ==")[1].rsplit("Exchange", 1)[1]
        assert "HashAggregate" in below and "Sort" not in below
