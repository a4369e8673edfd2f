from datetime import date, datetime, timezone

import pytest

from millrace.errors import PipelineError, TemplateError
from millrace.params import dated_paths, resolve
from millrace.plans.runner import run_pipeline
from millrace.sources.files import read_dated
from tests.conftest import rows


def spec(**changes):
    return {"name": "tides", "source_path": "lake/tides.parquet", "sink_path": "mart/tides", **changes}


NEW_YEAR = datetime(2030, 12, 31, 23, 40, 9, tzinfo=timezone.utc)


@pytest.mark.parametrize("zone, text, expected", [
    ("UTC", "{{today}}", "2030-12-31"),
    ("UTC", "{{yesterday}}|{{now}}", "2030-12-30|2030-12-31T23:40:09"),
    ("UTC", "{{now:%j of %Y}} {{today:%A}}", "365 of 2030 Tuesday"),
    ("Pacific/Auckland", "{{today:y%Y/m%m/d%d}}", "y2031/m01/d01"),
    ("Pacific/Auckland", "{{yesterday:%d %b}} {{now:%Hh%M}}", "31 Dec 12h40"),
    ("America/St_Johns", "{{now:%H:%M}}", "20:10"),
    ("UTC", "no parameter { } {today}", "no parameter { } {today}"),
])
def test_texts_of_a_moment(zone, text, expected):
    made = resolve(spec(timezone=zone, source_path=text), NEW_YEAR)
    assert made.source_path == expected


def test_parameters_are_found_at_any_depth_but_not_in_descriptions():
    made = resolve(spec(
        description="tides until {{today}}",
        source_path=None, source_type="http",
        source_config={"urls": ["https://h/{{today:%Y}}", "https://h/{{yesterday:%d}}"],
                       "auth": {"type": "headers", "headers": {"Day": "{{today:%j}}"}}},
        checks=[{"type": "custom_sql", "query": "SELECT max(d) FROM output", "must_be": "{{today}}"},
                {"type": "row_count_min", "value": 7}],
    ), NEW_YEAR)
    assert made.source_config["urls"] == ["https://h/2030", "https://h/30"]
    assert made.source_config["auth"]["headers"] == {"Day": "365"}
    assert made.checks[0]["must_be"] == "2030-12-31" and made.checks[1]["value"] == 7
    assert "{{today}}" in made.description


def test_a_moment_without_a_zone_is_utc():
    assert resolve(spec(sink_path="at/{{now}}"), NEW_YEAR.replace(tzinfo=None)).sink_path == \
        "at/2030-12-31T23:40:09"


@pytest.mark.parametrize("text", [
    "lake/{{", "lake/{{now:%H", "}}", "{{today}}/}}", "{{ {{now}} }}", "{{}}", "{{now:}}",
    "{{Today}}", "{{last_week}}", "{{ today}}",
])
def test_texts_that_are_refused(text):
    with pytest.raises(TemplateError):
        resolve(spec(sink_path=text))


def test_run_reports_the_template_step(spark):
    with pytest.raises(PipelineError, match="template_resolution"):
        run_pipeline(spark, spec(source_path="lake/{{fortnight}}"))


def test_dated_paths():
    assert dated_paths("a/{{today:%Y%m%d}}", date(2024, 2, 28), date(2024, 3, 1)) == [
        "a/20240228", "a/20240229", "a/20240301"]


@pytest.mark.parametrize("template", [
    "{root}/sales_{{{{today:%Y_%m_%d}}}}.parquet", "{root}/sales_{{{{today:%Y_%m_%d}}}}*",
])
def test_range_read_is_one_scan_with_run_dates(spark, tmp_path, template):
    for day in ("2024_02_28", "2024_03_01"):
        spark.createDataFrame([(day,)], "d string").write.parquet(
            str(tmp_path / f"sales_{day}.parquet"))
    df = read_dated(spark, template.format(root=tmp_path), date(2024, 2, 27), date(2024, 3, 2))
    assert rows(df) == [("2024_02_28", date(2024, 2, 28)), ("2024_03_01", date(2024, 3, 1))]
    assert df._jdf.queryExecution().toString().count("FileScan parquet") == 1


def test_yesterday_belongs_to_the_next_run(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "in-2024-02-28"))
    df = read_dated(spark, f"{tmp_path}/in-{{{{yesterday}}}}", date(2024, 2, 29), date(2024, 2, 29))
    assert rows(df) == [(0, date(2024, 2, 29))]
