import base64
import io
import json
import urllib.error

import pyarrow as pa
import pytest

from millrace.sources import (
    SourceType, probe_source, read_source, register_source, source_type, source_types,
)
from millrace.sources.catalog import catalog, describe_files, named_dataset
from millrace.sources.files import detect_format, footer_counts, read_files, row_slice
from millrace.sources.http import auth_headers, detect_http_format, probe_http, records
from millrace.sources.synth import reading_ids, readings
from tests.conftest import rows


@pytest.mark.parametrize("path, fmt", [
    ("a/b.parquet", "parquet"), ("a/b", "parquet"), ("a/*.csv", "csv"), ("a/B.TSV", "csv"),
    ("a.ndjson", "json"), ("a/**/*.jsonl", "json"), ("a/x.csv.gz", "csv"), ("dir.csv/", "csv"),
    ("dir.json/part", "parquet"), ("s3://b/k/events-?.json", "json"),
])
def test_detect_format(path, fmt):
    assert detect_format(path) == fmt


@pytest.mark.parametrize("url, fmt", [
    ("http://h/x.csv?a=1", "csv"), ("http://h/x.parquet#f", "parquet"), ("http://h/x", "json"),
    ("http://h/data.TSV", "csv"),
])
def test_detect_http_format(url, fmt):
    assert detect_http_format(url) == fmt


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,at\n1,"x, ""y""",2024-01-02 03:04:05\n2,,\n')
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\n")
    from millrace.session import run_session

    df = read_files(run_session(spark), str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "timestamp_ntz"]
    assert rows(df)[0][1] == 'x, "y"' and rows(df)[1][1:] == (None, None)
    assert rows(read_files(spark, str(tmp_path / "a.tsv"))) == [(1, "x")]
    typed = read_files(spark, str(tmp_path / "a.tsv"), schema="id string, name string")
    assert rows(typed) == [("1", "x")]


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text('\n [\n {"a": 1},\n {"a": 2, "b": "x"}\n]\n')
    (tmp_path / "lines.json").write_text('{"a": 3}\n{"a": 4}\n')
    (tmp_path / "more.ndjson").write_text('{"a": 5}\n')
    assert rows(read_files(spark, str(tmp_path / "array.json"))) == [(1, None), (2, "x")]
    assert rows(read_files(spark, str(tmp_path / "lines.json"))) == [(3,), (4,)]
    assert rows(read_files(spark, str(tmp_path / "more.ndjson"))) == [(5,)]


def test_globs(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"d{i % 2}" / f"f{i}.parquet"))
    assert read_files(spark, str(tmp_path / "d0" / "*.parquet")).count() == 2
    assert read_files(spark, f"{tmp_path}/**/*.parquet").count() == 3
    assert read_files(spark, f"{tmp_path}/**").count() == 3


def test_registry(spark):
    assert source_types() == ["file", "http"] and source_types("sink") == ["file"]
    with pytest.raises(ValueError, match="Duplicate source type: 'file'"):
        register_source("file", SourceType(read=None))
    with pytest.raises(KeyError, match="Unknown source type: 'ftp'. Available: file, http"):
        source_type("ftp")
    register_source("numbers", SourceType(read=lambda s, c: s.range(c["n"])))
    assert read_source(spark, "numbers", {"n": 4}).count() == 4
    assert probe_source(spark, "numbers", {})["connected"]


def test_probe_files(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02d}.csv").write_text("a\n1\n")
    found = probe_source(spark, "file", {"path": f"{tmp_path}/*.csv"})
    assert found["connected"] and found["message"] == "Found 12 file(s)"
    assert len(found["details"]["files"]) == 10 and found["latency_ms"] >= 0
    missing = probe_source(spark, "file", {"path": f"{tmp_path}/*.parquet"})
    assert not missing["connected"] and missing["message"].startswith("No files matched")
    assert probe_source(spark, "file", {})["message"] == "No path provided"
    assert probe_source(spark, "file", {"path": "s3://b/k"})["connected"]


def test_describe_and_catalog(spark, tmp_path):
    spark.createDataFrame([(1, "v")], "a_col long, b_col string").write.parquet(
        str(tmp_path / "t" / "x.parquet"))
    (tmp_path / "t" / "y.csv").write_text("k,v\n1,2\n")
    spark.range(3).selectExpr("id", "id AS day").write.partitionBy("day").parquet(
        str(tmp_path / "days"))
    path = str(tmp_path / "t" / "x.parquet")
    assert rows(describe_files(spark, [path, "/nowhere"]), "position") == [
        (path, "a_col", "bigint", 0), (path, "b_col", "string", 1)]
    listed = rows(catalog(spark, str(tmp_path)).select("column"))
    assert [r[0] for r in listed] == ["a_col", "b_col", "day", "id", "k", "v"]
    assert catalog(spark, str(tmp_path), limit=1).select("path").distinct().count() == 1


def test_named_dataset(spark, make):
    saved = {"t": {"config": {"path": make("t", [(1,)], "a long")}}}
    assert named_dataset(spark, "t", saved).count() == 1
    with pytest.raises(LookupError, match="Saved connector 'u' not found"):
        named_dataset(spark, "u", saved)


def test_footer_counts_and_slices(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(0, 10, 1, 2).write.parquet(path)
    df = spark.read.parquet(path)
    assert [r[1] for r in rows(footer_counts(df))] == [5, 5]
    first = footer_counts(df).orderBy("file_path").first()["file_path"]
    assert rows(row_slice(df, 1, 3, first)) == [(1,), (2,)]
    assert row_slice(df, 1, 3).columns == ["id"] and row_slice(df, 1, 3).count() == 4


NESTED = '{"data": {"items": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], "next": [7, 8]}}\n'


def test_records(spark, tmp_path):
    (tmp_path / "n.json").write_text(NESTED + '{"data": {"items": [], "next": null}}\n')
    df = spark.read.json(str(tmp_path / "n.json"))
    assert rows(records(df, "data.items")) == [(1, "a"), (2, "b")]
    assert records(df, "data.items", expand=False).columns == ["record"]
    assert rows(records(df, "data.next")) == [(7,), (8,)]


def test_http_source_over_file_urls(spark, tmp_path):
    (tmp_path / "a.json").write_text(NESTED)
    (tmp_path / "b.json").write_text(NESTED.replace('"a"', '"c"'))
    urls = [f"file://{tmp_path}/{n}.json" for n in "ab"]
    df = read_source(spark, "http", {"urls": urls, "response_path": "data.items"})
    assert rows(df, "id", "v") == [(1, "a"), (1, "c"), (2, "b"), (2, "b")]
    assert df.rdd.getNumPartitions() == 2
    (tmp_path / "c.csv").write_text("k,v\n1,x\n")
    assert rows(read_source(spark, "http", {"url": f"file://{tmp_path}/c.csv"})) == [(1, "x")]
    (tmp_path / "arr").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    given = {"url": f"file://{tmp_path}/arr", "schema": "k double, absent string"}
    assert rows(read_source(spark, "http", given)) == [(1.0, None), (2.0, None)]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    (part,) = (tmp_path / "p").glob("*.parquet")
    assert read_source(spark, "http", {"url": f"file://{part}"}).count() == 3


def test_auth_headers():
    assert auth_headers(None) == {} and auth_headers({"type": "none"}) == {}
    assert auth_headers({"type": "bearer", "token": "t"}) == {"Authorization": "Bearer t"}
    pair = base64.b64encode(b"u:p").decode()
    assert auth_headers({"type": "basic", "username": "u", "password": "p"}) == {
        "Authorization": f"Basic {pair}"}
    assert auth_headers({"type": "headers", "headers": {"X": "1"}}) == {"X": "1"}


def test_probe_http_falls_back_to_get():
    methods = []

    class Answer(io.BytesIO):
        status = 200
        headers = {"content-type": "application/json"}

    def opener(request, timeout):
        methods.append(request.get_method())
        if request.get_method() == "HEAD":
            raise urllib.error.HTTPError(request.full_url, 405, "no", {}, None)
        return Answer(b"{}")

    found = probe_http({"url": "http://h/x"}, opener)
    assert methods == ["HEAD", "GET"] and found["connected"]
    assert found["details"] == {"status_code": 200, "content_type": "application/json"}


@pytest.mark.parametrize("error, message", [
    (urllib.error.HTTPError("u", 404, "Not Found", {}, None), "HTTP 404: Not Found"),
    (TimeoutError(), "Connection timed out (10s)"),
    (urllib.error.URLError("refused"), "Connection failed: refused"),
    (RuntimeError("odd"), "Error: odd"),
])
def test_probe_http_errors(error, message):
    def opener(request, timeout):
        raise error

    found = probe_http({"url": "http://h/x"}, opener)
    assert not found["connected"] and found["message"] == message
    assert probe_http({})["message"] == "No URL provided"


def test_generated_readings(spark):
    df = readings(reading_ids(spark, 4000), stations=20)
    assert df.count() == 4000 == df.select("reading_id").distinct().count()
    assert df.select("station").distinct().count() == 20
    low, high, gaps = df.selectExpr("min(level_cm)", "max(level_cm)", "count_if(level_cm IS NULL)").first()
    assert 0 <= low < high < 100 and 150 < gaps < 350
    assert df.exceptAll(readings(reading_ids(spark, 4000).repartition(3), stations=20)).count() == 0
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_http_paths_of_a_file_source_are_fetched(spark, monkeypatch):
    from millrace.sources import files

    asked = []
    monkeypatch.setattr(files, "read_http", lambda s, config: asked.append(config) or s.range(2))
    assert read_source(spark, "file", {"path": "https://h/d.parquet"}).count() == 2
    assert asked == [{"urls": ["https://h/d.parquet"], "schema": None}]


def test_a_run_asks_a_service_once_for_its_rows(spark, tmp_path):
    from millrace import run_pipeline

    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    result = run_pipeline(spark, {
        "name": "api", "source_type": "http", "sink_path": str(tmp_path / "out"),
        "source_config": {"url": f"file://{tmp_path}/a.json", "schema": "k long"},
        "transforms": [{"type": "filter", "condition": "k > 1"}],
    })
    assert (result.rows_extracted, result.rows_written) == (2, 1)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(2,)]


def test_answers_of_changing_shape_keep_every_column(spark, tmp_path):
    answers = [[{"id": 1, "level": 3}, {"id": 2, "late": "x"}], [{"id": 3, "level": 2.5, "at": {"a": 1}}],
               [{"id": 4, "at": {"b": "y"}, "new": True}], []]
    for i, answer in enumerate(answers):
        (tmp_path / f"{i}.json").write_text(json.dumps(answer))
    df = read_source(spark, "http", {"urls": [f"file://{tmp_path}/{i}.json" for i in range(4)]})
    assert rows(df.select("id", "level", "late", "at.a", "at.b", "new"), "id") == [
        (1, 3.0, None, None, None, None), (2, None, "x", None, None, None),
        (3, 2.5, None, 1, None, None), (4, None, None, None, "y", True)]


def chunks_of(text, monkeypatch, chars):
    from millrace.sources import http

    monkeypatch.setattr(http, "CHUNK_CHARS", chars)
    return list(http.json_chunks(io.BytesIO(text.encode())))


@pytest.mark.parametrize("text, records", [
    ('{"a": 1}\n\n{"a": 2.5, "b": "x y"}\r\n{"a": null}', [{"a": 1}, {"a": 2.5, "b": "x y"}, {"a": None}]),
    ('\n [ {"a": 1} ,{"a": [1, 2]}\n, {"b": "],["}]\n', [{"a": 1}, {"a": [1, 2]}, {"b": "],["}]),
    ("[1.25, -3e5, 12345, true]", [1.25, -3e5, 12345, True]),
    ('{\n "a": [\n  1\n ]\n}\n', [{"a": [1]}]),
    ("[]", []), ("", []),
])
def test_json_bodies_are_read_in_chunks(monkeypatch, text, records):
    for chars in (1, 3, 7, 1 << 22):
        chunks = chunks_of(text, monkeypatch, chars)
        assert [r for chunk in chunks for r in chunk] == records
        assert len(chunks) == (len(records) if chars == 1 else len(chunks))


@pytest.mark.parametrize("text", ["[1, 2", "[1,]", "[1 2]", "[1] 2", '{"a": 1}\n{"a"', '[{"a": 1},\n'])
def test_broken_json_bodies_fail(monkeypatch, text):
    for chars in (1, 1 << 22):
        with pytest.raises(json.JSONDecodeError):
            chunks_of(text, monkeypatch, chars)


def test_chunks_of_a_body_have_one_schema(monkeypatch):
    from millrace.sources import http

    monkeypatch.setattr(http, "CHUNK_CHARS", 1)
    body = io.BytesIO(b'{"a": 1, "s": {"x": null}}\n{"s": {"y": []}, "b": 2}\n{"a": 2.5, "s": {"y": [3]}}')
    found = http._unified(table.schema for table in http.decode(body, "json", "u"))
    assert found == pa.schema([("a", pa.float64()), ("s", pa.struct([("x", pa.null()), ("y", pa.list_(pa.int64()))])),
                               ("b", pa.int64())])
    # Texts of numbers are those of the type that all the body has.
    told = list(http.decode(body, "json", "u", pa.schema([("a", pa.string())])))
    assert [t["a"].cast(pa.string()).to_pylist() for t in told] == [["1"], [None], ["2.5"]]
    assert {t.schema.field("a").type for t in told if t["a"].null_count == 0} == {pa.float64()}
