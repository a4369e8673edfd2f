"""HTTP API source: a Python data source with one input partition per URL."""

from __future__ import annotations

import base64
import io
import json
import posixpath
import re
import shutil
import tempfile
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any, BinaryIO, TextIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from millrace import messages

FORMAT_NAME = "millrace_http"
TIMEOUT_SECONDS = 10
FETCH_TIMEOUT_SECONDS = 300
# Characters of JSON that a task has as records at a time.
CHUNK_CHARS = 1 << 22


# Endings of a URL's path; an answer of any other is JSON.
_FORMAT_OF_ENDING = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv"}


def detect_http_format(url: str) -> str:
    """``parquet``, ``csv`` or ``json`` from the path of a URL."""
    ending = posixpath.splitext(urlsplit(url).path)[1]
    return _FORMAT_OF_ENDING.get(ending.lower(), "json")


def _basic(username: str = "", password: str = "", **_) -> str:
    return "Basic " + base64.b64encode(f"{username}:{password}".encode()).decode()


# How each kind of auth config makes its request headers.
_HEADERS_OF = {
    "bearer": lambda auth: {"Authorization": "Bearer " + str(auth.get("token", ""))},
    "basic": lambda auth: {"Authorization": _basic(**auth)},
    "headers": lambda auth: dict(auth.get("headers") or ()),
}


def auth_headers(auth: dict | None) -> dict[str, str]:
    """Request headers of an auth config of type none, bearer, basic or headers."""
    make = _HEADERS_OF.get((auth or {}).get("type"))
    return make(auth) if make else {}


def read_http(spark: SparkSession, config: dict) -> DataFrame:
    """Rows of one or several responses.

    ``{url | urls, auth, format, response_path, schema, expand, timeout}``; without a
    schema all responses are fetched once more, in tasks, and the columns of all of them
    make the schema. ``timeout`` is in seconds, for each read from the connection.
    """
    urls = config.get("urls") or [config["url"]]
    fmt = config.get("format") or detect_http_format(urls[0])
    headers = auth_headers(config.get("auth"))
    timeout = config.get("timeout") or FETCH_TIMEOUT_SECONDS
    schema = config.get("schema") or _common_schema(spark, urls, headers, fmt, timeout)
    df = spark.read.format(_register(spark)).schema(schema).options(
        urls=json.dumps(urls), headers=json.dumps(headers), body=fmt, timeout=str(timeout),
    ).load()
    if config.get("response_path") and fmt == "json":
        df = records(df, config["response_path"], expand=config.get("expand", True))
    return df


def _common_schema(spark: SparkSession, urls, headers, fmt, timeout) -> StructType:
    """The columns of all answers in the order of the URLs; whole numbers give way to
    fractions, structs take the fields of all. One schema for each URL reaches the
    driver, which has the list of URLs already."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def describe(batches):
        for batch in batches:
            found = []
            for url in batch.column("url").to_pylist():
                with fetched(url, headers, timeout) as body:
                    schema = _unified(table.schema for table in decode(body, fmt, url))
                found.append(schema.serialize().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("position"), pa.array(found, pa.binary())], ["position", "found"])

    asked = spark.createDataFrame(list(enumerate(urls)), "position long, url string")
    rows = asked.repartition(len(urls), "position").mapInArrow(
        describe, "position long, found binary").orderBy("position").collect()
    schemas = [pa.ipc.read_schema(pa.py_buffer(bytes(row["found"]))) for row in rows]
    return from_arrow_schema(pa.unify_schemas(schemas, promote_options="permissive"))


def _register(spark: SparkSession) -> str:
    """Make the data source known under a name of its own. Reused Python workers have
    loaded earlier ones, and Spark refuses a name it finds there."""
    unique = f"{FORMAT_NAME}_{uuid.uuid4().hex}"
    spark.dataSource.register(
        type("HttpSource", (HttpSource,), {"name": classmethod(lambda cls: unique)})
    )
    return unique


def records(df: DataFrame, path: str, expand: bool = True) -> DataFrame:
    """One row per element of the array at a dot path such as ``data.items``.

    Struct elements become columns; ``expand=False`` keeps them as one column.
    """
    name = "record"
    for field in path.split("."):
        step = F.col(field) if name == "record" and name not in df.columns else F.col(name)[field]
        df = df.select(step.alias(name))
        if isinstance(df.schema[name].dataType, ArrayType):
            df = df.select(F.explode(name).alias(name))
    if expand and isinstance(df.schema[name].dataType, StructType):
        df = df.select(f"{name}.*")
    return df


def probe_http(config: dict, opener=urllib.request.urlopen) -> dict:
    """HEAD, then GET where HEAD is refused; errors become a message."""
    url = config.get("url", "")
    if not url:
        return {"connected": False, "message": messages.PROBE_NO_URL, "latency_ms": None,
                "details": {}}
    started = time.perf_counter()

    def answer(connected, message, **details):
        latency = round((time.perf_counter() - started) * 1000, 1)
        return {"connected": connected, "message": message, "latency_ms": latency,
                "details": details}

    headers = auth_headers(config.get("auth"))
    for method in ("HEAD", "GET"):
        request = urllib.request.Request(url, headers=headers, method=method)
        try:
            with opener(request, timeout=TIMEOUT_SECONDS) as response:
                status = getattr(response, "status", None) or 200
                return answer(True, messages.PROBE_OK.format(status=status), status_code=status,
                              content_type=response.headers.get("content-type", "unknown"))
        except urllib.error.HTTPError as exc:
            if exc.code == 405 and method == "HEAD":
                continue
            return answer(False, messages.PROBE_HTTP_ERROR.format(status=exc.code, reason=exc.reason),
                          status_code=exc.code)
        except TimeoutError:
            return answer(False, messages.PROBE_TIMEOUT.format(seconds=TIMEOUT_SECONDS))
        except urllib.error.URLError as exc:
            return answer(False, messages.PROBE_REFUSED.format(reason=exc.reason))
        except Exception as exc:
            return answer(False, messages.PROBE_ERROR.format(reason=exc))
    return answer(False, messages.PROBE_ERROR.format(reason="no answer"))


@contextmanager
def fetched(url: str, headers: dict[str, str], timeout: float = FETCH_TIMEOUT_SECONDS) -> Iterator[BinaryIO]:
    """A response body in a file of its task; no connection is held while rows are made."""
    request = urllib.request.Request(url, headers=headers)
    with tempfile.TemporaryFile() as body:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            shutil.copyfileobj(response, body)
        body.seek(0)
        yield body


def decode(body: BinaryIO, fmt: str, url: str, schema: pa.Schema | None = None) -> Iterator[pa.Table]:
    """One response body as Arrow tables; JSON comes in several, of about ``CHUNK_CHARS`` of
    text each, and takes a schema where its values fit."""
    if fmt == "parquet":
        import pyarrow.parquet as pq

        yield pq.read_table(body)
    elif fmt == "csv":
        import pyarrow.csv as pc

        tab = url.lower().partition("?")[0].endswith(".tsv")
        yield pc.read_csv(body, parse_options=pc.ParseOptions(delimiter="\t" if tab else ","))
    elif schema is None:
        for records in json_chunks(body):
            yield pa.Table.from_pylist(_with_all_fields(records))
    else:
        found = None
        for records in json_chunks(body):
            try:
                yield pa.Table.from_pylist(records, schema=schema)
                continue
            except (pa.ArrowInvalid, pa.ArrowTypeError):
                pass  # Values such as numbers in texts are cast from what they are in all the body.
            if found is None:
                place = body.tell()
                found = _unified(table.schema for table in decode(body, fmt, url))
                body.seek(place)
            yield pa.Table.from_pylist(records, schema=found)


def _unified(schemas: Iterable[pa.Schema]) -> pa.Schema:
    whole = pa.schema([])
    for schema in schemas:
        whole = pa.unify_schemas([whole, schema], promote_options="permissive")
    return whole


def json_chunks(body: BinaryIO) -> Iterator[list]:
    """The records of a JSON body in lists of about ``CHUNK_CHARS`` of text: the elements
    of an array, the values of lines, or one value over lines."""
    body.seek(0)
    held, size = [], 0
    for record, length in _json_values(body):
        held.append(record)
        size += length
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _json_values(body: BinaryIO) -> Iterator[tuple[Any, int]]:
    """Every record with the length of its text."""
    text = io.TextIOWrapper(body, encoding="utf-8")
    try:
        start = " "
        while start and not start.strip():
            start = text.read(1)
        text.seek(0)
        yield from _elements(text) if start == "[" else _line_values(text)
    finally:
        text.detach()


def _line_values(text: TextIO) -> Iterator[tuple[Any, int]]:
    first = True
    while line := text.readline():
        if not line.strip():
            continue
        try:
            yield json.loads(line), len(line)
        except json.JSONDecodeError:
            if first:
                # No lines but one value over several, which is held whole.
                text.seek(0)
                line = text.read()
            try:
                yield json.loads(line), len(line)
            except json.JSONDecodeError:
                for part in line.splitlines():
                    if part.strip():
                        yield json.loads(part), len(part)
        first = False


def _elements(text: TextIO) -> Iterator[tuple[Any, int]]:
    """The elements of one array, of which a block of text is held at a time."""
    space, decoder = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()
    while text.read(1) != "[":
        pass
    held, at, ended, comma = text.read(CHUNK_CHARS), 0, False, False
    while True:
        at = space.match(held, at).end()
        if at < len(held) and held[at] == "]" and not comma:
            break
        try:
            value, end = decoder.raw_decode(held, at)
            after = space.match(held, end).end()
            # A number may go on in the next block.
            if held[after : after + 1] not in (",", "]"):
                raise json.JSONDecodeError("Expecting ',' delimiter", held, after)
        except json.JSONDecodeError:
            if ended:
                raise
            more = text.read(max(CHUNK_CHARS, len(held) - at))
            held, at, ended = held[at:] + more, 0, not more
            continue
        yield value, end - at
        comma = held[after] == ","
        at = after + comma
    if (held[at + 1 :] + text.read()).strip():
        raise json.JSONDecodeError("Extra data", held, at + 1)


def _with_all_fields(records: list[dict]) -> list[dict]:
    """A column is taken from the first record, so that one names the fields of all."""
    names = dict.fromkeys(name for record in records for name in record)
    return [{**dict.fromkeys(names), **records[0]}, *records[1:]] if records else []


class UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class HttpSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT_NAME

    def reader(self, schema):
        return HttpReader(self.options, schema)


class HttpReader(DataSourceReader):
    def __init__(self, options, schema):
        self.urls = json.loads(options["urls"])
        self.headers = json.loads(options["headers"])
        self.body = options["body"]
        self.timeout = float(options["timeout"])
        self.schema = schema

    def partitions(self):
        return [UrlPartition(url) for url in self.urls]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        with fetched(partition.url, self.headers, self.timeout) as body:
            for table in decode(body, self.body, partition.url, wanted):
                columns = [
                    table[f.name].cast(f.type) if f.name in table.column_names
                    else pa.nulls(table.num_rows, f.type)
                    for f in wanted
                ]
                yield from pa.Table.from_arrays(columns, schema=wanted).to_batches()
