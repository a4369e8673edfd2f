"""Ad-hoc SQL: any query, one page of it, its size, or all of it as files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import messages
from millrace.errors import SpecError
from millrace.operators.access import denied_in_texts, denied_paths
from millrace.operators.sinks import staged_overwrite
from millrace.plans.paging import page_at
from millrace.session import run_session
from millrace.sources.catalog import dataset_paths, named_in, register_datasets
from millrace.sources.files import read_files

DEFAULT_PAGE_SIZE = 50

# A text or a comment, or a call of a file function: its format and its arguments.
_FILE_CALL = re.compile(
    r"('(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/)|\bread_(parquet|csv|json|ndjson)(?:_auto)?\(((?:[^()']|'(?:[^']|'')*')*)\)",
    re.I,
)
_TEXT = r"'(?:[^']|'')*'"
_PATHS = re.compile(rf"\s*(?:{_TEXT}|\[\s*{_TEXT}(?:\s*,\s*{_TEXT})*\s*\])\s*")
_OPTION = re.compile(rf"\s*,\s*(\w+)\s*(?:=>|:=|=)\s*({_TEXT}|\w+)\s*")
# Option names of file functions and the reader options they set.
_READER_OPTIONS = {
    "delim": "sep", "sep": "sep", "header": "header", "quote": "quote", "escape": "escape",
    "nullstr": "nullValue", "skip_errors": "mode", "comment": "comment", "encoding": "encoding",
    "dateformat": "dateFormat", "timestampformat": "timestampFormat", "multiline": "multiLine",
}
_TRAILER = re.compile(r"(?:\s|;)+$")


@dataclass
class Page:
    """One bounded page; ``total_rows`` is -1 unless it was asked for."""

    table: pa.Table
    page: int
    page_size: int
    has_more: bool
    total_rows: int = -1


def run_sql(
    spark: SparkSession,
    query: str,
    *,
    datasets: dict[str, dict] | None = None,
    views: dict[str, str] | None = None,
    roles: DataFrame | None = None,
    role: str | None = None,
) -> DataFrame:
    """Any query over saved datasets, over ``views`` (name -> path), or over files
    named in it as ``read_csv('...', delim = ';')`` or ``read_parquet(['...', '...'])``;
    refused when the role may not read an ``s3://`` path that it names or that a named
    dataset or view stands for."""
    if role:
        if roles is None:
            raise SpecError(f"role '{role}' needs a roles table")
        behind = [path for name in named_in(datasets or {}, query)
                  for path in dataset_paths(datasets[name])]
        for path in (views or {}).values():
            behind += [path] if isinstance(path, str) else path
        denied = denied_in_texts(spark, roles, role, [query])
        denied += [p for p in denied_paths(spark, roles, role, behind) if p not in denied]
        if denied:
            raise PermissionError(messages.ACCESS_DENIED.format(paths=", ".join(denied)))
    session = run_session(spark)
    register_datasets(session, datasets or {}, query)
    for name, path in (views or {}).items():
        read_files(session, path).createOrReplaceTempView(name)
    return session.sql(_file_views(session, clean_query(query)))


def clean_query(query: str) -> str:
    """Without trailing separators; Spark itself skips comments."""
    return _TRAILER.sub("", query)


def _file_views(session: SparkSession, query: str) -> str:
    paths: dict[tuple[str, str], str] = {}

    def view_for(match):
        if match[1]:
            return match[1]
        call = (match[2].lower(), match[3].strip())
        if call not in paths:
            paths[call] = f"_file_{len(paths)}"
            _read_call(session, *call).createOrReplaceTempView(paths[call])
        return paths[call]

    return _FILE_CALL.sub(view_for, query)


def _read_call(session: SparkSession, kind: str, arguments: str) -> DataFrame:
    """The files of one call; the function's name decides the format."""
    named = _PATHS.match(arguments)
    if not named:
        raise ValueError(f"read_{kind} takes a path or a list of paths, not {arguments}")
    paths, options, at = [_plain(t) for t in re.findall(_TEXT, named[0])], {}, named.end()
    while at < len(arguments):
        option = _OPTION.match(arguments, at)
        if not option or option[1].lower() not in _READER_OPTIONS:
            known = ", ".join(_READER_OPTIONS)
            raise ValueError(f"read_{kind} does not know {arguments[at:].strip(', ')}; it knows {known}")
        name, value = _READER_OPTIONS[option[1].lower()], _plain(option[2])
        if name == "mode":
            value = "DROPMALFORMED" if value.lower() == "true" else "FAILFAST"
        options[name], at = value, option.end()
    fmt = "json" if kind == "ndjson" else kind
    if kind == "ndjson":
        options["multiLine"] = "false"
    return read_files(session, paths, options=options, format=fmt)


def _plain(text: str) -> str:
    return text[1:-1].replace("''", "'") if text.startswith("'") else text


def page_frame(
    df: DataFrame, page: int = 0, page_size: int = DEFAULT_PAGE_SIZE, order_by=None
) -> DataFrame:
    """The page's rows and one more, which tells whether another page follows."""
    if order_by:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.offset(page * page_size).limit(page_size + 1)


def page_after(
    df: DataFrame, order_by: list[str], after: tuple | None = None,
    page_size: int = DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """The rows that follow a key: as many for the last page as for the first, where an
    offset would gather all pages before. ``order_by`` are columns, ascending with nulls
    first, that tell rows apart; ``after`` holds the last row's values of them."""
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for name, value in zip(order_by, after, strict=True):
            column = F.col(name)
            bigger = column.isNotNull() if value is None else column > F.lit(value)
            later, same = later | (same & bigger), same & column.eqNullSafe(F.lit(value))
        df = df.where(later)
    return df.orderBy(*order_by).limit(page_size)


def page_sql(
    spark: SparkSession,
    query: str,
    *,
    page: int = 0,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by=None,
    count_total: bool = False,
    **context,
) -> Page:
    """One page as an Arrow table. Without an order, pages of a query that does not
    sort may overlap. With names of columns in ``order_by`` a page costs no more the
    later it comes (:func:`millrace.plans.paging.page_at`)."""
    df = run_sql(spark, query, **context)
    names = [order_by] if isinstance(order_by, str) else order_by
    if names and all(name in df.columns for name in names if isinstance(name, str)) and all(
            isinstance(name, str) for name in names) and len(set(df.columns)) == len(df.columns):
        table = page_at(df, list(names), page * page_size, page_size + 1).toArrow()
    else:
        table = page_frame(df, page, page_size, order_by).toArrow()
    return Page(
        table=table.slice(0, page_size),
        page=page,
        page_size=page_size,
        has_more=table.num_rows > page_size,
        total_rows=df.count() if count_total else -1,
    )


def total_rows(df: DataFrame) -> DataFrame:
    """The size of a query's result as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def export_sql(spark: SparkSession, query: str, path: str, **context) -> int:
    """The full result as Parquet files; returns the number of rows."""
    return staged_overwrite(run_sql(spark, query, **context), path)
