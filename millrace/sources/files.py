"""File scans: format detection, globs, probes, footer counts and row slices."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import messages, storage
from millrace.params import dated_paths, dates_between, run_date_pattern
from millrace.sources.http import detect_http_format, read_http
from millrace.sources.quoted import LEFT_TO_THE_READER, read_quoted

# Extension -> reader; everything else is Parquet.
FORMAT_OF_SUFFIX = {
    ".json": "json",
    ".ndjson": "json",
    ".jsonl": "json",
    ".csv": "csv",
    ".tsv": "csv",
}
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy")


def detect_format(path: str) -> str:
    """``parquet``, ``csv`` or ``json`` from the last segment of a path or glob."""
    return FORMAT_OF_SUFFIX.get(_suffix(path), "parquet")


def _suffix(path: str) -> str:
    segment = path.lower().rstrip("/").rpartition("/")[2]
    for ending in _COMPRESSED:
        segment = segment.removesuffix(ending)
    dot = segment.rfind(".")
    return segment[dot:] if dot >= 0 else ""


def read_files(
    spark: SparkSession,
    path: str | list[str],
    *,
    schema=None,
    options: dict | None = None,
    format: str | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Read files as one relation; the reader follows the extension of each path, or
    ``format``. Paths that need different readers are united by column name.

    ``**`` stands for folders at any depth; ``http(s)`` paths are fetched. A CSV file's
    delimiter is the one of ``, ; | tab`` that cuts its lines into as many fields as its
    first line, a tie being an error, and quotes may span lines; a file of a first line alone
    takes the layout of others that begin with the same. A .json file may hold
    lines, an array or one indented object. Both are decided file by file in one pass over
    the text. Give ``schema`` and the options
    ``sep`` or ``multiLine`` for large text inputs: then no such pass is made. CSV files
    with quotes over lines that are longer than a scan's partition are read by several
    tasks (:mod:`millrace.sources.quoted`). Rows that do not fit fail unless the option
    ``mode`` says otherwise. ``origin`` names a column with the file of each row.
    """
    paths, options = [path] if isinstance(path, str) else list(path), options or {}
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        if storage.is_http(p):
            groups.setdefault(("http", format or detect_http_format(p)), []).append(p)
        else:
            fmt = format or detect_format(p)
            groups.setdefault((fmt, _suffix(p), _tail(p)), []).append(p)
    frames = []
    for (fmt, *rest), members in groups.items():
        if fmt == "http":
            config = {"urls": members, "schema": schema}
            fetched = read_http(spark, {**config, "format": format} if format else config)
            frames.append(_with_origin(fetched, origin))
        else:
            frames += _read_alike(spark, fmt, rest[0], members, schema, options, origin)
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def _tail(path: str) -> str | None:
    return path.partition("**")[2].strip("/") if "**" in path else None


def _with_origin(df: DataFrame, origin: str | None) -> DataFrame:
    return df.withColumn(origin, F.col("_metadata.file_path")) if origin else df


def _read_alike(spark, fmt, suffix, paths, schema, options, origin) -> list[DataFrame]:
    """Paths of one format: one DataFrame for each layout their files have."""
    lookup, tail = {}, _tail(paths[0])
    if tail is not None and "/" in tail:
        paths = [file for p in paths for file in _below(spark, p)]
    elif tail is not None:
        lookup = {"recursiveFileLookup": True, **({"pathGlobFilter": tail} if tail else {})}
        paths = [p.partition("**")[0].rstrip("/") or "." for p in paths]
    uris = [storage.storage_uri(spark, p) for p in paths]

    def load(members, **layout):
        reader = spark.read.format(fmt).options(**lookup, **layout)
        if schema is not None:
            reader = reader.schema(schema)
        return _with_origin(reader.options(**options).load(members), origin)

    if fmt == "csv":
        common = {"header": True, "inferSchema": schema is None, "escape": '"', "preferDate": True,
                  "mode": "FAILFAST"}
        if suffix == ".tsv":
            common["sep"] = "\t"
        given = {name.lower() for name in options} | common.keys()
        if given & {"sep", "delimiter"} and "multiline" in given:
            many = {**common, **{name.lower(): value for name, value in options.items()}}["multiline"]
            if str(many).lower() == "true" and _in_pieces(spark, uris, options, lookup):
                return [read_quoted(spark, uris, schema=schema, lookup=lookup, origin=origin,
                                    **{**common, **options})]
            return [load(uris, **common)]
        fixed = bool(given & {"sep", "delimiter"})
        layouts = _dialects(spark, uris, lookup, fixed)
        if fixed:
            layouts = [(None, *layout[1:]) for layout in layouts]
    elif fmt == "json":
        common = {"mode": "FAILFAST"}
        if suffix in (".ndjson", ".jsonl") or "multiline" in {name.lower() for name in options}:
            return [load(uris, **common)]
        layouts = _json_layouts(spark, uris, lookup)
    else:
        return [load(uris)]
    frames = []
    for sep, many, files in layouts:
        own = {**({"sep": sep} if sep else {}), **common, "multiLine": many}
        if len(layouts) == 1:
            files = uris
        elif len(uris) == 1 and not storage.has_glob(uris[0]) and not lookup:
            own["basePath"] = uris[0]
        if fmt == "csv" and many and _in_pieces(spark, files, options, lookup):
            frames.append(read_quoted(spark, files, schema=schema, lookup=lookup, origin=origin,
                                      **{**own, **options}))
        else:
            frames.append(load(files, **own))
    return frames


def _in_pieces(spark, uris, options, lookup) -> bool:
    """Whether one of these CSV files would keep a task longer than a partition of the scan.

    Files below ``column=value`` folders and options that change what ends a record are
    left to the reader.
    """
    if LEFT_TO_THE_READER & {name.lower() for name in options} or any(
            "=" in storage.name_of(storage.parent_of(uri)) for uri in uris):
        return False
    ranges = spark.read.options(**lookup).text(uris)
    if ranges.columns != ["value"]:
        return False
    longest = spark.conf.get("spark.sql.files.maxPartitionBytes")
    limit = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(longest))
    sizes = spark.read.options(**lookup).format("binaryFile").load(uris).agg(F.max("length")).first()[0]
    return sizes is not None and sizes > limit


# Delimiters that a CSV file may have; the first is that of files without any.
_MARKS = (",", ";", "|", "\t")


def _lines(spark, uris, lookup) -> DataFrame:
    """``file, block, line, value`` of every line with text; in a file, ranges follow each
    other by ``block`` and the lines of a range by ``line``."""
    return (
        spark.read.options(**lookup).text(uris)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"), "value")
        .where(F.trim("value") != "")
    )


def _at_places(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The ``lines`` at ``places``, which are few: one for each file."""
    return lines.join(F.broadcast(places), ["file", "block", "line"])


def _dialects(spark, uris, lookup, fixed: bool) -> list[tuple[str, bool, list[str]]]:
    """CSV layouts with their files.

    Per file and delimiter, one aggregation counts lines by their number of fields. Lines
    with an odd number of quotes begin or end a text over several lines and are no
    evidence. ``fixed`` says that the delimiter is given, so nothing can be in doubt.
    """

    def marks_in(text, mark):
        return F.length(text) - F.length(F.replace(text, F.lit(mark)))

    lines, bare = _lines(spark, uris, lookup), F.regexp_replace("value", '"[^"]*"', "")
    cuts = [F.struct(F.lit(i).alias("rank"), (marks_in(bare, mark) + 1).alias("fields"))
            for i, mark in enumerate(_MARKS)]
    # Numbers only, which a hash aggregation takes; no text or struct is sorted or held.
    ranges = (
        lines.select("file", "block", "line", (marks_in(F.col("value"), '"') % 2 == 1).alias("odd"),
                     F.inline(F.array(*cuts)))
        .groupBy("file", "block", "rank", "fields")
        .agg(F.count_if(~F.col("odd")).alias("lines"), F.min("line").alias("line"),
             F.min(F.when(F.col("odd"), F.col("line"))).alias("odd_line"))
    )
    place = F.struct("block", "line")
    histogram = ranges.groupBy("file", "rank", "fields").agg(
        F.sum("lines").alias("lines"), F.min_by(F.col("line").eqNullSafe(F.col("odd_line")), place).alias("first_odd"),
        F.min(place).alias("place"), F.max(F.col("odd_line").isNotNull()).alias("odd"))
    # Few rows each: the different numbers of fields in one file by one delimiter.
    same = Window.partitionBy("file", "rank")
    head = F.min_by(F.struct("fields", "first_odd"), "place").over(same)
    evidence = (
        histogram.withColumn("head", head)
        .groupBy("file", "rank")
        .agg(F.first("head.fields").alias("fields"), F.first("head.first_odd").alias("head_odd"),
             F.sum("lines").alias("rows"), F.max("odd").alias("odd"), F.min("place").alias("place"),
             F.sum(F.when(F.col("fields") == F.col("head.fields"), F.col("lines")).otherwise(0)).alias("agree"))
        .withColumn("rows", F.col("rows") - F.when(F.col("head_odd"), 0).otherwise(1))
        .withColumn("agree", F.col("agree") - F.when(F.col("head_odd"), 0).otherwise(1))
    )
    # Agreement decides; without any, the number of fields in the first line.
    score = F.struct("agree", F.when(F.col("agree") == 0, F.col("fields")).otherwise(0).alias("fields"))
    many = F.col("fields") > 1
    found = evidence.groupBy("file").agg(
        F.max("rows").alias("rows"), F.max("odd").alias("odd"), F.min("place").alias("place"),
        F.max(F.when(many, score)).alias("best"),
        F.collect_list(F.when(many, F.struct(score.alias("score"), "rank"))).alias("several"),
        F.max(F.when(~many, F.struct("agree", (-F.col("rank")).alias("rank")))).alias("one"))
    top = F.filter("several", lambda x: x["score"] == F.col("best"))
    lone = F.col("best").isNull() | ((F.col("best.agree") == 0) & (F.col("rows") > 0) & ~F.col("odd")
                                     & (F.col("one.agree") == F.col("rows")))
    rank = F.when(lone, -F.col("one.rank")).when(F.size(top) == 1, top[0]["rank"])
    decided = found.select(
        "file", _as_path(F.col("file")).alias("path"), F.get(F.array(*map(F.lit, _MARKS)), rank).alias("sep"), F.col("odd").alias("many"),
        ((F.col("rows") == 0) & ~F.col("odd")).alias("bare"), "place").collect()
    if not fixed:
        decided = _heads_alike(lines, decided)
    layouts = _grouped(decided)
    unsure = [files for sep, _, files in layouts if sep is None]
    if unsure and not fixed:
        raise ValueError(messages.DELIMITER_UNSURE.format(path=unsure[0][0]))
    return layouts or [("", False, uris)]


def _heads_alike(lines: DataFrame, decided: list) -> list:
    """``decided`` files; one of a first line alone, as a task without rows writes it, has
    no evidence and takes the layout of the files with the same first line and with more."""
    decided = [row.asDict() for row in decided]
    if not any(r["bare"] for r in decided) or all(r["bare"] for r in decided):
        return decided
    places = lines.sparkSession.createDataFrame(
        [(r["file"], *r["place"]) for r in decided], "file string, block long, line long")
    heads = dict(_at_places(lines, places).select("file", F.sha2("value", 256)).collect())
    known: dict[str, set] = {}
    for r in decided:
        if not r["bare"]:
            known.setdefault(heads[r["file"]], set()).add((r["sep"], r["many"]))
    for r in decided:
        others = known.get(heads[r["file"]], set())
        if r["bare"] and len({sep for sep, _ in others}) == 1:
            r["sep"], r["many"] = min(others)
    return decided


def _json_layouts(spark, uris, lookup) -> list[tuple[str, bool, list[str]]]:
    """JSON layouts with their files: lines, where the first line is a whole value."""
    lines = _lines(spark, uris, lookup)
    ranges = lines.groupBy("file", "block").agg(F.min("line").alias("line"))
    places = ranges.groupBy("file").agg(F.min(F.struct("block", "line")).alias("place")).select("file", "place.*")
    many = F.get_json_object("value", "$").isNull().alias("many")
    heads = _at_places(lines, places).select(_as_path(F.col("file")).alias("path"), F.lit("").alias("sep"), many)
    return _grouped(heads.collect()) or [("", False, uris)]


def _grouped(found: list) -> list[tuple[str, bool, list[str]]]:
    """Files by layout; the driver gets one name per file, as for any scan."""
    layouts: dict[tuple, list[str]] = {}
    for row in sorted(found, key=lambda row: row["path"]):
        layouts.setdefault((row["sep"], row["many"]), []).append(row["path"])
    ordered = sorted(layouts.items(), key=lambda item: (item[0][0] or "", item[0][1]))
    return [(*layout, files) for layout, files in ordered]


def _as_path(uri):
    """A file's URI as a path to load: not percent-encoded, glob characters quoted."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"([\[\]{}*?\\])", r"\\$1")


def _below(spark, path: str) -> list[str]:
    """Files that a path with ``**/`` before further folders names."""
    root = path.partition("**")[0].rstrip("/") or "."
    below = re.escape(storage.absolute(spark, root)) + "/"
    body = path.partition("**")[2]
    pattern = r"(?:.*/)?" + _glob_regex(body.lstrip("/"))
    files = list_files(spark, root).where(F.col("path").rlike(f"^{below}{pattern}$"))
    found = [r[0] for r in files.select(_as_path(F.col("path"))).orderBy("path").collect()]
    if not found:
        raise FileNotFoundError(messages.NO_MATCH.format(path=path))
    return found


def _glob_regex(glob: str) -> str:
    marks = {"**/": r"(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(marks.get(part) or re.escape(part)
                   for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob) if part)


def require_match(spark: SparkSession, path: str | list[str]) -> None:
    """Fail early when a local path or glob names nothing."""
    for one in [path] if isinstance(path, str) else path:
        if storage.is_remote(one):
            continue
        plain = one.partition("**")[0].rstrip("/") if "**" in one else one
        if storage.matches(spark, plain or ".") == 0:
            raise FileNotFoundError(messages.NO_MATCH.format(path=one))


def probe_files(spark: SparkSession, path: str | list[str]) -> dict:
    """Reachability and up to ten of the matched files."""
    started = time.perf_counter()

    def answer(connected, message, details=None):
        latency = round((time.perf_counter() - started) * 1000, 1)
        return {"connected": connected, "message": message,
                "latency_ms": latency, "details": details or {}}

    if not path:
        return answer(False, messages.PROBE_NO_PATH)
    paths = [path] if isinstance(path, str) else path
    if all(map(storage.is_remote, paths)):
        return answer(True, messages.PROBE_REMOTE.format(path=path))
    try:
        require_match(spark, path)
    except FileNotFoundError:
        return answer(False, messages.PROBE_NO_MATCH.format(path=path))
    files = list_files(spark, path)
    shown = [row["path"] for row in files.orderBy("path").limit(10).collect()]
    return answer(True, messages.PROBE_FOUND.format(files=files.count()), {"files": shown})


def list_files(
    spark: SparkSession, path: str | list[str], name_glob: str | None = None
) -> DataFrame:
    """``path, length`` of every file below a path; the listing runs on executors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    paths = [path] if isinstance(path, str) else path
    return reader.load([storage.storage_uri(spark, p) for p in paths]).select("path", "length")


def footer_counts(df: DataFrame) -> DataFrame:
    """Rows per file. No column is read, only row counts in the Parquet footers."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("num_rows")
    )


def row_slice(df: DataFrame, start: int, end: int, file_path: str | None = None) -> DataFrame:
    """Rows ``[start, end)`` by physical position inside each Parquet file."""
    position = F.col("_metadata.row_index")
    kept = (position >= start) & (position < end)
    if file_path is not None:
        kept = kept & (F.col("_metadata.file_path") == file_path)
    return df.where(kept)


def dated_days(spark: SparkSession, template: str, first, last) -> DataFrame:
    """``run_date, path, found``: which days of a date-parameterised path there are."""
    days = [(day, dated_paths(template, day, day)[0]) for day in dates_between(first, last)]
    return spark.createDataFrame(
        [(day, path, storage.matches(spark, path) > 0) for day, path in days],
        "run_date date, path string, found boolean")


def read_dated(
    spark: SparkSession, template: str, first, last, *, run_date="run_date", schema=None,
    missing: str = "skip",
) -> DataFrame:
    """All days of a date-parameterised path as one scan, each row with its run date.

    Days without files are skipped, or refused with ``missing="fail"``; :func:`dated_days`
    lists them.
    """
    wanted = dated_paths(template, first, last)
    paths = [path for path in wanted if storage.is_http(path) or storage.matches(spark, path)]
    if not paths or (missing == "fail" and len(paths) < len(wanted)):
        absent = [path for path in wanted if path not in set(paths)]
        raise FileNotFoundError(messages.NO_MATCH.format(path=", ".join(absent)))
    pattern, extra_days = run_date_pattern(template)
    group = re.compile(pattern).groupindex
    java = pattern.replace("(?P<", "(?<")
    origin = f"_file_{uuid.uuid4().hex}"
    found = [F.regexp_extract(origin, java, group[g]).cast("int") for g in "ymd"]
    df = read_files(spark, paths, schema=schema, origin=origin)
    return df.withColumn(run_date, F.date_add(F.make_date(*found), extra_days)).drop(origin)
