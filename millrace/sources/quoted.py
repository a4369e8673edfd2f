"""CSV files with quoted texts over several lines, read by many tasks.

A byte range of such a file does not tell whether it starts inside quotes. Each range is
scanned for both cases, which gives a function from the state at its start to the state at
its end; the functions of a file's ranges, applied one after the other, give every range
its start. Then each range cuts its own records, and only the pieces of records that lie
in several chunks meet in a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace import messages

# Characters of a chunk: lines of one range that travel as one row. A longer line is a
# chunk of its own.
CHUNK_CHARS = 1 << 20

# Reader options that change what ends a record; files with these are left to the reader.
LEFT_TO_THE_READER = frozenset((
    "encoding", "charset", "linesep", "comment", "quote", "header", "ignoreleadingwhitespace",
    "unescapedquotehandling", "columnnameofcorruptrecord", "inputbuffersize",
))


class Quotes:
    """Where quoted texts begin and end, as the CSV reader sees it: a quote opens one at
    the start of a field only; inside, it closes unless it is escaped; what stands between
    a closing quote and the next delimiter belongs to the field."""

    def __init__(self, sep: str, escape: str = '"'):
        self._opening = re.compile(rf'(?:\A|(?<=\n)|(?<={re.escape(sep)}))"')
        mark = re.escape(escape)
        inner = r'[^"]*+(?:""[^"]*+)*+"(?!")' if escape == '"' else rf'(?:[^"{mark}]|{mark}.|{mark}\Z)*+"'
        self._closing = re.compile(inner, re.DOTALL)

    def spans(self, text: str, inside: bool):
        """``start, end`` of every quoted stretch, ``end`` being None for an open one."""
        at = 0
        while True:
            if not inside:
                opening = self._opening.search(text, at)
                if opening is None:
                    return
                at = opening.end()
            closing = self._closing.match(text, at)
            yield at, closing.end() if closing else None
            if closing is None:
                return
            at, inside = closing.end(), False

    def after(self, text: str, inside: bool) -> bool:
        """Whether the line after ``text`` starts inside quotes."""
        if '"' not in text:
            return inside
        last = None
        for last in self.spans(text, inside):
            pass
        return last is not None and last[1] is None

    def pieces(self, text: str, inside: bool) -> tuple[list[str], bool]:
        """``text`` cut at the line ends outside quotes, and whether the last piece is open."""
        cuts, at, still = [], 0, False
        for start, end in self.spans(text, inside):
            cuts += [m.start() for m in re.compile("\n").finditer(text, at, start)]
            at, still = (len(text), True) if end is None else (end, False)
        cuts += [m.start() for m in re.compile("\n").finditer(text, at)]
        begins = [0, *(cut + 1 for cut in cuts)]
        return [text[b:e] for b, e in zip(begins, [*cuts, len(text)])], still

    def stray(self, text: str, inside: bool) -> bool:
        """Whether a carriage return stands outside quotes, other than at the end."""
        if "\r" not in text[:-1]:
            return False
        at, text = 0, text.removesuffix("\r")
        for start, end in self.spans(text, inside):
            if "\r" in text[at:start]:
                return True
            at = len(text) if end is None else end
        return "\r" in text[at:]


def _chunks(batches, limit):
    """Lines of one range after another as ``file, block, number, text``."""
    key, number, held, size = None, 0, [], 0
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        for file, block, value in zip(files, blocks, values):
            if key != (file, block) or size + len(value) > limit:
                if held:
                    yield (*key, number, "\n".join(held))
                number = number + 1 if key == (file, block) else 0
                key, held, size = (file, block), [], 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield (*key, number, "\n".join(held))


def _lines(spark, uris, lookup) -> DataFrame:
    return spark.read.options(**lookup).option("lineSep", "\n").text(uris).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        "value")


def range_states(lines: DataFrame, quotes: Quotes, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``file, block, inside``: whether the first line of a range starts inside quotes.

    One row per range. A range whose end does not depend on its start fixes the state; the
    others keep it or turn it round, so counting turns since the last fixed one suffices.
    """

    def scan(batches):
        ends: dict = {}
        for file, block, _, text in _chunks(batches, chunk_chars):
            if ends and (file, block) not in ends:
                yield _effects(ends)
                ends = {}
            outer, inner = ends.get((file, block), (False, True))
            same = quotes.after(text, False), quotes.after(text, True)
            ends[file, block] = same[outer], same[inner]
        if ends:
            yield _effects(ends)

    effects = lines.mapInArrow(scan, "file string, block long, outer boolean, inner boolean")
    along = Window.partitionBy("file").orderBy("block")
    fixed = F.col("outer") == F.col("inner")
    since = Window.partitionBy("file", "since").orderBy("block")
    turns = F.sum(F.when(~fixed & F.col("outer"), 1).otherwise(0)).over(since)
    start = F.first(F.when(fixed, F.col("outer")).otherwise(F.lit(False))).over(since)
    return (
        effects.withColumn("since", F.count_if(fixed).over(along))
        .withColumn("end", start != (turns % 2 == 1))
        .select("file", "block", F.lag("end", 1, False).over(along).alias("inside"))
    )


def _effects(ends: dict) -> pa.RecordBatch:
    ((file, block), (outer, inner)), = ends.items()
    return pa.RecordBatch.from_pydict(
        {"file": pa.array([file], pa.string()), "block": pa.array([block], pa.int64()),
         "outer": [outer], "inner": [inner]})


def quoted_records(
    spark: SparkSession, uris: list[str], sep: str = ",", *, escape: str = '"',
    lookup: dict | None = None, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``file, heads, value``: every record of CSV files, ``heads`` for a file's first.

    Quoted line ends stay as they are; an empty line outside quotes is no record; a carriage
    return within a line and outside quotes is an error, since it may end a line. The text
    is scanned three times, for the states of ranges, for whole records and for pieces of
    records that several chunks share; ranges are those of the file scan.
    """
    quotes = Quotes(sep, escape)
    lines = _lines(spark, uris, lookup or {})

    def pack(batches):
        state, before = (False, True), None
        for file, block, number, text in _chunks(batches, chunk_chars):
            if before != (file, block):
                state, before = (False, True), (file, block)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([file], pa.string()), "block": pa.array([block], pa.int64()),
                 "number": pa.array([number], pa.int64()), "text": pa.array([text], pa.string()),
                 "outer": [state[0]], "inner": [state[1]]})
            after = quotes.after(text, False), quotes.after(text, True)
            state = after[state[0]], after[state[1]]

    packed = lines.mapInArrow(
        pack, "file string, block long, number long, text string, outer boolean, inner boolean")
    starts = range_states(lines, quotes, chunk_chars)
    chunks = packed.join(starts, ["file", "block"]).select(
        "file", "block", "number", "text",
        F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")).alias("inside"))

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts, still = quotes.pieces(row["text"], row["inside"])
                if any(quotes.stray(text, row["inside"] and not i) for i, text in enumerate(texts)):
                    raise ValueError(messages.STRAY_RETURN.format(path=row["file"]))
                count = len(texts)
                begins = [True] * count
                begins[0] = not row["inside"]
                whole = list(begins)
                whole[-1] = whole[-1] and not still
                heads = [False] * count
                if row["block"] == 0 and row["number"] == 0:
                    first = next((i for i, text in enumerate(texts) if text.strip()), None)
                    if first is not None:
                        heads[first] = True
                yield pa.RecordBatch.from_pydict(
                    {"file": pa.array([row["file"]] * count, pa.string()),
                     "block": pa.array([row["block"]] * count, pa.int64()),
                     "number": pa.array([row["number"]] * count, pa.int64()),
                     "piece": pa.array(range(count), pa.int64()), "value": pa.array(texts, pa.string()),
                     "begins": begins, "whole": whole, "heads": heads})

    pieces = chunks.mapInArrow(
        cut, "file string, block long, number long, piece long, value string, begins boolean, "
             "whole boolean, heads boolean")
    # Few rows: at most two pieces of a chunk are parts of records.
    order = Window.partitionBy("file").orderBy("block", "number", "piece")
    parts = pieces.where(~F.col("whole")).withColumn("record", F.count_if("begins").over(order))
    place = F.struct("block", "number", "piece", "value")
    joined = parts.groupBy("file", "record").agg(
        F.max("heads").alias("heads"),
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(place)), lambda p: p["value"])).alias("value"))
    records = pieces.where("whole").select("file", "heads", "value").unionByName(joined.select("file", "heads", "value"))
    return records.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where(F.trim("value") != "")


def read_quoted(
    spark: SparkSession, uris: list[str], *, schema=None, lookup: dict | None = None,
    origin: str | None = None, chunk_chars: int = CHUNK_CHARS, **options,
) -> DataFrame:
    """CSV files as the reader gives them with ``header`` and ``multiLine``, by many tasks.

    ``options`` are the reader's; without ``schema``, types are inferred from all records.
    ``origin`` names a column with the file of each row.
    """
    options = {name.lower(): value for name, value in options.items()}
    sep = options.get("sep") or options.get("delimiter") or ","
    records = quoted_records(spark, uris, sep, escape=options.get("escape", '"'), lookup=lookup,
                             chunk_chars=chunk_chars)
    kept = {k: v for k, v in options.items() if k not in ("header", "inferschema")} | {"multiline": True}
    heads = records.where("heads").agg(F.min_by("value", "file")).first()[0]
    body = records.where(~F.col("heads"))
    names = [] if heads is None else _read_texts(
        spark, spark.createDataFrame([(heads,)], "value string"), {**kept, "header": True}).columns
    if schema is None:
        infer = str(options.get("inferschema", True)).lower()
        found = _read_texts(spark, body.select("value"), {**kept, "header": False, "inferSchema": infer}).schema
        types = [field.dataType for field in found.fields][:len(names)]
        schema = StructType()
        for i, name in enumerate(names):
            schema = schema.add(name, types[i] if i < len(types) else "string")
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return _parsed(body, schema, kept, origin)


def _read_texts(spark, texts: DataFrame, options: dict) -> DataFrame:
    """The reader over texts of one record each; Python's reader takes only files and RDDs."""
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    reader = spark.read.options(**options)
    return DataFrame(reader._jreader.csv(getattr(texts._jdf, "as")(encoder)), spark)


def _parsed(body: DataFrame, schema, options: dict, origin: str | None) -> DataFrame:
    mode = str(options.get("mode", "PERMISSIVE")).upper()
    wanted, bad = schema, None
    if mode == "DROPMALFORMED":
        bad = "_bad"
        while bad in schema.fieldNames():
            bad += "_"
        wanted = StructType(list(schema.fields)).add(bad, "string")
        options = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    row = F.from_csv("value", wanted.toDDL(), {k: str(v) for k, v in options.items()})
    rows = body.select("file", row.alias("row"))
    if bad:
        rows = rows.where(F.col("row").getField(bad).isNull())
    columns: list[Column] = [F.col("row").getField(name).alias(name) for name in schema.fieldNames()]
    return rows.select(*columns, *([F.col("file").alias(origin)] if origin else []))
