"""WARC archives as a chunked record table.

Writing: a payload longer than one segment becomes several WARC records, the first one
and its continuations, so no record is larger than a segment and the archive keeps to
the format; all records of a page lie in one file. Reading: an archive streams line by line through a small state machine and
comes out as rows of record, chunk number, bytes, and the length and digest up to and
with that chunk. Memory holds one chunk, however long the record is.

Spark's own text files carry the archives: one row is a page's records, CRLF ends each. Files
are compressed as a whole, so a file is read by one task from its start.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 20
CHUNK = 1 << 16
DEDUPE_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
FILE_ROWS = 20_000
_EOL = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CHUNKS = (
    "page_id {kind}, record_id string, record_type string, refers_to {kind}, chunk long, "
    "payload binary, bytes_so_far long, digest_so_far string, last boolean"
)


def revisits(pages: DataFrame, id_column="page_id", payload_column="html",
             least: int = DEDUPE_BYTES) -> DataFrame:
    """``id``, ``url``, ``payload`` (binary), ``digest`` (hex SHA-1) and ``refers_to``:
    of equal payloads of ``least`` bytes or more, the row with the largest id, for all
    others. Only digests are grouped; of a payload that is not repeated, no row is."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit("").cast("binary"))
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_column).alias("id"), url.cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = (rows.where(F.col("size") >= least).groupBy("digest", "size")
              .agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1"))
    joined = rows.join(groups.drop("n"), ["digest", "size"], "left")
    other = F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("id", "url", "payload", "digest", other.alias("refers_to"))


def _record_id(page, digest: str) -> str:
    name = hashlib.md5(f"{page}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def _head(fields) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _EOL


def records(page, url, payload, digest, refers_to, segment=SEGMENT):
    """The WARC records of one page as bytes, each without its last CRLF."""
    name = [("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", DATE)]
    if page is not None:
        name.append(("Page-ID", page))
    if url is not None:
        # A target is one line without spaces.
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        name.append(("WARC-Target-URI", safe))
    name.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    name.append(("Payload-Length", len(payload)))
    if refers_to is not None:
        yield _head([("WARC-Type", "revisit"), *name, ("WARC-Profile", _PROFILE),
                     ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page", refers_to),
                     ("Content-Type", "application/http; msgtype=response"),
                     ("Content-Length", 0)]) + _EOL
        return
    cuts = range(0, max(1, len(payload)), segment)
    view = memoryview(payload)
    for number, at in enumerate(cuts, 1):
        part, last = view[at : at + segment], at + segment >= len(payload)
        if number == 1:
            fields = [("WARC-Type", "response"), *name]
            body = _HTTP
            if not last:
                fields.append(("WARC-Segment-Number", 1))
        else:
            whole = ("WARC-Segment-Total-Length", len(_HTTP) + len(payload))
            fields = [("WARC-Type", "continuation"),
                      ("WARC-Record-ID", _record_id(f"{page}#{number}", digest)), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", name[0][1]), ("WARC-Segment-Number", number),
                      *([whole] if last else [])]
            body = b""
        fields += [("Content-Type", "application/http; msgtype=response"),
                   ("Content-Length", len(body) + len(part))]
        yield b"".join((_head(fields), body, part, _EOL))


def write_warc(rows: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write rows of :func:`revisits` as gzipped archives into a new folder."""

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for row in zip(*(batch.column(n) for n in ("id", "url", "payload", "digest", "refers_to"))):
                # Files end between rows, so a page is one row however many records it has.
                page = _EOL.join(records(*(x.as_py() for x in row), segment))
                made.append(page)
                size += len(page)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (lines.write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_ROWS).text(path))


class _Reader:
    """Lines of one archive in, chunk rows out."""

    def __init__(self, number, chunk: int):
        self.number, self.chunk, self.fields, self.state = number, chunk, {}, "between"
        self.record, self.open = None, False

    def close(self):
        """To be called at the end of the archive."""
        if self.open or self.state != "between":
            raise ValueError("an archive ends within a record")

    def line(self, line: bytes):
        if self.state == "between":
            if line:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {line[:60]!r}")
                self.fields, self.state = {}, "head"
        elif self.state == "head":
            if line:
                name, _, value = line.partition(b":")
                self.fields[name.decode().lower()] = value.strip().decode()
            else:
                yield from self._begin()
        else:
            data = line if self.fresh else _EOL + line
            self.fresh = False
            if len(data) > self.need:
                raise ValueError("a record is longer than its Content-Length")
            self.need -= len(data)
            if self.state == "http":
                # The stored HTTP head ends with an empty line.
                if data == _EOL:
                    self.state, self.fresh_payload = "payload", True
            elif self.fresh_payload:
                self.fresh_payload = False
                yield from self._data(data[2:])
            else:
                yield from self._data(data)
            if not self.need:
                yield from self._end()

    def _begin(self):
        fields, kind = self.fields, self.fields["warc-type"]
        self.need, self.fresh, self.fresh_payload = int(fields["content-length"]), True, False
        if kind == "continuation":
            if not self.record or fields["warc-segment-origin-id"] != self.record["warc-record-id"]:
                raise ValueError("a continuation does not follow its record")
            self.open = "warc-segment-total-length" not in fields
            self.state = "payload"
        else:
            if self.open:
                raise ValueError("a record starts before the one before it is complete")
            self.record, self.count, self.size = fields, 0, 0
            self.digest, self.held = hashlib.sha1(), bytearray()
            self.open = "warc-segment-number" in fields
            self.state = "http"
        if not self.need:
            yield from self._end()

    def _data(self, data: bytes):
        self.held += data
        while len(self.held) > self.chunk:
            part = bytes(self.held[: self.chunk])
            del self.held[: self.chunk]
            yield self._row(part, False)

    def _row(self, part: bytes, last: bool):
        self.digest.update(part)
        self.size += len(part)
        self.count += 1
        return self._named(part, self.size, self.digest.copy().hexdigest(), last)

    def _named(self, part, size, digest, last):
        f = self.record
        page, other = f.get("page-id"), f.get("refers-to-page")
        return (page and self.number(page), f["warc-record-id"], f["warc-type"],
                other and self.number(other), self.count - 1, part, size, digest, last)

    def _end(self):
        self.state = "between"
        if self.open:
            return
        f = self.record
        stated = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        if f["warc-type"] == "revisit":
            self.count = 1
            yield self._named(None, int(f["payload-length"]), stated, True)
            return
        row = self._row(bytes(self.held), True)
        if row[7] != stated:
            raise ValueError(f"the payload of {f['warc-record-id']} differs from its digest")
        yield row


def read_chunks(spark: SparkSession, path: str, *, id_type: str = "bigint", payloads: bool = True,
                chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in a folder.

    ``page_id``, ``record_id``, ``record_type``, ``refers_to``, ``chunk`` (from 0),
    ``payload`` (null if ``payloads`` is off), ``bytes_so_far``, ``digest_so_far``,
    ``last``. A response has one row per chunk, one with an empty payload a single row.
    A revisit has one row without payload, with the length and digest of the payload it
    refers to. A payload that differs from its stated digest fails the read.
    """
    whole = id_type in ("bigint", "int", "smallint", "tinyint")

    def run(batches):
        number = int if whole else str
        reader, now = None, None
        types = [pa.int64() if whole else pa.string(), pa.string(), pa.string(),
                 pa.int64() if whole else pa.string(), pa.int64(), pa.binary(), pa.int64(),
                 pa.string(), pa.bool_()]
        names = [c.strip().split()[0] for c in _CHUNKS.split(",")]
        for batch in batches:
            out, held = [], 0
            for line, file in zip(batch.column(0), batch.column(1)):
                if (file := file.as_py()) != now:
                    if reader:
                        reader.close()
                    reader, now = _Reader(number, chunk), file
                for row in reader.line(line.as_py()):
                    held += len(row[5] or b"")
                    out.append(row if payloads else (*row[:5], None, *row[6:]))
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if reader:
            reader.close()

    lines = spark.read.option("lineSep", "\r\n").text(path)
    kind = "bigint" if whole else "string"
    return lines.select(F.col("value").cast("binary").alias("value"), "_metadata.file_path").mapInArrow(
        run, _CHUNKS.format(kind=kind))
