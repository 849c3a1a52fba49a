"""WARC archives: written by Spark's text writer, indexed, and read back by byte ranges.

A record is a header block, an empty line, the content and two line ends, as a
gzip member of its own.  The text writer, with an empty gzip member between
lines, puts them to any file system Spark knows.  Reading is index first: one
pass writes offset, length, URL and digest per record; a selection of index rows
is then sorted by file and offset, near neighbours are coalesced, and each range
is read at once.
"""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgflow.staging import stage

#: Digits of base 32 as ``conv`` writes them, and those of RFC 4648 (fixed values).
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Ranges at most so far apart are read as one; one read is at most about so long (a longer record is read alone).
GAP, READ = 64 << 10, 4 << 20

#: Bytes of archives that one task reads, on the average.
TASK = 64 << 20

#: What the text writer puts after each record: a gzip member of no bytes, as Latin-1 characters.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)

_INDEX = ("file string, offset long, length long, page_id long, url string, record_type string, "
          "payload_digest string, refers_to long")
_RECORD = "page_id long, url string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def with_references(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, html (null: empty) and ``first``: the smallest page_id with an equal payload, if there are several.

    Payloads are compared by SHA-256 and length, those under ``smallest`` bytes not
    at all.  A group of copies is one row before it is shuffled.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    data = F.col("html").cast("binary")
    keyed = pages.withColumn("key", F.sha2(data, 256)).withColumn("size", F.octet_length("html"))
    firsts = keyed.where(F.col("size") >= smallest).groupBy("key", "size").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(firsts.select("key", "size", "first"), ["key", "size"], "left").drop("key", "size")


def record(page_id: Column, url: Column, html: Column, first: Column, date: str) -> Column:
    """A whole record as text."""
    end = F.lit("\r\n")
    revisit = first.isNotNull() & (first != F.coalesce(page_id, first + 1))
    payload = html.cast("binary")

    def name(id_: Column) -> Column:
        digest = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), end, end)
    content = F.when(revisit, http).otherwise(F.concat(http, html))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(page_id)), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe), F.concat(F.lit("X-Page-ID: "), page_id.cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(payload)),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(first))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), first.cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), end, end, content, end, end)  # concat_ws leaves null lines out


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", smallest: int = 0) -> None:
    """One record for each row of ``pages`` (page_id, url, html), in as many files under ``path`` as Spark has tasks.

    Null html is an empty payload, a null url or page_id leaves its line out.  Of
    records with equal payloads the one with the smallest page_id is a response and
    the others revisits of it; rows that share that page_id, and rows without one, are
    all responses.  Other columns are not read; an empty table writes no record.
    """

    def member(column: pd.Series) -> pd.Series:
        return column.map(lambda x: gzip.compress(x, mtime=0))

    rows = with_references(pages, smallest)
    lines = rows.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("first"), date).cast("binary").alias("value"))
    lines = lines.select(F.pandas_udf(member, "binary")("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).text(path)


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return system.open_input_file(path)


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def _entry(head: dict[str, str]) -> dict:
    digest = head.get("WARC-Payload-Digest")
    number = [int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
    return {"page_id": number[0], "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
            "payload_digest": digest.split(":", 1)[1] if digest else None, "refers_to": number[1]}


def _records(file, feed: int = 4096, chunk: int = 1 << 20):
    """(offset, length, header) of each record; of its content nothing is kept."""
    size, begin, data, at = file.size(), 0, b"", 0  # data[at:] has not been read yet and begins at byte ``begin``
    while begin < size:
        member, head, ended, length = zlib.decompressobj(31), b"", False, 0
        while not member.eof:
            if at == len(data):
                data, at = file.read_at(chunk, begin + length), 0
                if not data:
                    raise ValueError(f"the record at {begin} has no end")
            part = data[at:at + feed]
            out = member.decompress(part)
            used = len(part) - len(member.unused_data)
            at, length = at + used, length + used
            if not ended:
                head += out
                ended = b"\r\n\r\n" in head
        if head:
            yield begin, length, _header(head[:head.index(b"\r\n\r\n")])
        begin += length


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives under ``path``: a row for each record, staged."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as file:
                    rows = []
                    for offset, length, head in _records(file):
                        rows.append({"file": uri, "offset": offset, "length": length, **_entry(head)})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_INDEX)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_INDEX)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return stage(files.repartition(4 * tasks).mapInArrow(run, _INDEX), "warc-index")


_ARROW_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
                          ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                          ("refers_to", pa.int64())])


def byte_ranges(index: DataFrame, gap: int = GAP, read: int = READ) -> DataFrame:
    """The selected records of ``index`` as ranges: file, start, stop, and the records' offsets and lengths in order.

    A range ends where the next record is more than ``gap`` bytes away or a multiple
    of ``read`` bytes has been passed, so its list of records is bounded.
    """
    order = Window.partitionBy("file").orderBy("offset")
    last = F.lag(F.col("offset") + F.col("length")).over(order)
    split = last.isNull() | (F.col("offset") - last > gap) | (F.floor(F.col("offset") / read) > F.floor(
        F.lag("offset").over(order) / read))
    numbered = index.select("file", "offset", "length", split.cast("int").alias("split"))
    numbered = numbered.withColumn("range", F.sum("split").over(order))
    return numbered.groupBy("file", "range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(index: DataFrame, gap: int = GAP, read: int = READ) -> DataFrame:
    """The records of the selected index rows; a revisit has no payload and null for payload and its size.

    The digest of a response is that of the bytes read; one that differs from the
    header's ends the job.
    """

    def run(batches):
        import base64
        import hashlib

        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["file"]) as file:
                    data = file.read_at(row["stop"] - row["start"], row["start"])
                out = []
                for item in row["records"]:
                    begin = item["offset"] - row["start"]
                    whole = zlib.decompress(data[begin:begin + item["length"]], 31)
                    end = whole.index(b"\r\n\r\n")
                    entry, content = _entry(_header(whole[:end])), whole[end + 4:-4]
                    payload = content[content.index(b"\r\n\r\n") + 4:]
                    if entry["record_type"] == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest != entry["payload_digest"]:
                            raise ValueError(f"damaged record at {item['offset']} of {row['file']}")
                        entry |= {"payload": payload.decode("utf-8"), "payload_bytes": len(payload)}
                    out.append({**_EMPTY, **entry})
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW_RECORD)

    # A range is a row of a few bytes that stands for many: tasks are dealt by what they read, and in a number that stays.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    ranges = byte_ranges(index, gap, read).select("file", "start", "stop", "records")
    return ranges.repartition(tasks, "file", "start").mapInArrow(run, _RECORD)


_EMPTY = {"payload": None, "payload_bytes": None}
_ARROW_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def with_payloads(records: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the payload (such as payload, payload_bytes) of each revisit taken from the record it refers to."""
    records = stage(records, "warc-records")
    sources = records.where("record_type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("refers_to")).agg(*[F.min(c).alias(f"full_{c}") for c in columns])
    joined = records.join(sources, "refers_to", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"full_{c}")) for c in columns}
    return joined.withColumns(filled).drop(*[f"full_{c}" for c in columns])
