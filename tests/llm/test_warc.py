import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from msgflow.llm import warc
from msgflow.staging import new_path

ROWS = [(5, "http://a.example/1", "<p>é copy</p>"), (2, "http://a.example/2", "<p>é copy</p>"), (2, "http://a.example/2", "<p>é copy</p>"),
        (9, None, ""), (4, "", None), (7, "http://b.example/x\r\ny", "a\r\n\r\nb\r\n\r\n"), (None, "u", "WARC/1.1\r\n\r\n"),
        (1, "http://c.example", "long " * 50_000)]


def written(spark, rows, files=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    path = new_path(spark, "warc-test")
    warc.write_archives(df.repartition(files), path)
    return path


def test_round_trip(spark):
    path = written(spark, ROWS)
    index = warc.index_archives(spark, path)
    records = warc.with_payloads(warc.read_records(index), ["payload", "payload_bytes"]).collect()
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in ROWS:
        data = (h or "").encode()
        refers = first[h or ""] if i is not None and first[h or ""] != i else None
        want.append((i, u.replace("\r\n", "%0D%0A") if u is not None else None, h or "", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if refers is not None else "response", refers))
    got = [(r.page_id, r.url, r.payload, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_members_are_where_the_index_says(spark):
    path = written(spark, ROWS, 1)
    for row in warc.index_archives(spark, path).collect():
        with open(row.file.replace("file:", ""), "rb") as file:
            file.seek(row.offset)
            text = gzip.decompress(file.read(row.length)).decode()
        assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\n") and f"WARC-Type: {row.record_type}\r\n" in text


def test_a_selection_reads_few_ranges(spark):
    rows = [(i, f"http://a.example/{i}", hashlib.md5(str(i).encode()).hexdigest() * 40) for i in range(300)]
    index = warc.index_archives(spark, written(spark, rows, 1))
    wanted = index.where((F.col("page_id") < 10) | (F.col("page_id") > 290))
    assert {r.page_id for r in warc.read_records(wanted).collect()} == {*range(10), *range(291, 300)}
    assert warc.byte_ranges(index, gap=0, read=1 << 30).count() <= index.select("file").distinct().count() * 300
    assert warc.byte_ranges(index).count() == index.select("file").distinct().count()
    assert warc.byte_ranges(index, read=4096).count() > 10


def test_no_pages(spark):
    index = warc.index_archives(spark, written(spark, []))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def test_reads_are_spread_over_tasks(spark):
    """A few ranges, each a short row: without a number of their own tasks Spark would read all of them in one."""
    rows = [(i, f"http://h.example/{i}", f"page {i} " * 3000) for i in range(200)]
    path = written(spark, rows, files=8)
    records = warc.read_records(warc.index_archives(spark, path), read=4096).withColumn("task", F.spark_partition_id())
    assert records.select("task").distinct().count() > 1 and records.count() == 200
