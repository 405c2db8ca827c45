"""WARC archives: index first, then coalesced byte-range reads.

Every record's header is an expression, so its length is known before anything is written. The
index (archive, offset, length, url, digest of each record) is stored first: a running sum of
lengths within each archive, whose records are dealt by hash and sorted. The archives are then
written in the same order by Spark's text writer with the record separator CR LF CR LF, which is
what ends a WARC record; so the files are plain .warc content, and commits survive lost executors.
A reader takes selected index rows, sorts them by archive and offset, merges ranges that lie close
together, and reads each merged range once.

Of records with equal payloads of at least `min_revisit` bytes that with the largest page id is
the response and the others are revisits of it; revisits carry digest and length of their payload.

Defined results: a null html is an empty payload; a null url has no target line, and line breaks in
a url become blanks; rows that repeat id and payload are all responses if their id is the largest;
a null page id never is the response of a group that has an id, and if all ids of the group are
null, all its records are responses; an empty table writes no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, scratch_path, small, stored, width

ARCHIVE_BYTES, MIN_REVISIT = 64 << 20, 1000
ROUNDS = 3  # archives are written a third at a time, so that a third of the payloads is in shuffle files
GAP, READ = 1 << 20, 8 << 20  # ranges this close are read together, up to about this much at once
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # the tables have no date of capture
SORT = ("archive", "page_id", "digest", "url")


def _measured(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))


def _record_id(page_id: Column, digest: Column, kind: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest, kind).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))


def _header() -> Column:
    """Header and HTTP header of a record, from page_id, url, bytes, digest and refers_to."""
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))
    http = F.when(revisit, "").otherwise(_http(F.col("bytes")))
    target = F.regexp_replace("url", r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), kind)), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Page-ID", F.col("page_id")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("digest"), F.lit("response")))), line("X-Refers-To-Page", F.col("refers_to")),
        line("X-Payload-Length", F.when(revisit, F.col("bytes"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))), F.lit(END), http,
    )


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write an archive record per row of pages under path; returns the index."""
    narrow = stored(_measured(pages).drop("html"), "payloads")
    groups = narrow.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    groups = small(stored(groups, "payload-groups"))
    total = narrow.agg(F.sum("bytes"), F.count("*")).first()
    n = max(math.ceil(((total[0] or 0) + 1000 * total[1]) / archive_bytes), width(pages.sparkSession))

    def placed(df: DataFrame) -> DataFrame:
        refers = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(None)).otherwise(F.col("keeper"))
        return df.join(groups, "digest", "left").withColumn("refers_to", refers).withColumn("header", _header()).withColumn("archive", F.pmod(F.xxhash64("page_id", "digest"), F.lit(n)).cast("int"))

    length = F.octet_length("header") + F.when(F.col("refers_to").isNotNull(), 0).otherwise(F.col("bytes")) + len(END)
    before = Window.partitionBy("archive").orderBy(*SORT[1:], F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)
    sized = placed(narrow).withColumn("length", length.cast("long"))
    index = stored(sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("archive", "offset", "length", "page_id", "url", "digest"), "warc-index")
    value = F.concat("header", F.when(F.col("refers_to").isNotNull(), "").otherwise(F.col("html"))).alias("value")
    for turn in range(ROUNDS):
        rows = placed(_measured(pages)).where(F.col("archive") % ROUNDS == turn).repartition(max(1, n // ROUNDS), "archive").sortWithinPartitions(*SORT)
        rows.select("archive", value).write.mode("append").partitionBy("archive").option("lineSep", END).text(path)
        free(pages.sparkSession)
    return index


def located(index: DataFrame, path: str) -> DataFrame:
    """The index with the file of each archive."""
    spark = index.sparkSession
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.regexp_extract("path", r"archive=(\d+)/", 1).cast("int").alias("archive"))
    return index.join(small(files), "archive")


def parse(record: bytes) -> dict:
    """The named fields of a record's header, and its payload."""
    head, _, block = record.partition(END.encode())
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    return fields | {"payload": block.partition(END.encode())[2] if fields["WARC-Type"] == "response" else b""}


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, begin, end, first row, last row + 1) of merged ranges of sorted (file, offset, length)."""
    first = 0
    for i in range(1, len(rows) + 1):
        file, begin, _ = rows[first]
        end = rows[i - 1][1] + rows[i - 1][2]
        if i == len(rows) or rows[i][0] != file or rows[i][1] > end + gap or rows[i][1] + rows[i][2] - begin > most:
            yield file, begin, end, first, i
            first = i


def read(selected: DataFrame, html: bool = False) -> DataFrame:
    """The records of located index rows: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and html if wanted. Payloads of responses are digested anew."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        opened: tuple = (None, None)
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            for file, begin, end, i, j in ranges(rows):
                if opened[0] != file:
                    uri = "file://" + file.removeprefix("file:") if file.startswith("file:/") and not file.startswith("file://") else file
                    system, name = (pfs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else pfs.FileSystem.from_uri(uri)
                    opened = file, system.open_input_file(name)
                raw, out = opened[1].read_at(end - begin, begin), []
                for _, offset, length in rows[i:j]:
                    r = parse(raw[offset - begin : offset - begin + length])
                    stated, payload = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload"]
                    if r["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"the payload at {offset} of {file} does not match its digest")
                    number = lambda k: int(r[k]) if k in r else None
                    size = number("X-Payload-Length") if r["WARC-Type"] == "revisit" else len(payload)
                    out.append((number("X-Page-ID"), size, stated, r["WARC-Type"], number("X-Refers-To-Page"), *([payload.decode()] if html else [])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if html else [])]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    n = width(selected.sparkSession)
    return selected.repartition(n, "file").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives and read all records back."""
    path = scratch_path(pages.sparkSession, "warc")
    return read(located(write(pages, path), path))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, max(page_id) AS keeper FROM p WHERE b >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
