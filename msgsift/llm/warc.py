"""WARC archives: written as records, indexed first, read back by coalesced byte ranges.

Writing: a record is one string (headers, HTTP head, payload) and the text
sink's line separator is the blank lines that end a record, so Spark's commit
protocol covers the archives and a retried task leaves no torn file. Of pages
with equal payloads of at least ``MIN_REVISIT`` bytes the smallest id is the
response, the others are revisit records without payload.

Index: a pass over each archive reads the record heads only (it skips every
body by its Content-Length) and writes path, offset, length, url, digest,
page id, type per record as a table.

Reading: selected index rows are dealt by (archive, stretch of
``STRETCH`` bytes) and sorted by offset; neighbouring ranges are read in one
go of at most ``READ_BYTES``; digests and sizes are computed from the bytes read.

Defined cases
    null html: empty payload. null url: no target header. null id: never the response of a group that has ids;
    pages of a group of null ids only are all responses.
    rows that repeat the smallest id of a group: responses. line breaks in a url: percent-coded.
    very large pages: one record in memory at a time. empty table: no archive, empty index.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .common import flag_keys

MIN_REVISIT = 100
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10       # unselected bytes that are read over rather than sought past
STRETCH = 32 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = ("path string, offset bigint, length bigint, url string, digest string, page string, type string, "
         "refers string, full_bytes bigint")


def _digested(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(pages[html_col], F.lit(""))
    return pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"),
                        F.octet_length(html).cast("bigint").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"))


def _record(d: DataFrame) -> DataFrame:
    """One string per record, without the blank lines that end it; ``first_id`` is set for revisits."""
    def head(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("first_id").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    uid = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"), F.col("digest")))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return d.select(F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        head("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.substring(uid, 1, 8), F.lit("-"), F.substring(uid, 9, 4),
                                        F.lit("-"), F.substring(uid, 13, 4), F.lit("-"), F.substring(uid, 17, 4), F.lit("-"),
                                        F.substring(uid, 21, 12), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), head("WARC-Target-URI", clean),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        head("X-Page-ID", F.col("page_id").cast("string")), head("X-Refers-To-Page-ID", F.col("first_id").cast("string")),
        head("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        head("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        head("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   path: str | None = None) -> str:
    """Write one archive per task of the scan; returns the folder."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    d = _digested(pages, id_col, url_col, html_col)
    narrow = materialize(d.select("page_id", "n", "digest"), "warc-digests")
    first = (narrow.where(F.col("n") >= MIN_REVISIT).groupBy("digest", "n")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1 and first_id is not null").select(F.col("digest").alias("f_digest"), "first_id"))
    first = materialize(first, "warc-copies")
    # pages whose digest has no copies go straight to the archive; the others meet their first page without their html
    flagged = flag_keys(d, F.xxhash64("digest"), first, F.xxhash64("f_digest"))
    alone = flagged.where("not _in").withColumn("first_id", F.lit(None).cast(pages.schema[id_col].dataType))
    some = flagged.where("_in").drop("_in")
    named = some.join(first, F.col("digest") == F.col("f_digest"), "left").drop("f_digest").withColumn(
        "first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    (_record(alone.drop("_in")).unionByName(_record(named)).write.mode("overwrite")
     .option("lineSep", _END).option("compression", "none").text(path))
    return path


def _open(uri: str):
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(path)


def _parse(head: bytes) -> dict[bytes, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b": ")
        out[name.lower()] = value.decode("utf-8", "replace")
    return out


class _Heads:
    """Reads record heads of one archive in small steps, skipping bodies."""

    def __init__(self, f, size: int, step: int = 8 << 10):
        self.f, self.size, self.step = f, size, step

    def __iter__(self):
        at = 0
        while at < self.size:
            buf, n = b"", self.step
            while True:
                self.f.seek(at + len(buf))
                got = self.f.read(n)
                buf += got
                end = buf.find(b"\r\n\r\n")
                if end >= 0 or not got:
                    break
                n *= 2
            if end < 0 or not buf.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            h = _parse(buf[:end])
            length = end + 4 + int(h[b"content-length"]) + 4
            yield at, length, h
            at += length


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives in ``path``, written as a table."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")     # names and sizes only

    def run(batches):
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                with _open(p) as f:
                    for at, length, h in _Heads(f, n):
                        digest = h.get(b"warc-payload-digest", "").removeprefix("sha256:")
                        rows.append((p, at, length, h.get(b"warc-target-uri"), digest, h.get(b"x-page-id"), h[b"warc-type"],
                                     h.get(b"x-refers-to-page-id"), int(h.get(b"x-payload-length", 0))))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)
    n_files = files.count()
    return materialize(files.repartition(max(1, n_files), "path").mapInArrow(run, INDEX), "warc-index")


_INDEX_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                          ("digest", pa.string()), ("page", pa.string()), ("type", pa.string()), ("refers", pa.string()),
                          ("full_bytes", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _INDEX_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _INDEX_ARROW)], schema=_INDEX_ARROW)


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(start, end, number of ranges) of the reads that cover sorted (offset, length) ranges."""
    out: list[list[int]] = []
    for at, n in ranges:
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n)
            out[-1][2] += 1
        else:
            out.append([at, at + n, 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """page, type, refers, payload_bytes, payload_digest (and payload) of the selected index rows, from the archives' bytes.

    A revisit has no payload of its own: its size and digest are those its head states for the full payload.
    """
    schema = "page string, type string, refers string, payload_bytes bigint, payload_digest string"
    if with_payload:
        schema += ", payload binary"

    def records(b, f):
        offs, lens = b.column("offset").to_pylist(), b.column("length").to_pylist()
        k = 0
        for start, end, n in coalesce_ranges(list(zip(offs, lens))):
            f.seek(start)
            data = f.read(end - start)
            for at, length in zip(offs[k:k + n], lens[k:k + n]):
                rec = memoryview(data)[at - start:at - start + length]
                split = data.find(b"\r\n\r\n", at - start) - (at - start)
                h = _parse(bytes(rec[:split]))
                body = rec[split + 4:split + 4 + int(h[b"content-length"])]
                payload = body[len(_HTTP):]
                if h[b"warc-type"] == "revisit":
                    size, digest = int(h[b"x-payload-length"]), h[b"warc-payload-digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                row = (h.get(b"x-page-id"), h[b"warc-type"], h.get(b"x-refers-to-page-id"), size, digest)
                yield row + ((bytes(payload),) if with_payload else ())
            k += n

    def run(batches):
        f, open_path = None, None
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][:len(names)]
        for b in batches:
            paths = b.column("path").to_pylist()
            lo = 0
            rows: list[tuple] = []
            for i in range(1, len(paths) + 1):
                if i < len(paths) and paths[i] == paths[lo]:
                    continue
                if paths[lo] != open_path:
                    if f is not None:
                        f.close()
                    f, open_path = _open(paths[lo]), paths[lo]
                rows += records(b.slice(lo, i - lo), f)
                lo = i
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)
        if f is not None:
            f.close()
    picked = index.select("path", "offset", "length").withColumn("stretch", F.expr(f"offset div {STRETCH}"))
    return (picked.repartition("path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")
            .mapInArrow(run, schema))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages, index the archives, read all records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    index = build_index(spark, write_archives(pages, id_col, url_col, html_col))
    t = pages.schema[id_col].dataType
    return read_records(index).select(F.col("page").cast(t).alias("page_id"), "payload_bytes", "payload_digest",
                                      F.col("type").alias("record_type"), F.col("refers").cast(t).alias("refers_to"))
