"""Operator 2, WARC archives with an external index merge.

Pages become WARC 1.1 records (``response``, or ``revisit`` where a page with the
same payload and a larger id holds it) and are written by Spark's text writer,
whose line separator is the empty line that ends every record; so archives can
be on any file system Spark can write. Reading an archive gives one *run*: its
captures, sorted by URL key, time and page. Runs are kept as tables. A range of
keys is one task: it takes that range's slice of every run and merges the slices
with a loser tree, so that all tasks together hold the histories of all URLs in
global order, and a hot URL is spread over as many ranges as its captures need.

Defined results: null html is an empty payload; all empty payloads are equal. A
null url has the empty key and sorts first. A null ``page_id`` counts as smaller
than any other. Rows that repeat the largest ``page_id`` of a payload are all
responses. An empty table gives no archive and no rows. A column ``captured``
(timestamp) is the capture time if it is there, else the page's number in
seconds after 2020-01-01; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import new_folder

from .common import settle, small

EPOCH = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, archive string, offset long, length long"
)
ORDER = ("url_key", "captured", "page_id", "archive", "offset")


def base32_sha1(payload: F.Column) -> F.Column:
    """The bare upper-case base32 SHA-1: five hexadecimal digits are four letters."""
    h = F.sha1(payload)
    return F.concat(
        *(
            F.translate(
                F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0"),
                "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
            )
            for i in range(8)
        )
    )


def records(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per page with the record's type and its whole text."""
    one = F.lit("\r\n")
    p = with_payload(pages).join(
        small(payloads.where("n > 1").select("payload_digest", "payload_bytes", "response_id"), 80),
        ["payload_digest", "payload_bytes"],
        "left",
    )
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, one)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", name("page_id")),
        F.coalesce(field("WARC-Target-URI", uri), F.lit("")),
        field("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", name("response_id")))).otherwise(
            F.lit("")
        ),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        one,
        block,
    )
    return p.select(text.alias("value"))


def with_payload(pages: DataFrame) -> DataFrame:
    when = (
        F.col("captured").cast("timestamp")
        if "captured" in pages.columns
        else F.timestamp_seconds(EPOCH + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(50 * 365 * 86_400)))
    )
    p = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), when.alias("captured")
    )
    return p.withColumns(
        {"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")}
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> None:
    """Write ``pages`` as gzipped WARC files of about ``archive_bytes`` of text below ``folder``."""
    payloads = settle(
        with_payload(pages)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")),
        "payloads",
    )
    n, size = payloads.agg(F.sum("n"), F.sum(F.col("n") * (F.col("payload_bytes") + 600))).first()
    if not n:
        return
    (
        records(pages, payloads)
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, int(archive_bytes * n / size)))
        .text(folder)
    )


def url_key(url: str | None) -> str:
    """Sortable form of a URL: host reversed by label, scheme, ``www`` and fragment gone, parameters sorted."""
    if not url:
        return ""
    rest = url.strip().partition("://")[2] or url.strip()
    rest = rest.partition("#")[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].lower())
    host = re.sub(r":(80|443)$", "", host)
    path, mark, query = path.partition("?")
    return f"{','.join(reversed(host.split('.')))}){path or '/'}{mark}{'&'.join(sorted(query.split('&')))}"


def parse(content: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Offset, length, fields and block of every record of an archive."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines[1:])}
        end = head + 4 + int(fields[b"content-length"])
        yield at, end + 4 - at, fields, content[head + 4 : end]
        at = end + 4


def capture(archive: str, at: int, length: int, fields: dict[bytes, bytes], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"{archive}: payload at {at} does not match its digest")
    page = lambda k: None if (x := fields.get(k, b"none>")[:-1].rpartition(b":")[2]) in (b"none", b"") else int(x)
    url = fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None
    date = fields[b"warc-date"].decode()
    return (url_key(url), date, page(b"warc-record-id"), url, kind, size, digest, page(b"warc-refers-to"), archive, at, length)


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in schema.split(",")), strict=True)
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], list(names))


def runs(spark, folder: str) -> DataFrame:
    """The captures of every archive below ``folder``, each archive a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                archive = path.as_py().rpartition("/")[2]
                data = content.as_py()
                if archive.endswith(".gz"):
                    data = zlib.decompress(data, 31)
                rows = sorted((capture(archive, *r) for r in parse(data)), key=sort_key)
                for i in range(0, len(rows), 5000):
                    yield batch(rows[i : i + 5000], CAPTURE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(read, CAPTURE)


def merge(slices: list[list[tuple]]) -> Iterator[tuple]:
    """k sorted lists merged by a loser tree: one comparison per level and row.

    Node i holds the loser of the match between its two subtrees; leaf j is
    node k + j. A list that has ended loses against everything.
    """
    k = len(slices)
    keys = [[sort_key(r) for r in s] for s in slices]
    at = [0] * k

    def less(a: int, b: int) -> bool:
        if at[a] >= len(keys[a]):
            return False
        return at[b] >= len(keys[b]) or (keys[a][at[a]], a) < (keys[b][at[b]], b)

    best, loser = [0] * (2 * k), [0] * k
    for i in range(2 * k - 1, 0, -1):
        if i >= k:
            best[i] = i - k
        else:
            a, b = best[2 * i], best[2 * i + 1]
            best[i], loser[i] = (a, b) if less(a, b) else (b, a)
    winner = best[1] if k > 1 else 0
    while k and at[winner] < len(keys[winner]):
        yield slices[winner][at[winner]]
        at[winner] += 1
        i = (k + winner) // 2
        while i:
            if less(loser[i], winner):
                loser[i], winner = winner, loser[i]
            i //= 2


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: the slices of all runs, merged; ``position`` is the global order."""
    by_run: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by_run.setdefault(row[8], []).append(row)
    for rows in by_run.values():  # the shuffle need not keep a run's order
        rows.sort(key=sort_key)
    position = TaskContext.get().partitionId() << 40
    out: list[tuple] = []
    for row in merge([by_run[r] for r in sorted(by_run)]):
        out.append((*row, position))
        position += 1
        if len(out) == 5000:
            yield batch(out, f"{CAPTURE}, position long")
            out = []
    if out:
        yield batch(out, f"{CAPTURE}, position long")


def histories(found: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Settled runs merged into capture histories in global order.

    The rows a task merges are bounded: there are as many ranges as give each
    about ``range_rows``, and page and archive are part of the range key.
    """
    n = max(8, -(-found.count() // range_rows))
    return found.repartitionByRange(n, *ORDER).mapInArrow(merge_range, f"{CAPTURE}, position long")


def archive_pages(pages: DataFrame, folder: str | None = None, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pages`` as WARC files, read them back and merge their indexes."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, archive_bytes)
    try:
        found = settle(runs(spark, folder), "capture-runs")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{CAPTURE}, position long")
    return histories(found)
