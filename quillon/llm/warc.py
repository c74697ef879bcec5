r"""WARC archives with revisit resolution.

Writing: only headers (page id, payload size, SHA-1 digest in bare upper-case base32) are shuffled by payload digest; the smallest page id
of each digest keeps its payload as a ``response``, every other page becomes a ``revisit`` record that names the response.  Which pages
are revisits comes back by (page id, digest), so payloads are dealt evenly and no digest gathers them; headers of a
digest that very many pages share are dealt by page instead (``with_hot_keys``).  Records are written as
WARC/1.1 text archives (records end in CRLF CRLF) by Spark's own writer, so any
storage that Spark can write works; an archive holds at most ``RECORDS`` records.

Reading: gzipped archives, which are never split, come line by line through Spark's text reader, and records are cut from the stream by
Content-Length: one record is held at a time, however long the archive.  Archives without compression come whole, up to Spark's 2 GB a value.
Sizes and digests of payloads are computed from the bytes that were read; a stated digest that differs is an error.
``resolve_revisits`` takes the records of any archives: later responses of a payload already stored become revisits, all revisits
name the first response of their digest, and ``write_archives`` writes the result with fresh headers.  Records of other types (warcinfo,
request, metadata) are read over.

Defined cases: null html is an empty payload (its digest is that of no bytes, and
equal empty payloads revisit the first like any others); null url writes an empty target; rows
with a null page id never become the response of others unless all ids of that digest are null (then each is a response); repeated page ids stay
separate rows, all but none of them revisits of a smaller id (equal ids with one payload are all responses); text ids compare as text; payloads
up to what one value of a row holds; an empty table gives no rows; other columns and their names do not matter.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import picked, shared_path, table, with_hot_keys, written

RECORDS = 500
_BASE32_FROM = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Bare base32 SHA-1 of a binary column: twenty bits, five hex digits, give four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0"), _BASE32_FROM, _BASE32_TO) for k in range(1, 41, 5)]
    return F.concat(*parts)


def first_of(headers: DataFrame) -> DataFrame:
    """(payload_digest, n, first_id): how many of the headers (page_id, payload_digest, ...) share a digest, and their least page id."""
    return headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))


def records_of(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of (page_id, url, html) rows."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html.cast("binary")).alias("payload_digest")
    )
    headers = written(rows.where(F.col("payload_bytes") >= min_payload).select("page_id", "payload_digest"), "warc-headers")
    shared = written(first_of(headers).where("n > 1"), "warc-shared")
    again = F.coalesce(F.col("first_id") < F.col("page_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    told = with_hot_keys(headers, shared, "payload_digest", ["first_id"], ["page_id"]).where(again).select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("first_id").alias("refers_to")).distinct()
    joined = rows.join(told, rows.page_id.eqNullSafe(told["__id"]) & (rows.payload_digest == told["__digest"]), "left")
    revisit = F.col("__digest").isNotNull()
    return joined.select("page_id", "url", F.when(revisit, "").otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to")


def _record_text(c) -> object:
    """A whole record but for the last line end, which the writer adds."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), line("Content-Length", c("payload_bytes").cast("string")), F.lit("\r\n\r\n"), c("payload"))
    clean = F.regexp_replace(c("url"), r"[\r\n]", " ")
    revisit = c("record_type") == "revisit"
    page = F.coalesce(c("page_id").cast("string"), F.lit("null"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), c("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), c("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """Write records (columns of ``records_of``) as gzipped WARC archives below ``path``."""
    text = records.select(_record_text(F.col).alias("value"))
    text.write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Reader:
    """Cuts records from lines as they come; holds one record."""

    def __init__(self):
        self.headers, self.held, self.size, self.need = None, [], 0, 0

    def feed(self, line: bytes):
        """Takes a line without its line feed; gives the (headers, block) that it ends, or None."""
        if self.need:  # within a block, or in the line ends that follow it
            self.held.append(line)
            self.size += len(line) + 1
            if self.size < self.need:
                return None
            data, n = b"\n".join(self.held) + b"\n", self.need - 4
            if self.size > self.need or data[n:] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            got = (self.headers, data[:n])
            self.headers, self.held, self.size, self.need = None, [], 0, 0
            return got
        line = line.removesuffix(b"\r")
        if self.headers is None:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {line[:40]!r}")
            self.headers = {}
        elif line:
            name, _, value = line.partition(b":")
            self.headers[name.strip().lower()] = value.strip()
        else:
            self.need = int(self.headers[b"content-length"]) + 4
        return None

    def end(self) -> None:
        if self.headers is not None:
            raise ValueError("the last record is cut short")


def parse_archive(data: bytes):
    """Yield (headers, block) of each record; headers lower-cased."""
    reader = Reader()
    for line in data.removesuffix(b"\n").split(b"\n") if data else ():
        if (got := reader.feed(line)) is not None:
            yield got
    reader.end()


RECORD_SCHEMA = "page_id string, url string, record_type string, payload_digest string, refers_to string, payload string, payload_bytes long"
_FIELDS = ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "payload_bytes")
BATCH_BYTES = 8 << 20


def _inner(value: bytes | None) -> str | None:
    return None if value is None else value.decode().removeprefix("<urn:page:").removesuffix(">")


def _record(headers: dict, block: bytes, payloads: bool):
    """A row of RECORD_SCHEMA from a response or revisit, else None; what it says of a payload is computed from its bytes."""
    kind = headers.get(b"warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    stated = headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
    size = None
    if kind == "response":
        size, digest = len(payload), digest_of(payload)
        if stated not in (None, digest):
            raise ValueError(f"payload of {headers.get(b'warc-record-id')!r} is not the one of its digest")
        stated = digest
    return (_inner(headers.get(b"warc-record-id")), headers.get(b"warc-target-uri", b"").decode(), kind, stated, _inner(headers.get(b"warc-refers-to")), payload.decode() if payloads else None, size)


def _rows(found, payloads: bool):
    """Record batches of bounded size from (headers, block) pairs."""
    rows, size = [], 0

    def batch():
        cols = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:-1]), pa.array(cols[-1], pa.int64())], names=list(_FIELDS))

    for headers, block in found:
        if (row := _record(headers, block, payloads)) is not None:
            rows.append(row)
            size += 200 + len(block) * payloads
        if size > BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    yield batch()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The responses and revisits of all archives below ``path``; ``payload_bytes`` of a revisit, whose payload is elsewhere, is null."""

    def lines(batches):
        reader = Reader()
        for b in batches:
            for line in b.column("value"):
                if (got := reader.feed(line.as_py())) is not None:
                    yield got
        reader.end()  # a split holds whole archives

    def whole(batches):
        for b in batches:
            for content in b.column("content"):
                yield from parse_archive(content.as_py())

    packed = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content")
    got = packed.mapInArrow(lambda batches: _rows(lines(batches), payloads), RECORD_SCHEMA)
    return got.unionAll(plain.mapInArrow(lambda batches: _rows(whole(batches), payloads), RECORD_SCHEMA))


def resolve_revisits(records: DataFrame, min_payload: int = 0) -> DataFrame:
    """Records with one response for each digest of at least ``min_payload`` bytes: ``refers_to`` of all others is its page id, ``payload_bytes`` its size.

    The response of least page id (numbers by value) stays, other responses of the digest become revisits of it without payload; a
    revisit of a digest that no record stores keeps what it says.  The columns are those of ``records``, fit for ``write_archives``.
    """
    responses = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_payload))
    order = F.struct(F.expr("try_cast(page_id AS BIGINT)").isNull().alias("text"), F.expr("try_cast(page_id AS BIGINT)").alias("id"), F.col("page_id"))
    kept = responses.groupBy("payload_digest").agg(F.min(F.struct(order.alias("order"), F.col("payload_bytes").alias("size"))).alias("first"))
    counts = records.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    stored = written(kept.join(counts, "payload_digest").select("payload_digest", "n", F.col("first.order.page_id").alias("first_id"), F.col("first.size").alias("first_bytes"), F.lit(True).alias("stored")), "warc-stored")
    found = with_hot_keys(records, stored, "payload_digest", ["first_id", "first_bytes", "stored"], ["page_id", "url"])
    moved = F.coalesce("stored", F.lit(False)) & F.coalesce(F.col("payload_bytes") >= min_payload, F.lit(True)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id", "url", F.when(moved, "revisit").otherwise(F.col("record_type")).alias("record_type"), "payload_digest",
        F.when(moved, F.col("first_id")).otherwise(F.col("refers_to")).alias("refers_to"), F.when(moved, "").otherwise(F.col("payload")).alias("payload"),
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(records_of(table(spark, sf_dir, "pages")), path)
    got = resolve_revisits(written(read_archives(spark, path, payloads=False).drop("payload"), "warc-read").withColumn("payload", F.lit("")))
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return got.select(number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
