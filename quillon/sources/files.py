"""Readers and writers of the engine's file formats: strict JSON lines, float32 matrices, page texts, listings."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.structure import PAGE_MARKER
from quillon.sources import ranges
from quillon.sources.snapshot import byte_range, object_path

MAX_LINE = 1 << 20
PIECE = 16 << 20  # bytes of an object in one row


def _strict(text: str, most: int, canonical: bool = False) -> str | None:
    """What is wrong with a line, or null."""

    def pairs(items):
        names = [k for k, _ in items]
        if len(names) != len(set(names)):
            raise ValueError("duplicate key")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no JSON number")

    if not text:
        return "blank line"
    if text.startswith("\ufeff"):
        return "byte order mark"
    if len(text.encode()) > most:
        return "line too long"
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
        if not isinstance(value, dict):
            return "no object"
        if canonical and json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) != text:
            return "no canonical JSON"
    except ValueError as error:
        return str(error)
    return None


def read_jsonl(spark: SparkSession, path: str, schema: str, most: int = MAX_LINE, canonical: bool = False) -> DataFrame:
    """Rows of strict JSON lines; what is not strict raises when read.

    That is: duplicate keys, NaN, lines that are blank, over-long, malformed or no objects, a byte order mark, a carriage return, with ``canonical`` lines that are not canonical
    JSON, and files whose last line does not end.  A file has as many bytes as its lines and their ends, which tells the last; only lengths are read for it.
    Files without a byte have no rows.
    """

    @F.arrow_udf(T.StringType())
    def fault(values: pa.Array) -> pa.Array:
        return pa.array([_strict(v, most, canonical) for v in values.to_pylist()], pa.string())

    lines = spark.read.option("lineSep", "\n").text(path)
    sizes = lines.select("_metadata.file_path", "_metadata.file_size", F.octet_length("value").alias("n")).groupBy("file_path", "file_size").agg(F.sum(F.col("n") + 1).alias("n"))
    open_end = sizes.agg(F.min(F.when(F.col("n") != F.col("file_size"), F.concat(F.lit("no line end at the end of "), F.col("file_path")))).alias("open"))
    checked = lines.crossJoin(F.broadcast(open_end)).withColumn("why", F.coalesce("open", fault(F.when(F.contains("value", F.lit("\r")), "\r").otherwise(F.col("value")))))  # one row
    checked = checked.withColumn("value", F.when(F.col("why").isNotNull(), F.raise_error(F.col("why")).cast("string")).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_f32(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, row_index, embedding) of row-major little-endian float32 matrices, each file numbered from 0; one scan of byte ranges over all of them."""
    return ranges.source(spark, ranges.Matrix, dim=dim).load(path)


def read_matrix(spark: SparkSession, path: str, dim: int, verify: bool = False) -> DataFrame:
    """(row_index, embedding) of a sealed matrix; sizes, and with ``verify`` the hash of each part, must be those of its seal."""
    seal = ranges.read_seal(path)
    if seal is None or seal["dim"] != dim:
        raise ValueError(f"{path} is no sealed matrix of width {dim}")
    return ranges.source(spark, ranges.Matrix, dim=dim, sealed=True, verify=verify).load(path).select("row_index", "embedding")


def encode_f32(matrix: DataFrame, rows_per_block: int = 4096) -> DataFrame:
    """(block, content, sha256): a matrix in row_index order as blocks of float32 bytes; the blocks in order are the file."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row_index")
        content = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    blocks = matrix.select("row_index", "embedding", F.floor(F.col("row_index") / rows_per_block).cast("long").alias("block"))
    return blocks.groupBy("block").applyInArrow(run, "block long, content binary").withColumn("sha256", F.sha2("content", 256))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_blob(values: pa.Array) -> pa.Array:
    """Vectors that older tables store as packed float32 bytes."""
    return pa.array([None if v is None else np.frombuffer(v, "<f4").tolist() for v in values.to_pylist()], pa.list_(pa.float32()))


def split_pages(texts: DataFrame) -> DataFrame:
    """(document, page, text) from (document, text, first, last) with page markers; pages must be exactly first..last, none empty."""
    marker = r"(?m)" + PAGE_MARKER.rstrip("$").replace(r"\s*", r"[ \t]*") + "$"
    numbers = F.transform(F.regexp_extract_all("text", F.lit(marker), F.lit(1)), lambda n: n.cast("int"))
    parts = F.slice(F.split("text", marker), 2, F.size(numbers))
    ok = (numbers == F.sequence("first", "last")) & F.forall(parts, lambda p: p.rlike(r"(?U)\S"))
    checked = texts.withColumn("pages", F.when(F.coalesce(ok, F.lit(False)), F.arrays_zip(numbers.alias("page"), parts.alias("text"))).otherwise(F.raise_error(F.concat(F.lit("pages of "), F.col("document").cast("string"), F.lit(" are not the expected run"))).cast("array<struct<page:int,text:string>>")))
    return checked.select("document", F.explode("pages").alias("p")).select("document", "p.page", F.regexp_replace("p.text", r"^\n|\n$", "").alias("text"))


class _Listing(HTMLParser):
    def __init__(self):
        super().__init__()
        self.head, self.items, self.links, self.tag, self.buffer = [], [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "li"):
            self.tag, self.buffer = tag, []
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag == self.tag:
            text = " ".join("".join(self.buffer).split())
            (self.head if tag == "h1" else self.items).append(text)
            self.tag = None

    def handle_data(self, data):
        if self.tag:
            self.buffer.append(data)


def read_listing(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", reference: str = r"#?\w+") -> DataFrame:
    """(id, title, entries, links) of listing pages; a page without a heading raises, as its layout has changed.

    Character references are names that match ``reference`` and end in a semicolon; any other & is text, as titles may be cut within one.
    """
    import re

    kind, text = dict(pages.dtypes)[id_col], re.compile(f"&(?!(?:{reference});)")

    def run(batches):
        for b in batches:
            out = []
            for html in b.column("html").to_pylist():
                p = _Listing()
                p.feed(text.sub("&amp;", html or ""))
                p.close()  # what a page's end leaves open is text too
                if html and not p.head:
                    raise ValueError("listing without a heading")
                out.append((p.head[0] if p.head else None, p.items, p.links))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["id", "title", "entries", "links"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, title string, entries array<string>, links array<string>")


class ListingRules:
    """How an issuer's listing is laid out, for ``read_rows``: patterns with one group each, searched in a row of its table.

    ``link`` picks the file link among a row's hrefs, ``code`` the product code in an onclick or href, ``day`` the date (eight digits) in the link;
    ``name_cell`` is the cell of the name; ``headers``, if given, must be the table's header cells, or the layout has changed.
    """

    def __init__(self, link: str, code: str, day: str, name_cell: int = 0, headers: tuple[str, ...] | None = None, base: str = ""):
        self.link, self.code, self.day, self.name_cell, self.headers, self.base = link, code, day, name_cell, headers, base


class _Rows(HTMLParser):
    """Rows of a page's tables: texts of their cells, the header cells, and the targets of their elements."""

    def __init__(self):
        super().__init__()
        self.rows, self.headers, self.buffer = [], [], None

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag == "tr":
            self.rows.append(([], []))
        elif tag in ("td", "th"):
            self.buffer = []
        if self.rows:
            self.rows[-1][1].extend(v for k in ("onclick", "href") if (v := held.get(k)))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.buffer is not None:
            text = " ".join("".join(self.buffer).split())
            (self.headers if tag == "th" else self.rows[-1][0] if self.rows else []).append(text)
            self.buffer = None

    def handle_data(self, data):
        if self.buffer is not None:
            self.buffer.append(data)


def read_rows(pages: DataFrame, rules: ListingRules, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, product_code, product_name, effective_date, source_url, file_name) of the rows of HTML listings.

    Rows without a file link and a code are no products.  Other headers than the rules', a file without a date, and two products of one page with
    one code and file raise: the layout has changed.
    """
    import re

    kind = dict(pages.dtypes)[id_col]
    link, code, day = (re.compile(p) for p in (rules.link, rules.code, rules.day))
    names = ["id", "product_code", "product_name", "day", "source_url", "file_name"]

    def run(batches):
        for b in batches:
            out = []
            for i, html in zip(b.column("id"), b.column("html").to_pylist(), strict=True):
                page, seen = _Rows(), set()
                page.feed(html or "")
                if html and rules.headers is not None and tuple(page.headers) != rules.headers:
                    raise ValueError(f"listing headers are {page.headers}, not {list(rules.headers)}")
                for cells, targets in page.rows:
                    file = next((m[1] for t in targets if (m := link.search(t))), None)
                    product = next((m[1].strip() for t in targets if (m := code.search(t))), None)
                    if file is None or not product or len(cells) <= rules.name_cell:
                        continue
                    date = day.search(file)
                    if date is None:
                        raise ValueError(f"no date in {file}")
                    if (product, file) in seen:
                        raise ValueError(f"product {product} is listed twice")
                    seen.add((product, file))
                    out.append((i.as_py(), product, cells[rules.name_cell], date[1], rules.base + file, file.rsplit("/", 1)[-1]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("id").type), *(pa.array(c, pa.string()) for c in cols[1:])], names=names)

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, product_code string, product_name string, day string, source_url string, file_name string")
    return rows.select("id", "product_code", "product_name", F.to_date("day", "yyyyMMdd").alias("effective_date"), "source_url", "file_name")


def read_json_pages(pages: DataFrame, rows_path: str, fields: dict[str, str], count_path: str | None = None, more_path: str | None = None, success: tuple[str, str] | None = None, skip: dict[str, str] | None = None) -> DataFrame:
    """(source, page, position, fields...) of the records in paged JSON listings (source, page, body); paths are JSON paths.

    Raises where the layout has changed: no success mark, no array of records, another count than stated, a last page that promises more, an earlier one that
    does not, or a record without a field.  ``skip`` names field values that mark placeholder records.
    """
    from pyspark.sql import Window

    body = F.try_parse_json("body")
    got = lambda path, kind="string": F.try_variant_get(F.col("v"), path, kind)
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col("source").cast("string"), F.lit(" page "), F.col("page").cast("string")))
    rows = pages.select("source", "page", body.alias("v")).withColumn("list", got(rows_path, "array<variant>"))
    last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("page"))) == 1
    faults = [(F.col("list").isNull(), "no records")]
    if success:
        faults.append((~F.coalesce(got(success[0]) == success[1], F.lit(False)), "no success"))
    if count_path:
        faults.append((~F.coalesce(got(count_path, "int") == F.size("list"), F.lit(False)), "another count than stated"))
    if more_path:
        more = F.coalesce(F.lower(got(more_path)).isin("true", "y", "1"), F.lit(False))
        faults += [(last & more, "a page is missing after"), (~last & ~more, "a page beyond the end after")]
    records = F.col("list")  # the check is part of the value, so no filter can go before it
    for bad, text in reversed(faults):
        records = F.when(bad, fail(text).cast("array<variant>")).otherwise(records)
    each = rows.select("source", "page", records.alias("list")).select("source", "page", F.posexplode("list").alias("position", "r"))
    read = {name: F.trim(F.try_variant_get(F.col("r"), path, "string")) for name, path in fields.items()}
    values = each.select("source", "page", "position", *(c.alias(n) for n, c in read.items()))
    for name, value in (skip or {}).items():
        values = values.where(~F.col(name).eqNullSafe(F.lit(value)))
    need = lambda n: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)).otherwise(fail(f"no {n}").cast("string")).alias(n)
    return values.select("source", "page", "position", *(need(n) for n in fields))


def read_json_listing(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column by path; malformed rows give nulls."""
    return rows.select("*", *[F.get_json_object(column, path).alias(name) for name, path in fields.items()]).drop(column)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path, of any size: each is hashed as a stream by one task, small ones share a task."""
    return ranges.source(spark, ranges.FileDigests).load(path)


def read_range(spark: SparkSession, root: str, digest: str, header: str | None = None, piece: int = PIECE) -> DataFrame:
    """(digest, size, start, end, offset, content) of a content-addressed object: all its bytes, or the single range that a header asks for.

    Only that range is read, by as many tasks as it has parts; a row holds at most ``piece`` bytes from ``offset`` on, so objects may have any size.
    """
    path = f"{root.rstrip('/')}/{object_path(digest)}"
    ((_, size),) = ranges.listed(path)
    start, end = (0, size - 1) if header is None else byte_range(header, size)
    told = [F.lit(digest).alias("digest"), F.lit(size).cast("long").alias("size"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end")]
    if size == 0:
        return spark.range(1).select(*told, F.lit(0).cast("long").alias("offset"), F.lit(b"").alias("content"))
    got = ranges.source(spark, ranges.ByteRanges, width=piece, start=start, stop=end + 1).load(path)
    return got.select(*told, "offset", "content")


def read_score_matrix(spark: SparkSession, path: str, inventory: DataFrame, n_rows: int) -> DataFrame:
    """(query_id, row_index, score) from query-major float32 files and their inventory (query_id, file, offset, sha256).

    A file is segments of ``n_rows`` scores, one a query; ``offset`` is in bytes.  Each segment is read once and meets its own query; one that is
    missing, cut short or of another hash raises.
    """
    width = 4 * n_rows

    def run(batches):
        import hashlib

        for b in batches:
            for q, digest, content in zip(*(b.column(c) for c in ("query_id", "sha256", "content")), strict=True):
                raw = content.as_py() or b""
                if len(raw) != width or hashlib.sha256(raw).hexdigest() != digest.as_py():
                    raise ValueError(f"scores of query {q.as_py()} do not match their inventory")
                x = np.frombuffer(raw, "<f4").astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([q.as_py()] * n_rows, pa.int64()), pa.array(np.arange(n_rows, dtype=np.int64)), pa.array(x)], names=["query_id", "row_index", "score"])

    for name, size in ranges.listed(path):
        if size % width:
            raise ValueError(f"{name} does not match its inventory: it is no whole number of segments")
    segments = ranges.source(spark, ranges.ByteRanges, width=width).load(path).withColumn("file", F.element_at(F.split("file", "/"), -1))
    rows = inventory.select(F.col("query_id").cast("long").alias("query_id"), "file", F.col("offset").cast("long").alias("offset"), "sha256").join(segments, ["file", "offset"], "left")
    return rows.select("query_id", "sha256", "content").mapInArrow(run, "query_id long, row_index long, score double")


def put_once(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Content-addressed rows (digest, content) with new ones added; content of another digest raises."""
    checked = fresh.withColumn("digest", F.when(F.sha2("content", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("content does not match its digest")).cast("string")))
    return held.unionByName(checked.dropDuplicates(["digest"]).join(held.select("digest"), "digest", "left_anti"))


@F.arrow_udf(T.BinaryType())
def pack_blob(values: pa.Array) -> pa.Array:
    """Vectors as unit-length packed float32 bytes, as older tables store them; null where there is no direction."""
    out = []
    for v in values.to_pylist():
        x = np.array(v if v is not None else [], np.float64)
        n = float(np.sqrt(x @ x)) if len(x) else 0.0
        out.append((x / n).astype("<f4").tobytes() if n > 1e-12 else None)
    return pa.array(out, pa.binary())
