"""Products without a document, bound by hashes: their rows are checked against their source payload and each other, and their list against its seal.

A row that cannot be served as a text (protected, or failed in recognition) keeps what it came from as canonical JSON; its id is the hash of that JSON, and the hash of all rows in
canonical order is the seal of the list.  Checks return the rows that break a rule, with the rules they break.

Defined cases: null values break the rule of their field; repeated rows break ``repeated``; an empty list has a seal like any other.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import canonical_json

# Fields of a source payload, marks of protected files, bounds.
SOURCE_FIELDS = ("category", "document_type", "effective_date", "file_name", "issuer", "metadata", "product_code", "product_name", "source_post_id", "source_url", "source_version")
PROTECTED_MARKS = ("SCDSA002", "SCDSA004", "FASOO_DRMONE")
UNSUPPORTED = "unsupported_drm"
BOUND_FIELDS = {"issuer": "issuer", "product_code": "product_code", "name": "product_name", "source_version": "source_version", "source_url": "source_url"}
MOST_UNSUPPORTED, MOST_PAYLOAD = 100, 1 << 20


def _is_source(text: str | None) -> bool:
    """Whether a text is the canonical JSON of a source: exactly its fields, all strings but the metadata, an object."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    if text is None or len(text.encode()) > MOST_PAYLOAD:
        return False
    try:
        value = json.loads(text, object_pairs_hook=once)
        return isinstance(value, dict) and set(value) == set(SOURCE_FIELDS) and all(isinstance(v, dict if k == "metadata" else str) for k, v in value.items()) and canonical_json(value) == text
    except (ValueError, RecursionError):
        return False


@F.arrow_udf(T.BooleanType())
def is_source(values: pa.Array) -> pa.Array:
    return pa.array([_is_source(v) for v in values.to_pylist()], pa.bool_())


def _within(column: str, most: int) -> Column:
    return F.coalesce(F.length(column).between(1, most), F.lit(False))


def _like(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False))


def _broken(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key, reasons) of the rows that break a rule."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(*key, reasons.alias("reasons")).where(F.size("reasons") > 0)


def _known(rows: DataFrame, issuers: DataFrame, active: DataFrame, unique: list[list[str]]) -> DataFrame:
    """Adds whether a row's issuer is known, its product is none that is served, and its keys occur once."""
    rows = rows.join(issuers.select(F.col("issuer").alias("__i")).distinct(), F.col("issuer") == F.col("__i"), "left")
    served = active.select(F.col("issuer").alias("__a"), F.col("product_code").alias("__p")).distinct()
    rows = rows.join(served, (F.col("issuer") == F.col("__a")) & (F.col("product_code") == F.col("__p")), "left")
    once = F.lit(True)
    for k, columns in enumerate(unique):
        seen = rows.groupBy(*(F.col(c).alias(f"__k{k}{i}") for i, c in enumerate(columns))).agg(F.count(F.lit(1)).alias(f"__n{k}"))
        match = [F.col(c).eqNullSafe(F.col(f"__k{k}{i}")) for i, c in enumerate(columns)]
        for m in match[1:]:
            match[0] = match[0] & m
        rows = rows.join(seen, match[0], "left")
        once = once & (F.col(f"__n{k}") == 1)
    return rows.withColumns({"__issuer": F.col("__i").isNotNull(), "__free": F.col("__a").isNull(), "__once": once})


def wrong_unsupported(rows: DataFrame, issuers: DataFrame, active: DataFrame) -> DataFrame:
    """(issuer, product_code, reasons) of protected products that break a rule.

    ``rows``: issuer, product_code, name, disposition, source_id, source_version, source_url, protected_magic, protected_sha256, protected_size_bytes, source_payload_json.
    """
    checked = _known(rows.withColumn("__source", is_source(F.col("source_payload_json"))), issuers, active, [["issuer", "product_code"], ["source_id"]])
    bound = F.lit(True)
    for column, field in BOUND_FIELDS.items():
        bound = bound & (F.get_json_object("source_payload_json", f"$.{field}") == F.col(column))
    rules = {
        "issuer": F.col("__issuer"), "product_code": _within("product_code", 512), "name": _within("name", 1000), "disposition": F.col("disposition") == UNSUPPORTED,
        "source_id": _like("source_id", "source_[0-9a-f]{64}") & (F.col("source_id") == F.concat(F.lit("source_"), F.sha2("source_payload_json", 256))),
        "source_version": _within("source_version", 512), "source_url": _within("source_url", 4096) & F.startswith("source_url", F.lit("https://")),
        "protected_magic": F.col("protected_magic").isin(*PROTECTED_MARKS), "protected_sha256": _like("protected_sha256", "[0-9a-f]{64}"), "protected_size_bytes": F.col("protected_size_bytes") >= 1,
        "payload": F.col("__source"), "bound": bound, "active": F.col("__free"), "repeated": F.col("__once"),
    }
    return _broken(checked, rules, ["issuer", "product_code"])


def wrong_failed(rows: DataFrame, issuers: DataFrame, active: DataFrame, documents: DataFrame) -> DataFrame:
    """(issuer, product_code, reasons) of products whose recognition failed that break a rule.

    ``active`` has the products that are served or unsupported, ``documents`` (document_id) the documents that are served.
    ``rows``: issuer, product_code, name, document_id, title, pdf_sha256, pdf_size_bytes, page_count, reason_code, reason, attempts.
    """
    checked = _known(rows, issuers, active, [["issuer", "product_code"], ["document_id"]])
    checked = checked.join(documents.select(F.col("document_id").alias("__d")).distinct(), F.col("document_id") == F.col("__d"), "left")
    rules = {
        "issuer": F.col("__issuer"), "product_code": _within("product_code", 512), "name": _within("name", 1000), "document_id": _like("document_id", "doc_[0-9a-f]{64}"), "title": _within("title", 1000),
        "pdf_sha256": _like("pdf_sha256", "[0-9a-f]{64}"), "pdf_size_bytes": F.col("pdf_size_bytes") >= 1, "page_count": F.col("page_count") >= 1, "reason_code": _like("reason_code", "[a-z0-9_]{1,64}"),
        "reason": _within("reason", 256) & ~F.col("reason").rlike(r"[\n\r]"), "attempts": F.col("attempts") >= 1, "active": F.col("__free") & F.col("__d").isNull(), "repeated": F.col("__once"),
    }
    return _broken(checked, rules, ["issuer", "product_code"])


def _quoted(column: str) -> Column:
    text = F.to_json(F.array(F.col(column).cast("string")))
    return F.coalesce(F.substr(text, F.lit(2), F.length(text) - 2), F.lit("null"))


def _object(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields))), F.lit("}"))


def unsupported_payload() -> Column:
    """Canonical JSON of a protected product, its source payload within it as it is."""
    text = {c: _quoted(c) for c in ("disposition", "protected_magic", "protected_sha256", "source_id")}
    return _object({**text, "protected_size_bytes": F.col("protected_size_bytes").cast("string"), "source": F.col("source_payload_json")})


def failed_payload() -> Column:
    text = {c: _quoted(c) for c in ("document_id", "issuer", "pdf_sha256", "product_code", "reason", "reason_code", "title")}
    return _object({**text, "product_name": _quoted("name"), **{c: F.col(c).cast("string") for c in ("attempts", "page_count", "pdf_size_bytes")}})


def seal(rows: DataFrame, payload: Column, schema_version: str, order: list[str] | None = None) -> DataFrame:
    """(n, sha256) of a list: the hash of ``{"documents":[...],"schema_version":...}`` with the payloads in canonical order (or a table's own).

    A hash runs through all payloads in turn, so they pass one task, as a stream; nothing of the list is held.
    """

    def run(batches):
        digest, n = hashlib.sha256(b'{"documents":['), 0
        for b in batches:
            for text, real in zip(b.column("payload").to_pylist(), b.column("real").to_pylist(), strict=True):
                if not real:
                    continue
                digest.update((b"," if n else b"") + text.encode())
                n += 1
        digest.update(f'],"schema_version":{canonical_json(schema_version)}}}'.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["n", "sha256"])

    listed = rows.withColumn("payload", payload).select("payload", *(order or []), F.lit(True).alias("real"))
    listed = listed.unionByName(rows.sparkSession.range(1).select(F.lit("").alias("payload"), F.lit(False).alias("real")), allowMissingColumns=True)  # so that the task runs for an empty list
    return listed.repartition(1).sortWithinPartitions("real", *(order or ["payload"])).select("payload", "real").mapInArrow(run, "n long, sha256 string")


def wrong_seal(rows: DataFrame, payload: Column, schema_version: str, n: int, sha256: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(reason) of a list that is not the one stated; an early table order of ``order`` is taken as well."""
    found = seal(rows, payload, schema_version)
    if order:
        found = found.unionByName(seal(rows, payload, schema_version, order))  # two rows
    told = found.agg(F.max("n").alias("n"), F.max((F.col("sha256") == sha256).cast("int")).alias("hit"))
    reasons = [F.when(F.col("n") != n, "count"), F.when(F.col("hit") == 0, "hash")] + ([F.when(F.col("n") > most, "too many")] if most is not None else [])
    return told.select(F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
