"""Requests for products, documents, pages and evidence over a pinned snapshot.

The snapshot's tables are revisions (lineage, revision, temporal_status, effective_date, issuer, product_code, name, launch_date, document_id, pdf_sha256,
pdf_size_bytes, page_count), pages (revision, page, text, text_sha256), evidence (evidence_id, ...), issuers (issuer, display_name, sort_order), and
unsupported and failed (issuer, product_code).  All answers are DataFrames; what is not there gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import catalog
from quillon.sources.snapshot import Snapshot, object_path


def issuers(snap: Snapshot) -> DataFrame:
    """Issuers in their order."""
    return snap["issuers"].orderBy("sort_order", "issuer")


def products(snap: Snapshot) -> DataFrame:
    """(issuer, product_code, status): every product once, with its availability."""
    current = snap["revisions"].where("temporal_status = 'current'")
    return catalog.availability(current, snap["unsupported"], snap["failed"])


def product(snap: Snapshot, issuer: str, code: str) -> DataFrame:
    """The product's availability and, if it is available, its current revision."""
    mine = lambda df: df.where((F.col("issuer") == catalog.issuer_code(issuer)) & (F.col("product_code") == code))
    told = mine(products(snap))
    current = mine(snap["revisions"].where("temporal_status = 'current'")).drop("issuer", "product_code")
    return told.join(current, F.col("status") == "available", "left")  # at most one row each: several current revisions leave the status null


def document(snap: Snapshot, document_id: str) -> DataFrame:
    """A document with the place of its PDF among content-addressed objects."""
    place = F.concat(F.lit("sha256/"), F.substring("pdf_sha256", 1, 2), F.lit("/"), F.col("pdf_sha256"))
    return snap["revisions"].where(F.col("document_id") == document_id).withColumn("pdf_path", place)


def pdf_path(snap: Snapshot, document_id: str) -> str:
    """The object path of a document's PDF; an unknown document raises."""
    found = snap["revisions"].where(F.col("document_id") == document_id).select("pdf_sha256").first()
    if found is None:
        raise ValueError("document not found")
    return object_path(found.pdf_sha256)


def page(snap: Snapshot, document_id: str, number: int) -> DataFrame:
    """The text of one page, counted from 1."""
    if number < 1:
        raise ValueError("pages count from 1")
    keys = snap["revisions"].where(F.col("document_id") == document_id).select("revision", "document_id")
    return snap["pages"].where(F.col("page") == number).join(F.broadcast(keys), "revision").select("document_id", "page", "text", "text_sha256")  # one document's revisions


def evidence(snap: Snapshot, evidence_id: str) -> DataFrame:
    return snap["evidence"].where(F.col("evidence_id") == evidence_id)


@dataclass(frozen=True)
class FindProducts:
    """One request in three modes: search (a part of a name), catalog (all) or coverage (counts of issuers)."""

    mode: str = "search"
    keyword: str | None = None
    issuer: str | None = None
    issuers: tuple[str, ...] | None = None
    sort: str = "name"
    limit: int | None = None
    cursor: str | None = None
    generation: str | None = None

    def __post_init__(self):
        if self.mode not in ("search", "catalog", "coverage"):
            raise ValueError("mode must be search, catalog or coverage")
        if self.mode == "coverage" and (self.keyword is not None or self.cursor is not None or self.limit is not None):
            raise ValueError("coverage takes no keyword, limit or cursor")
        if self.mode == "search" and not (self.keyword or "").strip():
            raise ValueError("a search needs a keyword")
        if self.mode == "catalog" and self.keyword is not None:
            raise ValueError("a catalog takes no keyword")
        if self.sort not in ("name", "launch_date"):
            raise ValueError("sort must be name or launch_date")
        if self.limit is not None:
            catalog.check_limit(self.limit)
        self.scope()

    def scope(self) -> list[str] | None:
        return catalog.scope(self.issuer, list(self.issuers) if self.issuers is not None else None)

    def binding(self) -> dict:
        return {"mode": self.mode, "keyword": " ".join((self.keyword or "").split()).casefold(), "scope": self.scope(), "sort": self.sort, "limit": self.limit}


def find_products(snap: Snapshot, request: FindProducts, cursors: catalog.Cursor, default: int = 20) -> dict:
    """search and catalog: items (with their rank), total and next_cursor; coverage: counts by issuer."""
    snap.require(request.generation)
    scope = request.scope()
    inside = lambda df: catalog.equals(df, issuer=scope)
    current = inside(snap["revisions"].where("temporal_status = 'current'"))
    if request.mode == "coverage":
        return {"coverage": catalog.coverage(inside(snap["issuers"]), current, inside(snap["unsupported"]), inside(snap["failed"]))}
    rows = current if request.mode == "catalog" else current.where(X.normalised_contains(F.col("name"), request.keyword))
    at = cursors.read(request.cursor, request.binding(), snap.generation) if request.cursor else 0
    size = request.limit or default
    order = [F.desc_nulls_last("launch_date"), "issuer", "product_code", "lineage", "revision"] if request.sort == "launch_date" else ["issuer", X.nfkc_casefold("name"), "product_code", "lineage", "revision"]
    page_ = rows.orderBy(*order).offset(at).limit(size)
    total = rows.count()
    after = at + size
    items = page_.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + at)  # at most 100 rows
    return {"items": items, "total": total, "next_cursor": cursors.make(request.binding(), snap.generation, after) if after < total else None}
