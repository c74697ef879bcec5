"""Catalogue queries: scopes, sorting, paging, coverage, merchants, name resolution and summaries."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.holding import held

ISSUERS = ("bc", "hana", "hyundai", "kb", "lotte", "samsung", "shinhan", "woori")
# Spellings of each issuer, separators removed and case folded.
ALIASES = {
    "bc": ("bc", "bccard", "bc카드", "비씨", "비씨카드"),
    "hana": ("hana", "hanacard", "하나", "하나카드"),
    "hyundai": ("hyundai", "hyundaicard", "현대", "현대카드"),
    "kb": ("kb", "kbcard", "kbkookmin", "kbkookmincard", "kb국민", "kb국민카드", "kookmin", "kookmincard", "국민", "국민카드"),
    "lotte": ("lotte", "lottecard", "롯데", "롯데카드"),
    "samsung": ("samsung", "samsungcard", "삼성", "삼성카드"),
    "shinhan": ("shinhan", "shinhancard", "신한", "신한카드"),
    "woori": ("woori", "wooricard", "우리", "우리카드"),
}
_BY_NAME = {name: code for code, names in ALIASES.items() for name in names}


def issuer_code(value: str) -> str:
    """Canonical code of a spelling; unknown ones raise."""
    folded = re.sub(r"[\s._-]+", "", unicodedata.normalize("NFKC", value).strip().casefold())
    if folded not in _BY_NAME:
        raise ValueError(f"unknown issuer {value!r}: use one of {', '.join(ISSUERS)}")
    return _BY_NAME[folded]


def issuer_codes(names: DataFrame, column: str) -> DataFrame:
    """The rows with an ``issuer`` column; unknown spellings raise when the row is read."""
    folded = F.regexp_replace(X.nfkc_casefold(F.col(column)), r"(?U)[\s._-]+", "")
    known = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    return names.withColumn("__folded", folded).withColumn("issuer", F.coalesce(known[F.col("__folded")], F.raise_error(F.concat(F.lit("unknown issuer "), F.col(column))).cast("string"))).drop("__folded")


def scope(issuer: str | None = None, issuers: list[str] | None = None) -> list[str] | None:
    """The issuers of a request: one or a list of 1 to 8, canonical, sorted and distinct; not both."""
    if issuer is not None and issuers is not None:
        raise ValueError("give issuer or issuers, not both")
    if issuers is not None and not 1 <= len(issuers) <= 8:
        raise ValueError("issuers must name 1 to 8")
    names = [issuer] if issuer is not None else issuers
    return None if names is None else sorted({issuer_code(n) for n in names})


def equals(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters joined by AND; None asks nothing, a list asks membership."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(name).isin(*value))
        elif value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def check_limit(limit: int, most: int = 100) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


def by_name(products: DataFrame) -> list:
    return ["issuer", F.lower("name"), "product_code", "lineage", "revision"]


def sorted_catalog(products: DataFrame, sort: str = "name") -> DataFrame:
    """By issuer and name, or by launch date from new to old with unknown dates last."""
    if sort == "name":
        return products.orderBy(*by_name(products))
    if sort == "launch_date":
        return products.orderBy(F.desc_nulls_last("launch_date"), "issuer", "product_code", "lineage", "revision")
    raise ValueError(f"unknown sort {sort}")


def page(ordered: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a totally ordered result; ask for limit + 1 to learn whether more follow."""
    return ordered.offset(offset).limit(limit)


def after(rows: DataFrame, keys: list[str], anchor: list, limit: int) -> DataFrame:
    """Keyset page: the rows at or after the anchor in key order."""
    here = F.struct(*[F.col(k) for k in keys]) >= F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, anchor, strict=True)])
    return rows.where(here).orderBy(*keys).limit(limit)


class Cursor:
    """Signed page cursor bound to a query and a generation; a stale or forged one raises."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def _sign(self, body: bytes) -> str:
        return hmac.new(self.secret, body, hashlib.sha256).hexdigest()

    def make(self, binding: dict, generation: str, offset: int) -> str:
        bound = hashlib.sha256(X.canonical_json(binding).encode()).hexdigest()
        body = X.canonical_json({"binding": bound, "generation": generation, "offset": offset}).encode()
        return base64.urlsafe_b64encode(body).decode() + "." + self._sign(body)

    def read(self, cursor: str, binding: dict, generation: str) -> int:
        head, _, signature = cursor.partition(".")
        try:
            body = base64.urlsafe_b64decode(head)
            held = json.loads(body)
        except ValueError as error:
            raise ValueError("malformed cursor") from error
        if not hmac.compare_digest(signature, self._sign(body)):
            raise ValueError("forged cursor")
        if held["binding"] != hashlib.sha256(X.canonical_json(binding).encode()).hexdigest() or held["generation"] != generation:
            raise ValueError("stale cursor")
        return held["offset"]


def recent(products: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Products launched within [start, end], newest first; and the count of unknown dates in the whole scope."""
    inside = products.where(F.col("launch_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return sorted_catalog(inside, "launch_date"), products.agg(F.count_if(F.col("launch_date").isNull()).alias("unknown_launch_date_count"))


def month_window(today: str, months: int) -> tuple:
    """[same day ``months`` back, clamped to the month's end; today] as columns."""
    if not 1 <= months <= 120:
        raise ValueError("months must be 1 to 120")
    day = F.lit(today).cast("date")
    return F.add_months(day, -months), day


def coverage(issuers: DataFrame, available: DataFrame, unsupported: DataFrame, failed: DataFrame) -> DataFrame:
    """Counts of each supported issuer; those without data appear with zeros."""
    codes = available.select("issuer", "product_code").unionByName(unsupported.select("issuer", "product_code")).unionByName(failed.select("issuer", "product_code"))
    known = codes.groupBy("issuer").agg(F.count_distinct("product_code").alias("products"))
    dates = available.groupBy("issuer").agg(F.count(F.lit(1)).alias("current"), F.count("launch_date").alias("confirmed_dates"), F.count_if(F.col("launch_date").isNull()).alias("unknown_dates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    got = issuers.select("issuer").join(known, "issuer", "left").join(dates, "issuer", "left")
    return got.select("issuer", zero("products"), zero("current"), zero("confirmed_dates"), zero("unknown_dates"), (F.coalesce("products", F.lit(0)) > 0).alias("loaded"))


def merchant_hits(passages: DataFrame, needle: str, most: int = 5, width: int = 300) -> DataFrame:
    """Per product, the first ``most`` distinct passages that hold the needle, in document order, cut to ``width`` with dots."""
    line = X.ws_collapse(F.col("text"))
    short = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line)
    found = passages.where(X.like_contains(F.col("text"), needle)).select("issuer", "product_code", "name", "position", short.alias("passage"))
    key = ["issuer", "product_code", "name"]
    one = found.groupBy(*key, "passage").agg(F.min("position").alias("position"))
    first = one.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("position", "passage"))).where(F.col("k") <= most)  # limited in each task first
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "passage"))), lambda x: x["passage"]).alias("passages"))


SHARD = 200_000  # names of one automaton


def _named(batches):
    """(query_id, q, lineage, n) of the names in each query; a shard's names come before its queries."""
    import ahocorasick

    names, automaton = {}, None
    for b in batches:
        at, out = -1, []
        for n, lineage, q in zip(*(b.column(c).to_pylist() for c in ("n", "lineage", "q")), strict=True):
            at += 1
            if q is None:
                names.setdefault(n, []).append(lineage)
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for name in names:
                    automaton.add_word(name, name)
                automaton.make_automaton()
            if names:
                out += [(at, q, lineage_, name) for name in {name for _, name in automaton.iter(q)} for lineage_ in names[name]]
        rows = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("query_id").take(rows), *(pa.array([o[k] for o in out], b.schema.field(c).type) for k, c in ((1, "q"), (2, "lineage"), (3, "n")))], names=["query_id", "q", "lineage", "n"])


def _hits(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, q, lineage, n) of every name that occurs in a query's text.

    Names are cut into shards of about ``SHARD``; each is a trie automaton, through which a text passes once.  A shard's queries are dealt over many tasks, each of which
    gets the shard's names ahead of its queries.
    """
    spark = queries.sparkSession
    shards = max(1, -(-products.count() // SHARD))
    deals = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "q": "string", "lineage": dict(products.dtypes)["lineage"], "n": "string"}
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    given = products.select(empty("query_id"), empty("q"), "lineage", "n", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.pmod(F.xxhash64("n"), F.lit(shards)).cast("int").alias("shard"))
    asked = queries.where("q IS NOT NULL").select("query_id", "q", empty("lineage"), empty("n"), F.pmod(F.xxhash64("query_id", "q"), F.lit(deals)).cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    place = F.col("shard") * deals + F.col("deal")
    both = given.unionByName(asked).withColumn("place", place.cast("int")).repartitionById(shards * deals, F.col("place"))
    met = both.sortWithinPartitions("place", F.col("q").isNotNull()).select("query_id", "q", "lineage", "n")
    return met.mapInArrow(_named, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def resolve_names(queries: DataFrame, products: DataFrame) -> DataFrame:
    """Products named in each query: resolution is resolved, ambiguous or unresolved.

    A name that lies within a longer named one at every place it occurs is left out.
    """
    q = queries.select("query_id", X.nfkc_casefold(F.col("query")).alias("q"))
    p = products.select("lineage", X.nfkc_casefold(F.col("name")).alias("n")).where("n <> ''")
    hit = held(_hits(q, p))
    names = hit.groupBy("query_id").agg(F.collect_set("n").alias("names"))
    # a name stays if it still occurs once every longer name that holds it is blanked out
    longer = F.filter("names", lambda m: (m != F.col("n")) & F.contains(m, F.col("n")))
    rest = F.aggregate(F.array_sort(longer, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), F.col("q"), lambda acc, m: F.replace(acc, m, F.lit("\x00")))
    kept = hit.join(names, "query_id").where(F.contains(rest, F.col("n")))
    got = kept.groupBy("query_id").agg(F.sort_array(F.collect_set("lineage")).alias("lineages"))
    status = F.when(F.col("lineages").isNull(), "unresolved").when(F.size("lineages") == 1, "resolved").otherwise("ambiguous")
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", status.alias("resolution"), F.coalesce("lineages", F.array().cast("array<string>")).alias("lineages"))


def availability(current: DataFrame, unsupported: DataFrame, failed: DataFrame) -> DataFrame:
    """One row a product: available if exactly one current revision, null if several; else unsupported, else failed."""
    tag = lambda d, name, rank: d.select("issuer", "product_code", F.lit(rank).alias("rank"), F.lit(name).alias("status"))
    every = tag(current, "available", 1).unionByName(tag(unsupported, "unsupported_drm", 2)).unionByName(tag(failed, "ocr_failed", 3))
    best = every.groupBy("issuer", "product_code").agg(F.min_by("status", "rank").alias("status"), F.count_if(F.col("rank") == 1).alias("n"))
    return best.select("issuer", "product_code", F.when(F.col("n") > 1, F.lit(None)).otherwise(F.col("status")).alias("status"))


def lookup(wanted: list, rows: DataFrame, key: str) -> DataFrame:
    """One row for each asked key, in the order asked; missing ones with nulls; at most 50 are asked."""
    if not 1 <= len(wanted) <= 50:
        raise ValueError("ask for 1 to 50")
    asked = rows.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"position int, {key} {dict(rows.dtypes)[key]}")
    return asked.join(rows, key, "left").orderBy("position")


def current_products(revisions: DataFrame, lineages: DataFrame) -> DataFrame:
    """Current revisions with their lineage."""
    return revisions.where("temporal_status = 'current'").join(lineages, "lineage")


def listed_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions of a listing: current, ambiguous, others; then newest date; then id."""
    place = F.when(F.col("temporal_status") == "current", 0).when(F.col("temporal_status") == "ambiguous", 1).otherwise(2)
    return revisions.orderBy(place, F.desc_nulls_last("effective_date"), "revision")


def revision_ranks(revisions: DataFrame) -> DataFrame:
    """Every revision with its ``rank`` in the listing of its lineage."""
    place = F.when(F.col("temporal_status") == "current", 0).when(F.col("temporal_status") == "ambiguous", 1).otherwise(2)
    return revisions.withColumn("rank", F.row_number().over(Window.partitionBy("lineage").orderBy(place, F.desc_nulls_last("effective_date"), "revision")))


def section_filter(nodes: DataFrame, section: str) -> DataFrame:
    """Nodes whose type or class is the section, whatever its case."""
    return nodes.where((F.lower("node_type") == section.lower()) | (F.lower("major_class") == section.lower()))


def following(rows: DataFrame, order: list[str], anchor: list, n: int) -> tuple[DataFrame, DataFrame]:
    """The anchor and the n rows after it, and whether more follow."""
    got = after(rows, order, anchor, n + 2)
    w = Window.orderBy(*order)
    at = got.withColumn("__at", F.row_number().over(w))
    return at.where(F.col("__at") <= n + 1).drop("__at"), at.agg((F.count(F.lit(1)) > n + 1).alias("has_more"))


def pick(wanted: list[tuple[str | None, str | None]], products: DataFrame) -> DataFrame:
    """(position, lineage) for each asked (exact code, or part of a name): exact codes win, several matches raise, none gives null.

    At most 50 are asked, so the asked side is small; a name is matched on normalised text.
    """
    if not 1 <= len(wanted) <= 50:
        raise ValueError("ask for 1 to 50")
    spark = products.sparkSession
    asked = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(wanted)], "position int, code string, part string").withColumn("part", X.nfkc_casefold("part"))
    named = products.select("lineage", "product_code", X.nfkc_casefold("name").alias("folded"))
    hit = named.join(F.broadcast(asked), F.when(F.col("code").isNotNull(), F.col("code") == F.col("product_code")).otherwise(F.contains("folded", "part")))
    got = hit.groupBy("position").agg(F.min("lineage").alias("lineage"), F.count_distinct("lineage").alias("n"))
    kind = dict(products.dtypes)["lineage"]
    one = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("ambiguous request "), F.col("position").cast("string"))).cast(kind)).otherwise(F.col("lineage"))
    return asked.select("position").join(got, "position", "left").select("position", one.alias("lineage"))
