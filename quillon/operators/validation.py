"""Integrity checks: each returns the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.holding import held
from quillon.operators.ordering import global_rank
from quillon.operators.structure import LEAVES

LINK_TYPES = ("CONTINUATION_OF", "FOOTNOTE_OF", "APPLIES_TO", "PREVIOUS", "NEXT")


def schema_differences(df: DataFrame, expected: list[tuple[str, str]]) -> list[str]:
    """What differs from the exact columns and types, in order."""
    have = df.dtypes
    out = [f"missing {n}" for n, _ in expected if n not in dict(have)] + [f"unexpected {n}" for n, _ in have if n not in dict(expected)]
    out += [f"{n} is {dict(have)[n]}, not {t}" for n, t in expected if n in dict(have) and dict(have)[n] != t]
    if not out and have != expected:
        out.append("columns are in another order")
    return out


def count_differences(metadata: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Tables whose row count is not the one the metadata states: (table, stated, counted)."""
    counted = reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("counted")).withColumn("table", F.lit(n)) for n, d in tables.items()])
    return counted.join(metadata.select("table", "stated"), "table", "left").where("stated IS NULL OR stated <> counted").select("table", "stated", "counted")


def wrong_ids(rows: DataFrame, id_col: str, prefix: str, fields: list[str]) -> DataFrame:
    """Rows whose id is not the hash of their own content."""
    return rows.where(F.col(id_col) != X.identity(prefix, **{f: F.col(f) for f in fields}))


def on_cycles(revisions: DataFrame) -> DataFrame:
    """(revision): those that lie on a cycle of ``supersedes`` links, of any length.

    Each has at most one predecessor, so steps are doubled: chains that end are gone after log of their length, and once a doubling loses neither starts nor
    ends, every end is on a cycle: a start that had no more than so many steps would have been lost, and ends that so many further steps map onto themselves are
    permuted by them.  Rounds are so as many as the log of the longest chain, not of the table.  (With several predecessors: as many steps as there are links.)
    """
    step = held(revisions.where("supersedes IS NOT NULL").select("revision", F.col("supersedes").alias("to")).distinct())
    count = lambda: step.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("revision").alias("starts"), F.count_distinct("to").alias("ends")).first()
    length, now, before = 1, count(), None
    total = now.n
    while now.n and length < total and (now != before or now.n != now.starts):
        ahead = step.select(F.col("revision").alias("to"), F.col("to").alias("further"))
        step = held(step.join(ahead, "to").select("revision", F.col("further").alias("to")))
        length, before, now = 2 * length, now, count()
    return step.select(F.col("to").alias("revision")).distinct()


def wrong_supersession(revisions: DataFrame) -> DataFrame:
    """(lineage, revision, supersedes, rule): predecessors that are absent or of another lineage, and revisions on a cycle."""
    before = revisions.select(F.col("revision").alias("supersedes"), F.col("lineage").alias("other")).distinct()
    got = revisions.where("supersedes IS NOT NULL").join(before, "supersedes", "left")
    rule = F.when(F.col("other").isNull(), "absent").when(F.col("other") != F.col("lineage"), "other lineage")
    far = got.withColumn("rule", rule).where("rule IS NOT NULL").select("lineage", "revision", "supersedes", "rule")
    round_ = revisions.join(on_cycles(revisions), "revision", "left_semi").select("lineage", "revision", "supersedes", F.lit("cycle").alias("rule"))
    return far.unionByName(round_)


def wrong_status(revisions: DataFrame) -> DataFrame:
    """Lineages without exactly one current revision, unless they are ambiguous (then none is current)."""
    got = revisions.groupBy("lineage").agg(F.count_if(F.col("temporal_status") == "current").alias("n_current"), F.count_if(F.col("temporal_status") == "ambiguous").alias("n_ambiguous"))
    return got.where(~((F.col("n_current") == 1) & (F.col("n_ambiguous") == 0) | (F.col("n_current") == 0) & (F.col("n_ambiguous") >= 1)))


def wrong_tree(nodes: DataFrame) -> DataFrame:
    """(document, node, rule): several or no roots, parents that are absent, leaf nodes with children.

    With a column ``ordinal`` also: the root is not the first, ordinals are not 0, 1, 2, ... of the document, or a parent does not come before its child.
    """
    roots = nodes.groupBy("document").agg(F.count_if(F.col("parent").isNull()).alias("n")).where("n <> 1").select("document", F.lit("").alias("node"), F.lit("one root").alias("rule"))
    ordered = "ordinal" in nodes.columns
    names = nodes.select("document", F.col("node").alias("parent"), F.col("node_type").alias("parent_type"), *([F.col("ordinal").alias("parent_ordinal")] if ordered else []))
    child = nodes.where("parent IS NOT NULL").join(names, ["document", "parent"], "left")
    absent = child.where("parent_type IS NULL").select("document", "node", F.lit("parent present").alias("rule"))
    under = child.where(F.col("parent_type").isin(*LEAVES)).select("document", "node", F.lit("leaf without children").alias("rule"))
    found = roots.unionByName(absent).unionByName(under)
    if not ordered:
        return found
    told = lambda rows, rule: rows.select("document", "node", F.lit(rule).alias("rule"))
    first = told(nodes.where("parent IS NULL AND ordinal IS DISTINCT FROM 0"), "root first")
    gaps = told(wrong_ordinals(nodes, ["document"], "ordinal"), "contiguous ordinals")
    late = told(child.where("parent_ordinal >= ordinal"), "parent before child")
    return found.unionByName(first).unionByName(gaps).unionByName(late)


def wrong_ordinals(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Rows whose ordinal is not their position from 0 within the key, or in the whole table without one."""
    if not key:
        return global_rank(rows, [ordinal], "__at").where(F.col("__at") - 1 != F.col(ordinal)).drop("__at")
    at = F.row_number().over(Window.partitionBy(*key).orderBy(ordinal)) - 1
    return rows.withColumn("__at", at).where(~F.col("__at").eqNullSafe(F.col(ordinal))).drop("__at")


def wrong_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of unknown type, to themselves, or with an end outside the document."""
    have = nodes.select("document", F.col("node").alias("n"))
    a = links.join(have.withColumnRenamed("n", "from_node"), ["document", "from_node"], "left_anti").select(*links.columns)
    b = links.join(have.withColumnRenamed("n", "to_node"), ["document", "to_node"], "left_anti").select(*links.columns)
    c = links.where(~F.col("link_type").isin(*LINK_TYPES) | (F.col("from_node") == F.col("to_node")))
    return a.unionByName(b).unionByName(c).distinct()


def wrong_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans out of their page or whose stated hash is not that of their text."""
    piece = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    got = spans.join(pages, ["document", "page"], "left")
    bad = F.col("text").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text")) | (X.sha256(piece) != F.col("text_sha256"))
    return got.where(bad).select(*spans.columns)


def overlapping_spans(spans: DataFrame) -> DataFrame:
    w = Window.partitionBy("document", "page").orderBy("start", "end")
    return spans.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before > start")


def uncovered(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose non-blank characters are not all within spans: (document, page, source, covered)."""
    piece = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    have = spans.join(pages, ["document", "page"]).groupBy("document", "page").agg(F.sum(X.non_space_count(piece)).alias("covered"))
    got = pages.select("document", "page", X.non_space_count(F.col("text")).alias("source")).join(have, ["document", "page"], "left")
    return got.withColumn("covered", F.coalesce("covered", F.lit(0))).where("covered <> source")


def wrong_display(nodes: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes whose text is not their spans' text joined."""
    from quillon.operators.graph import hydrate

    return nodes.join(hydrate(spans, pages, ["document", "node"]).withColumnRenamed("text", "joined"), ["document", "node"]).where("joined <> text").select("document", "node")


def wrong_table_rows(parsed: DataFrame) -> DataFrame:
    """Table rows without cells or headers, and others that have them."""
    row = F.col("node_type") == "TABLE_ROW"
    return parsed.where(row & (F.col("cells").isNull() | F.col("role").isNull()) | ~row & F.col("cells").isNotNull()).select("document", "seq")


def missing(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Keys without a counterpart: orphans, revisions without a view, and the like."""
    return rows.select(*key).distinct().join(others.select(*key).distinct(), key, "left_anti")


def wrong_aggregation_shape(views: DataFrame) -> DataFrame:
    """Revisions without exactly one contract row and at least one child row."""
    got = views.groupBy("revision").agg(F.count_if(F.col("view_type") == "CONTRACT").alias("contracts"), F.count_if(F.col("view_type") != "CONTRACT").alias("children"))
    return got.where("contracts <> 1 OR children < 1")


def duplicate_views(views: DataFrame) -> DataFrame:
    return views.groupBy("revision", "node", "view_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wrong_vectors(matrix: DataFrame, dim: int, vector: str = "embedding", tolerance: float = 2e-5) -> DataFrame:
    """Rows whose vector has another length, a value that is not finite, or a norm off 1."""
    from quillon.functions.vectors import norm

    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(norm(v) - 1.0) <= 2 * tolerance)
    return matrix.where(~F.coalesce(fine, F.lit(False)))


def wrong_launch_evidence(revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confirmed revisions without evidence of their date, and dates without status confirmed."""
    has = evidence.select("revision", F.col("normalized_value").cast("date").alias("launch_date")).distinct()
    a = revisions.where("launch_status = 'confirmed'").join(has, ["revision", "launch_date"], "left_anti").select("revision")
    b = revisions.where("(launch_date IS NOT NULL) <> (launch_status = 'confirmed')").select("revision")
    return a.unionByName(b).distinct()


def uncovered_blocks(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Table blocks (document, page, start, end) that no single span of their page holds whole.

    One sweep of a page in the order of starts, spans first: a block is held if the furthest end of the spans begun so far reaches its own.
    """
    edge = ["document", "page", "start", "end"]
    both = spans.select(*edge, F.lit(0).alias("kind")).unionByName(blocks.select(*edge, F.lit(1).alias("kind")))
    begun = Window.partitionBy("document", "page").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(F.when(F.col("kind") == 0, F.col("end"))).over(begun)
    return both.withColumn("reached", reached).where("kind = 1 AND (reached IS NULL OR reached < end)").select(*edge)


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Counts and 4-decimal percentages of chunk faults from flag columns."""
    n = F.count(F.lit(1))
    flags = ("starts_mid_word", "splits_table", "splits_fact")
    return chunks.agg(n.alias("chunks"), *[F.count_if(f).alias(f) for f in flags], *[X.percent_4dp(F.count_if(f), n).alias(f"{f}_percent") for f in flags])


def backup_status(objects: DataFrame) -> DataFrame:
    """Pending count, bytes and age of the oldest, and how many failed."""
    waiting = F.col("status") == "pending"
    return objects.agg(F.count_if(waiting).alias("pending"), F.coalesce(F.sum(F.when(waiting, F.col("bytes"))), F.lit(0)).cast("long").alias("pending_bytes"), F.min(F.when(waiting, F.col("created"))).alias("oldest"), F.count_if(F.col("status") == "failed").alias("failed"))


def triggers(status: DataFrame, count: int, size: int) -> DataFrame:
    """Which thresholds a status row reaches."""
    why = F.array(F.when(F.col("pending") >= count, "count"), F.when(F.col("pending_bytes") >= size, "bytes"), F.when(F.col("failed") > 0, "failed"))
    return status.withColumn("reasons", F.filter(why, lambda x: x.isNotNull()))


def source_coverage(pages: DataFrame) -> DataFrame:
    """(document, characters, sha256): non-blank characters of all pages in order and the hash of them joined."""
    solid = F.regexp_replace("text", X.WHITESPACE, "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", solid.alias("t")))), lambda x: x["t"]), "")
    return pages.groupBy("document").agg(F.sum(F.length(solid)).alias("characters"), joined.alias("t")).select("document", "characters", X.sha256(F.col("t")).alias("sha256"))


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides at the same position; a position that one side lacks raises."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    lone = F.col("__a").isNull() | F.col("__b").isNull()
    return both.withColumn(key, F.when(lone, F.raise_error(F.concat(F.lit("unmatched position "), F.col(key).cast("string"))).cast(dict(a.dtypes)[key])).otherwise(F.col(key))).drop("__a", "__b")


def preflight(repeats: DataFrame, threshold: float) -> DataFrame:
    """Least and mean cosine of repeated embeddings (text_id, a, b) and whether the least reaches the threshold."""
    from quillon.functions.vectors import cosine

    return repeats.select(cosine(F.col("a"), F.col("b")).alias("c")).agg(F.min("c").alias("least"), F.avg("c").alias("mean")).withColumn("passed", F.col("least") >= threshold)


def wrong_scores(captured: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows of a captured ranking whose score or rank a new computation does not confirm."""
    b = recomputed.select("id", F.col("score").alias("again"), F.col("rank").alias("rank_again"))
    got = captured.join(b, "id", "left")
    return got.where(F.col("again").isNull() | (F.abs(F.col("score") - F.col("again")) > tolerance) | (F.col("rank") != F.col("rank_again"))).select("id", "score", "rank")


def wrong_listing_pages(pages: DataFrame) -> DataFrame:
    """Listings (source, page, pages_total, rows_total, n_rows) whose pages are not 1..total or whose rows do not add up."""
    got = pages.groupBy("source").agg(F.max("pages_total").alias("pages_total"), F.max("rows_total").alias("rows_total"), F.count_distinct("page").alias("pages"), F.max("page").alias("last"), F.sum("n_rows").alias("rows"))
    return got.where("pages <> pages_total OR last <> pages_total OR rows <> rows_total").select("source", "pages", "rows")
