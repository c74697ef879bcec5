"""Composite requests over a pinned snapshot: contract search, hybrid evidence search, exhaustive audit.

The snapshot's matrix has (row_index, revision, node, view_type, embedding, display_text); revisions
have (lineage, revision, temporal_status, effective_date, supersedes, issuer, name, launch_date, launch_status).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine, score_blocks
from quillon.operators import catalog, graph, retrieval, temporal
from quillon.sources.snapshot import Snapshot

BUNDLE_NODES, BUNDLE_CHARS = 2048, 1_000_000


@dataclass(frozen=True)
class ContractSearch:
    query: str
    vector: tuple[float, ...]
    issuer: str | None = None
    issuers: tuple[str, ...] | None = None
    lineages: tuple[str, ...] = ()
    as_of: str | None = None
    include_history: bool = False
    launched_from: str | None = None
    launched_to: str | None = None
    today: str = "2026-01-01"
    limit: int = 10
    policy: str = "max_child"
    generation: str | None = None

    def __post_init__(self):
        catalog.check_limit(self.limit)
        if not self.query.strip():
            raise ValueError("empty query")
        if self.as_of is not None and self.include_history:
            raise ValueError("as_of and include_history exclude each other")
        if (self.launched_from is None) != (self.launched_to is None):
            raise ValueError("give both ends of the launch range")
        catalog.scope(self.issuer, list(self.issuers) if self.issuers is not None else None)


def scoped_revisions(snap: Snapshot, request: ContractSearch) -> DataFrame:
    """Revisions a request looks at: issuers, lineages, names in the query, time and launch range, all before any scoring."""
    revisions = snap["revisions"]
    issuers = catalog.scope(request.issuer, list(request.issuers) if request.issuers is not None else None)
    revisions = catalog.equals(revisions, issuer=issuers, lineage=list(request.lineages) or None)
    if not request.lineages:
        asked = revisions.sparkSession.createDataFrame([(0, request.query)], "query_id int, query string")
        named = catalog.resolve_names(asked, revisions.select("lineage", "name").distinct()).where("resolution = 'resolved'").select(F.explode("lineages").alias("lineage"))
        if named.limit(1).count():  # at most one row
            revisions = revisions.join(F.broadcast(named), "lineage", "left_semi")
    chosen = temporal.require_unambiguous(temporal.as_of(revisions, request.as_of)) if request.as_of else temporal.active(revisions, request.include_history)
    if request.launched_from:
        chosen = chosen.join(temporal.launch_range(snap["revisions"], request.launched_from, request.launched_to, request.today), "lineage", "left_semi")
    return chosen


def scored(snap: Snapshot, revisions: DataFrame, vector) -> DataFrame:
    """Scores of every row of the chosen revisions; none is pruned."""
    rows = snap["matrix"].select("row_index", "revision", "node", "view_type", "embedding").join(revisions.select("revision"), "revision", "left_semi")
    return score_blocks(rows, [(0, list(vector))]).drop("query_id")


def search_contracts(snap: Snapshot, request: ContractSearch) -> dict[str, DataFrame]:
    """contracts (ranked), nodes (best 8 a contract), lexical (matches beyond them) and coverage (one row)."""
    snap.require(request.generation)
    revisions = scoped_revisions(snap, request)
    lanes = retrieval.lane_max(scored(snap, revisions, request.vector))
    nodes = retrieval.node_scores(lanes)
    contracts = retrieval.ranked(retrieval.document_scores(lanes, request.policy), "revision", request.limit)
    top = retrieval.top_nodes(nodes.join(contracts.select("revision"), "revision", "left_semi"))
    text = snap["matrix"].join(contracts.select("revision"), "revision", "left_semi")
    matched = retrieval.match_any(text.withColumn("id", F.struct("revision", "node")), request.query, "id", "display_text").select("id.revision", "id.node").distinct()
    extra = retrieval.lexical_additions(matched, top.select("revision", "node"))
    coverage = lanes.agg(F.count_distinct("revision").alias("revisions"), F.count_distinct("revision", "node").alias("nodes"), F.count(F.lit(1)).alias("lanes"), F.lit(False).alias("approximate"))
    return {"contracts": contracts, "nodes": top, "lexical": extra, "coverage": coverage}


def bundles(ranked_nodes: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Expanded nodes of the best contracts, in rank order, admitted before the first overflow of nodes or characters."""
    seeds = ranked_nodes.select(F.col("revision").alias("document"), "node").distinct()
    grown = graph.expand(seeds, nodes, links).join(nodes, ["document", "node"])
    ranks = ranked_nodes.groupBy(F.col("revision").alias("document")).agg(F.min("contract_rank").alias("contract_rank"))
    sizes = grown.groupBy("document").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("text")).alias("n_chars")).join(ranks, "document")
    by_nodes = retrieval.admit(sizes, "n_nodes", BUNDLE_NODES, ["contract_rank", "document"]).drop("used")
    both = retrieval.admit(by_nodes, "n_chars", BUNDLE_CHARS, ["contract_rank", "document"])
    return grown.join(both.select("document", "contract_rank"), "document")


def search_evidence(rows: DataFrame, query: str, vector, limit: int, text_col: str = "text") -> DataFrame:
    """Hybrid search of legacy rows (id, text, embedding): BM25 and cosine ranks fused by reciprocal rank."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    dense = retrieval.ranked(rows.select("id", cosine(F.col("embedding"), literal).alias("score")).where("score IS NOT NULL"), "id", limit)
    words = retrieval.ranked(retrieval.bm25(rows, query, "id", text_col), "id", limit)
    return retrieval.ranked(retrieval.fused_ranks(dense, words), "id", limit)


def audit(snap: Snapshot, request: ContractSearch, done: DataFrame, most: int = 8) -> DataFrame:
    """Exhaustive audit in steps: scores of the next ``most`` contracts that no earlier step holds (revision, score)."""
    revisions = scoped_revisions(snap, request).join(done.select("revision").distinct(), "revision", "left_anti").orderBy("revision").limit(most)
    return retrieval.document_scores(retrieval.lane_max(scored(snap, revisions, request.vector)), request.policy)


def shadow_rerank(ranked: DataFrame, shadow_scores: DataFrame, most: int = 256) -> DataFrame:
    """Ranks by an external score beside the primary ranks, which stay as they are; at most ``most`` candidates."""
    head = ranked.where(F.col("rank") <= most).select("id", "rank").join(shadow_scores.select("id", F.col("score").alias("shadow_score")), "id")
    from pyspark.sql import Window

    return head.withColumn("shadow_rank", F.row_number().over(Window.orderBy(F.desc("shadow_score"), "id")))
