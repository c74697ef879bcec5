"""Trees and typed links: ancestors, descendants, one-hop expansion and clause groups.

Closures run as semi-naive joins on the frontier; each step is one equi-join, and the
number of steps is the depth reached, not the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.holding import held


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(document, seed, node, depth): all nodes reached from each seed along (document, from_node, to_node), the seed at depth 0.

    A node keeps its least depth; cycles end because only new nodes are followed.
    """
    found = held(seeds.select("document", F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    frontier, depth = found, 0
    while True:
        depth += 1
        step = frontier.select("document", "seed", F.col("node").alias("from_node")).join(edges.select("document", "from_node", "to_node"), ["document", "from_node"])
        new = held(step.select("document", "seed", F.col("to_node").alias("node")).distinct().join(found.select("document", "seed", "node"), ["document", "seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            return found
        found, frontier = held(found.unionByName(new)) if depth % 16 == 0 else found.unionByName(new), new  # plans stay short


def child_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select("document", F.col("parent").alias("from_node"), F.col("node").alias("to_node"))


def parent_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select("document", F.col("node").alias("from_node"), F.col("parent").alias("to_node"))


def descendants(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return closure(seeds, child_edges(nodes))


def ancestors(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return closure(seeds, parent_edges(nodes))


def expand(seeds: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(document, node): seeds with ancestors and the subtree of their nearest item, then exactly one pass over the links.

    APPLIES_TO brings the source's subtree when its target is in the base; FOOTNOTE_OF and CONTINUATION_OF bring
    the other end; PREVIOUS and NEXT bring the neighbours of the seeds.  All relative to the base, never to what was added.
    """
    up = ancestors(seeds, nodes)
    kinds = nodes.select("document", "node", "node_type")
    nearest = up.join(kinds, ["document", "node"]).where("node_type = 'ITEM'").groupBy("document", "seed").agg(F.min_by("node", "depth").alias("node")).select("document", "node")
    base = up.select("document", "node").unionByName(descendants(nearest.distinct(), nodes).select("document", "node")).distinct()
    ends = lambda keep, a, b: links.where(keep).join(base.withColumnRenamed("node", a), ["document", a], "left_semi").select("document", F.col(b).alias("node"))
    sources = ends("link_type = 'APPLIES_TO'", "to_node", "from_node").distinct()
    applied = descendants(sources, nodes).select("document", "node")
    side = ends("link_type IN ('FOOTNOTE_OF', 'CONTINUATION_OF')", "from_node", "to_node").unionByName(ends("link_type IN ('FOOTNOTE_OF', 'CONTINUATION_OF')", "to_node", "from_node"))
    near = links.where("link_type IN ('PREVIOUS', 'NEXT')").join(seeds.select("document", F.col("node").alias("from_node")), ["document", "from_node"], "left_semi").select("document", F.col("to_node").alias("node"))
    return base.unionByName(applied).unionByName(side).unionByName(near).distinct()


def clause_groups(seeds: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(document, seed, node): item or table subtree, closed under footnotes and continuations (both ways) and under what applies to a member."""
    both = links.where("link_type IN ('FOOTNOTE_OF', 'CONTINUATION_OF')")
    edges = (
        child_edges(nodes)
        .unionByName(both.select("document", "from_node", "to_node"))
        .unionByName(both.select("document", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")))
        .unionByName(links.where("link_type = 'APPLIES_TO'").select("document", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")))
        .distinct()
    )
    return closure(seeds, edges).select("document", "seed", "node")


def bundle_scope(nodes: DataFrame, scope: str) -> DataFrame:
    """full, benefits (BENEFIT or MIXED) or notices (NOTICE or MIXED); the root always stays."""
    if scope == "full":
        return nodes
    wanted = {"benefits": ("BENEFIT", "MIXED"), "notices": ("NOTICE", "MIXED")}[scope]
    return nodes.where(F.col("major_class").isin(*wanted) | (F.col("node_type") == "ROOT"))


def full_or_partial(nodes: DataFrame, most_nodes: int = 512, most_chars: int = 500_000) -> DataFrame:
    """Whether each document's bundle is whole or must be partial."""
    got = nodes.groupBy("document").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return got.withColumn("bundle", F.when((F.col("n_nodes") > most_nodes) | (F.col("n_chars") > most_chars), "partial").otherwise("full"))


def hydrate(spans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Text of each node from its spans [start, end) in code points of the pages, in span order."""
    piece = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    parts = spans.join(pages, ["document", "page"]).select(*key, "span_ordinal", piece.alias("piece"))
    return parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ordinal", "piece"))), lambda x: x["piece"]), "").alias("text"))


def seal(groups: DataFrame, most_bytes: int = 65_536, key: str = "request", order: str = "rank", body: str = "body") -> DataFrame:
    """(request, rank, admitted, bytes, reason): whole ranked groups admitted while the pretty ASCII JSON list of them fits.

    ``body`` is a group's JSON.  A group that does not fit is skipped and the next tried; ``bytes`` is the size of the list after each group.
    The choice is sequential within a request; requests run in parallel, and a request's groups come in order, one at a time.
    """
    import json

    import pyarrow as pa

    kinds = dict(groups.dtypes)
    names = [key, order, "admitted", "bytes", "reason"]

    def run(batches):
        at, used, n = None, 0, 0
        for b in batches:
            out = []
            for request, text in zip(b.column("request").to_pylist(), b.column("body").to_pylist(), strict=True):
                if (request,) != at:
                    at, used, n = (request,), 2, 0  # "[]"
                lines = json.dumps(json.loads(text), ensure_ascii=True, indent=2).split("\n") if text else ["null"]
                size = sum(len(x) + 3 for x in lines) - 1  # two blanks and a line end each
                whole = size + 4 if not n else used + size + 2  # brackets on lines of their own, or a comma
                fits = whole <= most_bytes
                if fits:
                    used, n = whole, n + 1
                out.append((fits, used, None if fits else "too_large" if size + 4 > most_bytes else "budget"))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("request"), b.column("place"), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=names)

    rows = groups.select(F.col(key).alias("request"), F.col(order).alias("place"), F.col(body).alias("body"))
    return rows.repartition("request").sortWithinPartitions("request", "place").mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean, bytes long, reason string")
