"""Exact retrieval: lane maxima, document policies, lexical matching, fusion and budgets.

All operators take and return DataFrames; ties always end in a unique id.  Scores are never
approximated or pruned.  Aggregations that keep one row a key use max over a struct, which combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.holding import held
from quillon.operators.ordering import global_rank, running_sum

#: Lanes in their fixed order.
LANES = ("TITLE", "RAW_ITEM", "CONTEXTUAL_ITEM", "DETAIL", "MAJOR_SECTION", "CONTRACT")
POLICIES = ("max_child", "top3_mean", "contract_plus_child")


def lane_max(scores: DataFrame) -> DataFrame:
    """Best row of each (revision, node, view_type); the lowest row_index wins ties."""
    best = F.max(F.struct("score", (-F.col("row_index")).alias("neg")))
    return scores.groupBy("revision", "node", "view_type").agg(best.alias("b")).select("revision", "node", "view_type", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("row_index"))


def node_scores(lanes: DataFrame) -> DataFrame:
    """Best score of each node over its lanes, and the lanes that reach it, in lane order."""
    order = F.array(*[F.lit(x) for x in LANES])
    near = F.filter("lanes", lambda x: X.stays_close(x["score"], F.col("score")))
    ordered = F.array_sort(F.transform(near, lambda x: F.struct(F.array_position(order, x["view_type"]).alias("p"), x["view_type"].alias("v"))))
    grouped = lanes.groupBy("revision", "node").agg(F.max("score").alias("score"), F.collect_list(F.struct("view_type", "score")).alias("lanes"))
    return grouped.select("revision", "node", "score", F.transform(ordered, lambda x: x["v"]).alias("view_types"))


def document_scores(rows: DataFrame, policy: str) -> DataFrame:
    """Score of each revision: largest child, mean of the three largest children, or half the contract row and half the largest child.

    A revision without a child row, or (third policy) without exactly one contract row, is an error.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    child = F.when(F.col("view_type") != "CONTRACT", F.col("score"))
    whole = F.when(F.col("view_type") == "CONTRACT", F.col("score"))
    if policy == "top3_mean":
        w = Window.partitionBy("revision").orderBy(F.desc("score"), "row_index")
        top = rows.where("view_type <> 'CONTRACT'").withColumn("k", F.row_number().over(w)).where("k <= 3")
        return top.groupBy("revision").agg(F.avg("score").alias("score"))
    got = rows.groupBy("revision").agg(F.max(child).alias("child"), F.max(whole).alias("whole"), F.count(whole).alias("n"))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("revision").cast("string"))).cast("double")
    checked = F.when(F.col("child").isNull(), fail("no child row")).otherwise(F.col("child"))
    if policy == "max_child":
        return got.select("revision", checked.alias("score"))
    whole_one = F.when(F.col("n") != 1, fail("not exactly one contract row")).otherwise(F.col("whole"))
    return got.select("revision", (0.5 * whole_one + 0.5 * checked).alias("score"))


def ranked(scores: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """Rows by (-score, id) with their rank; with a limit the plan is a top-k, else ranks are numbered by partition."""
    order = [F.desc("score"), F.col(id_col)]
    if limit is None:
        return global_rank(scores, order)
    return scores.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_nodes(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The k best nodes of each revision by (-score, node)."""
    w = Window.partitionBy("revision").orderBy(F.desc("score"), "node")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(token, id, tf, dl): the inverted index of whole texts."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(X.all_tokens(F.col(text_col))).alias("token"))
    sizes = docs.select(F.col(id_col).alias("id"), F.size(X.all_tokens(F.col(text_col))).alias("dl"))
    return words.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf")).join(sizes, "id")


def query_tokens(query: str) -> list[str]:
    words = [w for w in map(X.fold_word, query.split()) if w]
    if not words:
        raise ValueError("a lexical query needs a word")
    return list(dict.fromkeys(words))


def match_all(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids of the texts that hold every word of the query."""
    held = X.tokens(F.col(text_col))
    return docs.where(reduce(lambda a, b: a & b, [F.array_contains(held, w) for w in query_tokens(query)])).select(id_col)


def match_any(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids of the texts that hold some word of the query."""
    words = F.array(*[F.lit(w) for w in query_tokens(query)])
    return docs.where(F.arrays_overlap(X.tokens(F.col(text_col)), words)).select(id_col)


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the texts that hold every query word; idf = ln((N - df + 0.5) / (df + 0.5)), at least 1e-6.

    The texts are read and cut into words once: a row's counts of the query's words are kept, and both the totals and the scores read those.
    """
    words = query_tokens(query)
    toks = docs.select(F.col(id_col).alias("id"), X.all_tokens(F.col(text_col)).alias("t"))

    def count(word: str):
        return F.size(F.filter("t", lambda x: x == F.lit(word)))

    tf = [count(w) for w in words]
    counted = held(toks.select("id", F.size("t").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    joined = counted.where(reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))  # one row of totals

    def part(i: int):
        df, f = F.col(f"df{i}").cast("double"), F.col(f"tf{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        return idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    return joined.select("id", reduce(lambda x, y: x + y, [part(i) for i in range(len(words))]).alias("score"))


def rrf(lists: list[DataFrame], k: int = 60, cutoffs: list[int | None] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) lists: sum of 1 / (k + rank); a cutoff drops a list's term beyond that rank."""
    cutoffs = cutoffs or [None] * len(lists)
    parts = [d.select("id", "rank") if c is None else d.where(F.col("rank") <= c).select("id", "rank") for d, c in zip(lists, cutoffs, strict=True)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def fused_ranks(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """Full outer merge of two rank lists with both ranks and the fused score."""
    d, x = dense.select("id", F.col("rank").alias("dense_rank")), lexical.select("id", F.col("rank").alias("lexical_rank"))
    term = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return d.join(x, "id", "full_outer").withColumn("score", term("dense_rank") + term("lexical_rank"))


def first_by_contract(spans: DataFrame, limit: int = 100) -> DataFrame:
    """Contracts in order of their first span, re-ranked from 1."""
    first = spans.groupBy("contract").agg(F.min("rank").alias("first_rank"))
    w = Window.orderBy("first_rank", "contract")
    return first.orderBy("first_rank", "contract").limit(limit).withColumn("rank", F.row_number().over(w))


def rank_changes(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """How many ids stand at another rank in the shadow list."""
    both = primary.select("id", F.col("rank").alias("a")).join(shadow.select("id", F.col("rank").alias("b")), "id")
    return both.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def lexical_additions(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Lexical matches that are not among the dense ones."""
    return lexical.join(dense, lexical.columns, "left_anti")


def admit(rows: DataFrame, size: str, budget: int, order: list) -> DataFrame:
    """The ranked rows before the first whose running size would pass the budget."""
    return running_sum(rows, size, order).where(F.col("used") <= budget)


def best_view(matches: DataFrame) -> DataFrame:
    """One row a node: the view of best score, then lowest row_index."""
    w = F.max(F.struct("score", (-F.col("row_index")).alias("neg"), "view_type"))
    return matches.groupBy("revision", "node").agg(w.alias("b")).select("revision", "node", F.col("b.view_type").alias("view_type"), F.col("b.score").alias("score"), (-F.col("b.neg")).alias("row_index"))


def captured(scores: DataFrame) -> DataFrame:
    """All scores in row order with a check of their range: the capture of an exact search."""
    ok = (F.col("score") >= -1.00002) & (F.col("score") <= 1.00002)
    return scores.withColumn("score", F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("score out of [-1, 1]")).cast("double"))).orderBy("row_index")
