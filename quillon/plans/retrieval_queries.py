"""Retrieval and evaluation queries over the test tables.

Matrix rows are ``embeddings``: a label is a revision, its first row the CONTRACT view of node n0,
the others five lanes a node.  Scores are rounded to 6 decimals where rows are scored, so that ties are the same everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.vectors import best_rows, cosine, dot, group_best, norm, score_blocks, score_pairs, starts
from quillon.holding import shared_folder
from quillon.operators import evaluation as E
from quillon.operators import retrieval as R
from quillon.operators import validation as V
from quillon.operators.ordering import global_rank
from quillon.plans.registry import held, query, read
from quillon.sources import lexical

CHILD_LANES = ("TITLE", "RAW_ITEM", "CONTEXTUAL_ITEM", "DETAIL", "MAJOR_SECTION")
WORDS_AND, WORDS_OR = "the of", "queaire les"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = e.select(F.col("vec_id").alias("row_index"), F.col("label").alias("revision"), "embedding", r.alias("r"))
    node = F.when(F.col("r") == 0, "n0").otherwise(F.concat(F.lit("n"), (F.floor((F.col("r") - 1) / 5) + 1).cast("string")))
    lane = F.when(F.col("r") == 0, "CONTRACT").otherwise(F.element_at(F.array(*[F.lit(x) for x in CHILD_LANES]), ((F.col("r") - 1) % 5 + 1).cast("int")))
    return rows.select("row_index", "revision", node.alias("node"), lane.alias("view_type"), "embedding")


def vectors_of(spark: SparkSession, sf_dir: str, ids: list[int]) -> list[tuple[int, list[float]]]:
    """The query vectors: rows asked by id, so as many as are asked."""
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
    return sorted((r.vec_id, list(r.embedding)) for r in rows)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score_blocks(matrix(spark, sf_dir), vectors_of(spark, sf_dir, [0])).drop("query_id")
    return got.withColumn("score", F.round("score", 6))


MATRIX = """
WITH b AS (SELECT vec_id AS row_index, label AS revision, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
m AS (SELECT row_index, revision, embedding, CASE WHEN r = 0 THEN 'n0' ELSE 'n' || ((r - 1) // 5 + 1) END AS node,
      CASE WHEN r = 0 THEN 'CONTRACT' ELSE (['TITLE','RAW_ITEM','CONTEXTUAL_ITEM','DETAIL','MAJOR_SECTION'])[(r - 1) % 5 + 1] END AS view_type FROM b),
s AS (SELECT row_index, revision, node, view_type, round(list_inner_product(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM m, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
"""
LANE = MATRIX + """, l AS (SELECT revision, node, view_type, max(score) AS score, arg_min(row_index, (-score, row_index)) AS row_index FROM s GROUP BY ALL)
"""


@query(MATRIX + "SELECT row_index, revision, node, score FROM s ORDER BY score DESC, row_index LIMIT 50")
def exact_dense_topk(spark, sf_dir):
    return scores(spark, sf_dir).orderBy(F.desc("score"), "row_index").limit(50).select("row_index", "revision", "node", "score")


@query(MATRIX + "SELECT row_index, revision, node, view_type, score FROM s")
def score_capture(spark, sf_dir):
    return R.captured(scores(spark, sf_dir)).select("row_index", "revision", "node", "view_type", "score")


@query(LANE + "SELECT * FROM l")
def lane_max_collapse(spark, sf_dir):
    return R.lane_max(scores(spark, sf_dir))


@query(LANE + """, b2 AS (SELECT revision, node, max(score) AS score FROM l GROUP BY ALL)
SELECT l.revision, l.node, any_value(b2.score) AS score, string_agg(view_type, ',' ORDER BY list_position(['TITLE','RAW_ITEM','CONTEXTUAL_ITEM','DETAIL','MAJOR_SECTION','CONTRACT'], view_type)) AS view_types
FROM l JOIN b2 ON l.revision = b2.revision AND l.node = b2.node AND abs(l.score - b2.score) <= greatest(1e-7, 1e-9 * greatest(abs(l.score), abs(b2.score))) GROUP BY l.revision, l.node""")
def node_view_types(spark, sf_dir):
    return R.node_scores(R.lane_max(scores(spark, sf_dir))).withColumn("view_types", F.array_join("view_types", ","))


DOC = """, d AS (SELECT revision, {agg} AS score FROM l GROUP BY revision)
SELECT revision, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 8) DESC, revision)::INTEGER AS rank FROM d"""


def small_ranks(df: DataFrame) -> DataFrame:
    """Ranks as the int of the oracles; the tables here have fewer rows."""
    return df.withColumn("rank", F.col("rank").cast("int"))


def _documents(spark, sf_dir, policy):
    got = R.document_scores(R.lane_max(scores(spark, sf_dir)), policy).withColumn("score", F.round("score", 8))
    return small_ranks(R.ranked(got, "revision"))


@query(LANE + DOC.format(agg="max(score) FILTER (WHERE view_type <> 'CONTRACT')"))
def doc_agg_max_child(spark, sf_dir):
    return _documents(spark, sf_dir, "max_child")


@query(LANE + DOC.format(agg="list_avg(list_slice(list(score ORDER BY score DESC) FILTER (WHERE view_type <> 'CONTRACT'), 1, 3))"))
def doc_agg_top3_mean(spark, sf_dir):
    return _documents(spark, sf_dir, "top3_mean")


@query(LANE + DOC.format(agg="0.5 * max(score) FILTER (WHERE view_type = 'CONTRACT') + 0.5 * max(score) FILTER (WHERE view_type <> 'CONTRACT')"))
def doc_agg_contract_plus_child(spark, sf_dir):
    return _documents(spark, sf_dir, "contract_plus_child")


@query(LANE + """, n AS (SELECT revision, node, max(score) AS score FROM l GROUP BY ALL)
SELECT revision, node, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY revision ORDER BY score DESC, node)::INTEGER AS rank FROM n) WHERE rank <= 8""")
def topn_nodes_per_doc(spark, sf_dir):
    return R.top_nodes(R.node_scores(R.lane_max(scores(spark, sf_dir)))).select("revision", "node", "score", "rank")


#: The query set of searches over whole tables: every row whose id is divisible by 100.
ASKED = "% 100 = 0"


def asked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where(f"vec_id {ASKED}").select(F.col("vec_id").alias("query_id"), "label", "embedding")


@query(f"""SELECT c.vec_id AS row_index, q.vec_id AS query_id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings c, embeddings q WHERE q.vec_id {ASKED}""")
def multi_query_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    return score_pairs(rows, asked_of(spark, sf_dir), "row_index").withColumn("score", F.round("score", 6))


@query("""SELECT c.vec_id AS id, round(greatest(-1, least(1, list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))), 6) AS score
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.label = 3 ORDER BY 2 DESC, 1 LIMIT 20""")
def legacy_cosine_filtered_topk(spark, sf_dir):
    (_, v), = vectors_of(spark, sf_dir, [0])
    rows = read(spark, sf_dir, "embeddings").where("label = 3")
    lit = F.array(*[F.lit(float(x)) for x in v])
    return rows.select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), lit), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


TOKENS = r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
"""


@query(TOKENS + "SELECT id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def lexical_and(spark, sf_dir):
    return R.match_all(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), WORDS_AND)


@query(TOKENS + "SELECT id FROM t WHERE list_contains(w, 'queaire') OR list_contains(w, 'les')")
def lexical_or(spark, sf_dir):
    return R.match_any(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), WORDS_OR)


BM25 = TOKENS + """, c AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'of')) AS t1 FROM t),
g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, count(*) FILTER (WHERE t0 > 0)::DOUBLE AS d0, count(*) FILTER (WHERE t1 > 0)::DOUBLE AS d1 FROM c),
x AS (SELECT id, round(greatest(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(1e-6, ln((n - d1 + 0.5) / (d1 + 0.5))) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM c, g WHERE t0 > 0 AND t1 > 0),
lex AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM x ORDER BY score DESC, id LIMIT 100)
"""


def lexical_ranks(spark, sf_dir, limit=100):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.ranked(R.bm25(docs, WORDS_AND).withColumn("score", F.round("score", 6)), "id", limit)


def dense_ranks(spark, sf_dir, query_id=0, limit=100):
    got = score_blocks(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), vectors_of(spark, sf_dir, [query_id]))
    return small_ranks(R.ranked(got.select("id", F.round("score", 6).alias("score")), "id", limit))


@query(BM25 + "SELECT * FROM lex")
def bm25_topk(spark, sf_dir):
    return lexical_ranks(spark, sf_dir)


def indexed(spark, sf_dir):
    """The index of all texts, written to the shared folder."""
    path = shared_folder(spark, "lexical")
    lexical.build(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return lexical.LexicalIndex(spark, path)


@query(BM25 + "SELECT * FROM lex")
def bm25_topk_indexed(spark, sf_dir):
    """``bm25_topk`` from a persisted index: the search reads postings, not texts."""
    asked = spark.createDataFrame([(0, R.query_tokens(WORDS_AND))], "query_id int, words array<string>")
    return indexed(spark, sf_dir).search(asked, 100, places=6).select("id", "score", "rank")


ASKED_WORDS = TOKENS.rstrip() + """, q AS (SELECT id AS query_id, unnest(list_distinct([w[1], w[len(w)]])) AS token FROM t WHERE id % 100 = 0 AND len(w) > 0),
nq AS (SELECT query_id, count(*) AS n_words FROM q GROUP BY query_id),
c AS (SELECT id, token, len(w) AS dl, count(*) AS tf FROM (SELECT id, w, unnest(w) AS token FROM t) GROUP BY id, token, len(w)),
g AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM t), df AS (SELECT token, count(*)::DOUBLE AS d FROM c GROUP BY token)
"""


@query(ASKED_WORDS + """, x AS (SELECT q.query_id, c.id, round(sum(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, count(*) AS held
FROM q JOIN c ON c.token = q.token JOIN df ON df.token = q.token, g GROUP BY q.query_id, c.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM x JOIN nq USING (query_id) WHERE held = n_words
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def indexed_searches(spark, sf_dir):
    """Every document whose id is divisible by 100 asks with its first and last word; the ten best texts of each, from one index."""
    words = X.all_tokens(F.col("text"))
    asked = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("w")).where(F.size("w") > 0).select("query_id", F.array(F.col("w")[0], F.element_at("w", -1)).alias("words"))
    return indexed(spark, sf_dir).search(asked, 10, places=6)


@query(ASKED_WORDS + "SELECT q.query_id, count(DISTINCT c.id) AS texts FROM q JOIN c ON c.token = q.token GROUP BY q.query_id")
def indexed_matches(spark, sf_dir):
    """How many texts hold the first or the last word of every hundredth document."""
    words = X.all_tokens(F.col("text"))
    asked = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("w")).where(F.size("w") > 0).select("query_id", F.array(F.col("w")[0], F.element_at("w", -1)).alias("words"))
    return indexed(spark, sf_dir).counts(asked, every=False)


DENSE = """, dense AS (SELECT c.vec_id AS id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (ORDER BY round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, c.vec_id)::INTEGER AS rank
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 100)
"""


@query(BM25 + DENSE + """SELECT id, dense.rank AS dense_rank, lex.rank AS lexical_rank, round(coalesce(1.0 / (60 + dense.rank), 0) + coalesce(1.0 / (60 + lex.rank), 0), 9) AS score
FROM dense FULL JOIN lex USING (id)""")
def rrf_fusion(spark, sf_dir):
    return R.fused_ranks(dense_ranks(spark, sf_dir), lexical_ranks(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(BM25 + DENSE + """SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM dense WHERE rank <= 50 UNION ALL SELECT id, rank FROM lex) GROUP BY id""")
def rrf_with_cutoff(spark, sf_dir):
    got = R.rrf([dense_ranks(spark, sf_dir), lexical_ranks(spark, sf_dir)], cutoffs=[50, None])
    return got.withColumn("score", F.round("score", 9))


@query(BM25 + DENSE + "SELECT id FROM lex WHERE id NOT IN (SELECT id FROM dense)")
def lexical_additional(spark, sf_dir):
    return R.lexical_additions(lexical_ranks(spark, sf_dir).select("id"), dense_ranks(spark, sf_dir).select("id"))


@query("""WITH s AS (SELECT c.vec_id AS id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS a, round(list_inner_product(c.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS b
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q, (SELECT embedding FROM embeddings WHERE vec_id = 1) p),
r AS (SELECT id, row_number() OVER (ORDER BY a DESC, id) AS ra, row_number() OVER (ORDER BY b DESC, id) AS rb FROM s)
SELECT count(*) AS candidates, count(*) FILTER (WHERE ra <> rb) AS changed FROM r""")
def rank_change_count(spark, sf_dir):
    return R.rank_changes(dense_ranks(spark, sf_dir, 0, None), dense_ranks(spark, sf_dir, 1, None))


@query(MATRIX + """, r AS (SELECT revision AS contract, row_number() OVER (ORDER BY score DESC, row_index) AS rank FROM s), f AS (SELECT contract, min(rank)::INTEGER AS first_rank FROM r GROUP BY contract)
SELECT contract, first_rank, row_number() OVER (ORDER BY first_rank, contract)::INTEGER AS rank FROM f""")
def first_occurrence_contracts(spark, sf_dir):
    ranks = small_ranks(R.ranked(scores(spark, sf_dir).select(F.col("row_index").alias("id"), "revision", "score"), "id"))
    return R.first_by_contract(ranks.select(F.col("revision").alias("contract"), "rank"))


@query(LANE + "SELECT revision, node, arg_max(view_type, (score, -row_index, view_type)) AS view_type, max(score) AS score, arg_max(row_index, (score, -row_index, view_type)) AS row_index FROM l GROUP BY revision, node")
def evidence_best_view(spark, sf_dir):
    return R.best_view(R.lane_max(scores(spark, sf_dir)))


@query("""SELECT source, doc_id, n_chars, used FROM (SELECT source, doc_id, n_chars, (sum(n_chars) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 1000000""")
def cumulative_budget_admission(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.admit(docs, "n_chars", 1_000_000, ["source", "doc_id"])


@query("""SELECT count(DISTINCT label) AS revisions, count(*) AS rows_scored, count(DISTINCT (label, vec_id)) AS views, min(vec_id) AS first_row, max(vec_id) AS last_row, false AS approximate FROM embeddings""")
def coverage_report(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.count_distinct("label").alias("revisions"), F.count(F.lit(1)).alias("rows_scored"), F.count_distinct("label", "vec_id").alias("views"), F.min("vec_id").alias("first_row"), F.max("vec_id").alias("last_row"), F.lit(False).alias("approximate"))


# Relevance: rows of the query's label.
RUN = """WITH run AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, q.label AS ql, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS rank
FROM embeddings c, embeddings q WHERE q.vec_id {ids}),
gold AS (SELECT q.vec_id AS query_id, c.vec_id AS id, 1 + (c.vec_id % 3) AS relevance FROM embeddings c, embeddings q WHERE q.vec_id {ids} AND c.label = q.label),
h AS (SELECT query_id, count(*) AS hit, sum((pow(2, relevance) - 1) / log2(rank + 1)) AS dcg, min(rank) AS f FROM run JOIN gold USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN (pow(2, relevance) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS r FROM gold) GROUP BY query_id),
x AS (SELECT query_id, round(coalesce(hit, 0) / n, 9) AS recall, round(coalesce(dcg / idcg, 0), 9) AS ndcg, round(coalesce(1.0 / f, 0), 9) AS mrr FROM i LEFT JOIN h USING (query_id))
"""


def best_of(spark, sf_dir, best=10):
    """(query_id, id, rank) of the best rows of every query of the whole set."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    got = score_pairs(e, asked_of(spark, sf_dir), "id", best=best)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("query_id", "id", "rank")


def gold_of(spark, sf_dir):
    asked = asked_of(spark, sf_dir).select("query_id", "label")
    return read(spark, sf_dir, "embeddings").join(asked, "label").select("query_id", F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 3).alias("relevance"))


def metrics_of(spark, sf_dir):
    out = E.ir_metrics(best_of(spark, sf_dir), gold_of(spark, sf_dir))
    return out.select("query_id", *[F.round(m, 9).alias(m) for m in E.METRICS])


@query(RUN.format(ids=ASKED) + "SELECT * FROM x")
def ir_metrics(spark, sf_dir):
    return metrics_of(spark, sf_dir)


@query(RUN.format(ids=ASKED) + """, m AS (SELECT query_id, unnest(CASE WHEN query_id % 200 = 0 THEN ['all', 'even'] ELSE ['all', 'odd'] END) AS slice FROM x)
SELECT slice, count(*) AS n, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg, round(avg(mrr), 9) AS mrr FROM x JOIN m USING (query_id) GROUP BY slice""")
def slice_rollup(spark, sf_dir):
    x = held(metrics_of(spark, sf_dir))
    members = x.select("query_id", F.when(F.col("query_id") % 200 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all"), F.lit("odd"))).alias("slices"))
    return E.by_slice(x, members).select("slice", "n", *[F.round(m, 9).alias(m) for m in E.METRICS])


@query(RUN.format(ids=ASKED) + """SELECT a.query_id, round(a.recall - b.recall, 9) AS recall, round(a.ndcg - b.ndcg, 9) AS ndcg, round(a.mrr - b.mrr, 9) AS mrr
FROM x a JOIN x b ON b.query_id = a.query_id + 100 WHERE a.query_id % 200 = 0""")
def paired_deltas(spark, sf_dir):
    x = held(metrics_of(spark, sf_dir))
    got = E.paired_deltas(x.where("query_id % 200 = 0"), x.where("query_id % 200 <> 0").withColumn("query_id", F.col("query_id") - 100))
    return got.select("query_id", *[F.round(m, 9).alias(m) for m in E.METRICS])


@query(RUN.format(ids=ASKED) + "SELECT gold.query_id, round(count(*) FILTER (WHERE run.rank <= 5) / count(*), 9) AS recall_5, round(count(*) FILTER (WHERE run.rank <= 10) / count(*), 9) AS recall_10 FROM gold JOIN run USING (query_id, id) GROUP BY 1")
def span_recall(spark, sf_dir):
    return E.recall_at(best_of(spark, sf_dir), gold_of(spark, sf_dir).select("query_id", "id")).select("query_id", F.round("recall_5", 9).alias("recall_5"), F.round("recall_10", 9).alias("recall_10"))


@query()
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap(metrics_of(spark, sf_dir).withColumn("lane", F.lit("exact")), 7)


@query("""WITH a AS (SELECT label AS query_id, list(DISTINCT vec_id % 17) AS gold, list(DISTINCT vec_id % 13) FILTER (WHERE vec_id % 2 = 0) AS found FROM embeddings GROUP BY label)
SELECT query_id, round(CASE WHEN len(found) > 0 THEN len(list_intersect(gold, found)) / len(found) END, 9) AS precision, round(len(list_intersect(gold, found)) / len(gold), 9) AS recall,
  len(list_intersect(gold, found)) = len(gold) AND len(gold) = len(found) AS exact FROM a""")
def set_metrics(spark, sf_dir):
    a = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(F.collect_set(F.col("vec_id") % 17).alias("gold"), F.collect_set(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 13)).alias("found"))
    return E.set_metrics(a).select("query_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "exact")


@query("""WITH r AS (SELECT conv_id AS query_id, turn, CASE WHEN role = 'user' THEN 1 ELSE -1 END AS v FROM conversations), p AS (SELECT query_id, avg(CASE WHEN turn = 0 THEN 0 ELSE v END) AS s FROM r GROUP BY query_id)
SELECT count(*) FILTER (WHERE s > 0) AS wins, count(*) FILTER (WHERE s < 0) AS losses, count(*) FILTER (WHERE s = 0) AS ties, round(avg(s), 9) AS mean FROM p""")
def blind_preference(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    ratings = c.select(F.col("conv_id").alias("query_id"), F.lit("left").alias("candidate_position"), F.when(F.col("turn") == 0, "tie").when(F.col("role") == "user", "left").otherwise("right").alias("preferred"))
    return E.blind_preferences(ratings).withColumn("mean", F.round("mean", 9))


@query("""SELECT label AS lane, count(*) FILTER (WHERE vec_id % 5 = 0 AND vec_id % 2 = 0) AS numeric_omissions, count(*) FILTER (WHERE vec_id % 7 = 0) AS condition_omissions, count(*) FILTER (WHERE vec_id % 11 = 0) AS revision_errors, count(*) FILTER (WHERE vec_id % 3 = 0 AND vec_id % 13 = 0) AS no_answer_false_positives FROM embeddings GROUP BY label""")
def critical_error_counts(spark, sf_dir):
    v = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("lane"), (v % 5 == 0).alias("high_risk"), (v % 2 == 0).alias("numeric_omitted"), (v % 7 == 0).alias("condition_omitted"), (v % 11 == 0).alias("revision_wrong"), (v % 3 == 0).alias("answered"), (v % 13 == 0).alias("no_answer"))
    return E.critical_errors(rows)


@query("""WITH g AS (SELECT label AS query_id, vec_id % 4 AS grp, vec_id AS span FROM embeddings), s AS (SELECT label AS query_id, vec_id AS span, row_number() OVER (PARTITION BY label ORDER BY vec_id % 10, vec_id) AS rank FROM embeddings),
x AS (SELECT g.query_id, grp, bool_and(coalesce(rank <= 40, false)) AS ok FROM g LEFT JOIN s USING (query_id, span) GROUP BY ALL) SELECT query_id, round(avg(ok::INT), 9) AS co_retrieval FROM x GROUP BY query_id""")
def condition_co_retrieval(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    groups = e.select(F.col("label").alias("query_id"), (F.col("vec_id") % 4).alias("group"), F.lit(40).alias("at_k"), F.col("vec_id").alias("span"))
    w = Window.partitionBy("label").orderBy(F.col("vec_id") % 10, "vec_id")
    spans = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("span"), F.row_number().over(w).alias("rank"))
    return E.co_retrieval(groups, spans).withColumn("co_retrieval", F.round("co_retrieval", 9))


@query(MATRIX + ", w AS (SELECT * FROM m WHERE NOT (revision % 4 = 1 AND view_type = 'CONTRACT') AND NOT (revision % 4 = 2 AND view_type <> 'CONTRACT')) SELECT revision, count(*) FILTER (WHERE view_type = 'CONTRACT') AS contracts, count(*) FILTER (WHERE view_type <> 'CONTRACT') AS children FROM w GROUP BY revision HAVING contracts <> 1 OR children < 1")
def check_aggregation_shape(spark, sf_dir):
    """Some revisions are made to lack their contract row, some all their children."""
    kept = "NOT (revision % 4 = 1 AND view_type = 'CONTRACT') AND NOT (revision % 4 = 2 AND view_type <> 'CONTRACT')"
    return V.wrong_aggregation_shape(matrix(spark, sf_dir).where(kept))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 20 IN (3, 4, 5, 6)")
def check_vectors(spark, sf_dir):
    """Some vectors are made too long, too short, not finite or null; all others have norm 1."""
    v, k = F.col("embedding"), F.col("vec_id") % 20
    made = F.when(k == 3, F.transform(v, lambda x: x * F.lit(1.001).cast("float"))).when(k == 4, F.slice(v, 1, 63)).when(k == 5, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).when(k != 6, v)
    return V.wrong_vectors(read(spark, sf_dir, "embeddings").withColumn("embedding", made), 64).select("vec_id")


@query("SELECT vec_id, vec_id + 1 AS row_index FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p, count(*) OVER () AS n FROM embeddings) WHERE p > n // 2")
def check_row_index(spark, sf_dir):
    """Row numbers are made to leave one out in the middle, so those after it are wrong."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    at = global_rank(e, ["vec_id"], "p").crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))  # one row
    rows = at.select("vec_id", (F.col("vec_id") + F.when(F.col("p") > F.floor(F.col("n") / 2), 1).otherwise(0)).alias("row_index"))
    return V.wrong_ordinals(rows, [], "row_index")


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def cache_misses(spark, sf_dir):
    from quillon.sources.snapshot import cache_misses as misses

    return misses(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("SELECT doc_id, sha256('seed' || chr(31) || source || chr(31) || doc_id) AS key FROM documents ORDER BY key LIMIT 100")
def stable_sample(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.stable_rank("seed", F.col("source"), F.col("doc_id")).alias("key")).orderBy("key").limit(100)


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_score FROM embeddings")
def native_dot(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(dot("embedding", "embedding"), 6).alias("self_score"))


@query("""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, sha256('draft' || chr(31) || source || chr(31) || doc_id)) AS k FROM documents WHERE lang IN ('en', 'de', 'fr', 'es'))
SELECT source AS issuer, lang AS slice, doc_id AS id, doc_id AS contract FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY k, list_position(['en', 'de', 'fr', 'es'], lang)) <= 4""")
def gold_draft(spark, sf_dir):
    """Stratified draft of gold questions from the documents: sources as issuers, languages as slices."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("issuer"), F.col("doc_id").alias("id"), F.col("doc_id").alias("contract"), F.array("lang").alias("slices"), F.col("n_chars").cast("double").alias("slice_score"))
    return spark.createDataFrame(E.stratified_draft(rows, "draft", 4, ["en", "de", "fr", "es"]), "issuer string, slice string, id long, contract long")


# Searches of the whole query set: (query, revision) stands where the operators expect a revision.


def _of_query(name: str):
    return F.concat_ws("/", "query_id", name)


def _split(df: DataFrame, name: str, kind: str) -> DataFrame:
    parts = F.split(name, "/")
    return df.withColumns({"query_id": parts[0].cast("long"), name: parts[1].cast(kind)})


LANE_KEY, NODE_KEY = ("revision", "node", "view_type"), ("revision", "node")


def asked_lanes(spark, sf_dir, together=LANE_KEY, keep=None):
    """(query_id, revision, node, view_type, score, row_index): the best row of each lane for every query, of the lanes that ``keep`` leaves.

    A lane's rows are in one block, so lanes are done where they are scored and no pair is shuffled for them."""

    def lanes(rows):
        best, more = group_best(rows, list(LANE_KEY)), keep and keep(rows)
        if more is None:
            return best

        def mask(s):
            top = best(s)
            return top & more(np.where(top, s, -np.inf))

        return mask

    order = tuple(dict.fromkeys((*together, *LANE_KEY)))
    return score_pairs(matrix(spark, sf_dir), asked_of(spark, sf_dir), "row_index", places=6, together=together, order=order, keep=lanes)


def _each(rows, keys, masks):
    """For rows in the order of ``keys``: a mask put together from those of their groups."""
    cuts = [*starts(rows, keys).tolist(), len(rows)]
    made = [(a, z, masks(rows.slice(a, z - a))) for a, z in zip(cuts, cuts[1:], strict=False)]

    def keep(s):
        out = np.zeros(s.shape, bool)
        for a, z, mask in made:
            out[a:z] = mask(s[a:z])
        return out

    return keep


def best_of_nodes(k):
    """The best lane of each of a revision's k best nodes."""

    def of_revision(rows):
        one = group_best(rows, ["node"])

        def mask(s):
            top = one(s)
            return top & best_rows(np.where(top, s, -np.inf), k)

        return mask

    return lambda rows: _each(rows, ["revision"], of_revision)


def decisive(rows):
    """Of a revision, the three best child lanes and two contract lanes: all that a document's score by any policy, or its error, can come from."""

    def of_revision(some):
        contract = np.array(some["view_type"].to_pylist()) == "CONTRACT"
        first = np.argsort(some["row_index"].to_numpy(), kind="stable")

        def mask(s):
            out = np.zeros(s.shape, bool)
            for mine, k in ((~contract, 3), (contract, 2)):
                at = first[mine[first]]  # of equal ones the least row_index
                if len(at):
                    out[at] = best_rows(s[at], k)
            return out

        return mask

    return _each(rows, ["revision"], of_revision)


ASKED_LANE = f"""
WITH b AS (SELECT vec_id AS row_index, label AS revision, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
m AS (SELECT row_index, revision, embedding, CASE WHEN r = 0 THEN 'n0' ELSE 'n' || ((r - 1) // 5 + 1) END AS node,
      CASE WHEN r = 0 THEN 'CONTRACT' ELSE (['TITLE','RAW_ITEM','CONTEXTUAL_ITEM','DETAIL','MAJOR_SECTION'])[(r - 1) % 5 + 1] END AS view_type FROM b),
s AS (SELECT query_id, row_index, revision, node, view_type, round(list_inner_product(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM m, (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id {ASKED}) q),
l AS (SELECT query_id, revision, node, view_type, max(score) AS score, arg_min(row_index, (-score, row_index)) AS row_index FROM s GROUP BY ALL)
"""


@query(ASKED_LANE + "SELECT query_id, row_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_index)::INTEGER AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_index) <= 20")
def asked_dense_topk(spark, sf_dir):
    """The 20 best rows of every hundredth row's vector; blocks keep what can be among them."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    got = score_pairs(rows, asked_of(spark, sf_dir), "row_index", best=20, places=6)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_index"))
    return got.withColumn("rank", nth).where(F.col("rank") <= 20).select("query_id", "row_index", "score", "rank")


@query(ASKED_LANE + "SELECT query_id, revision, node, view_type, score, row_index FROM l")
def asked_lane_max(spark, sf_dir):
    return asked_lanes(spark, sf_dir).select("query_id", "revision", "node", "view_type", "score", "row_index")


@query(ASKED_LANE + """, d AS (SELECT query_id, revision, max(score) FILTER (WHERE view_type <> 'CONTRACT') AS max_child, list_avg(list_slice(list(score ORDER BY score DESC) FILTER (WHERE view_type <> 'CONTRACT'), 1, 3)) AS top3_mean,
  0.5 * max(score) FILTER (WHERE view_type = 'CONTRACT') + 0.5 * max(score) FILTER (WHERE view_type <> 'CONTRACT') AS contract_plus_child FROM l GROUP BY query_id, revision),
p AS (SELECT query_id, revision, 'max_child' AS policy, round(max_child, 8) AS score FROM d UNION ALL SELECT query_id, revision, 'top3_mean', round(top3_mean, 8) FROM d UNION ALL SELECT query_id, revision, 'contract_plus_child', round(contract_plus_child, 8) FROM d)
SELECT *, row_number() OVER (PARTITION BY query_id, policy ORDER BY score DESC, revision)::INTEGER AS rank FROM p""")
def asked_documents(spark, sf_dir):
    """Documents of every query by each policy, ranked."""
    lanes = held(asked_lanes(spark, sf_dir, keep=decisive).withColumn("revision", _of_query("revision")).drop("query_id"))
    parts = [R.document_scores(lanes, p).select("revision", F.lit(p).alias("policy"), F.round("score", 8).alias("score")) for p in R.POLICIES]
    every = _split(parts[0].unionByName(parts[1]).unionByName(parts[2]), "revision", "int")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "policy").orderBy(F.desc("score"), "revision")))


@query(ASKED_LANE + """, n AS (SELECT query_id, revision, node, max(score) AS score FROM l GROUP BY ALL)
SELECT query_id, revision, node, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, revision ORDER BY score DESC, node)::INTEGER AS rank FROM n) WHERE rank <= 8""")
def asked_top_nodes(spark, sf_dir):
    lanes = asked_lanes(spark, sf_dir, NODE_KEY, best_of_nodes(8)).withColumn("revision", _of_query("revision"))
    top = R.top_nodes(R.node_scores(lanes))
    return _split(top.select("revision", "node", "score", "rank"), "revision", "int")


@query(ASKED_WORDS + f""", x AS (SELECT q.query_id, c.id, round(sum(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, count(*) AS held
FROM q JOIN c ON c.token = q.token JOIN df ON df.token = q.token, g GROUP BY q.query_id, c.id),
lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM x JOIN nq USING (query_id) WHERE held = n_words QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 100),
ds AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id {ASKED}),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ds QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 100)
SELECT query_id, id, dense.rank AS dense_rank, lex.rank AS lexical_rank, round(coalesce(1.0 / (60 + dense.rank), 0) + coalesce(1.0 / (60 + lex.rank), 0), 9) AS score FROM dense FULL JOIN lex USING (query_id, id)""")
def asked_fusion(spark, sf_dir):
    """Every hundredth row asks with its vector, and the document of its id with its first and last word; both lists of 100 are fused."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    dense = score_pairs(rows, asked_of(spark, sf_dir), "id", best=100, places=6)
    dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= 100)
    words = X.all_tokens(F.col("text"))
    asked = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("w")).where(F.size("w") > 0).select("query_id", F.array(F.col("w")[0], F.element_at("w", -1)).alias("words"))
    lists = [d.select(_of_query("id").alias("id"), "rank") for d in (dense, indexed(spark, sf_dir).search(asked, 100, places=6))]
    return _split(R.fused_ranks(*lists).withColumn("score", F.round("score", 9)), "id", "long")
