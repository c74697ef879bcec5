"""Composite requests and the remaining checks over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import catalog as C
from quillon.operators import evaluation as E
from quillon.operators import retrieval as R
from quillon.operators import structure as S
from quillon.operators import validation as V
from quillon.plans import search
from quillon.plans.registry import held, query, read
from quillon.plans.relational_queries import PROD, products
from quillon.plans.retrieval_queries import BM25, DOC, LANE, MATRIX, RUN, WORDS_AND, dense_ranks, matrix, scores, small_ranks, vectors_of
from quillon.plans.structure_queries import BENEFIT, NOTICE, SEQ, rendered, turns
from quillon.sources.files import pack_blob, unpack_blob
from quillon.sources.snapshot import Snapshot, unfinished


def snap(spark, sf_dir):
    """A snapshot of the stand-in matrix; labels are revisions of lineages of the same name, all current."""
    m = matrix(spark, sf_dir).withColumn("display_text", F.concat_ws(" ", "node", "view_type"))
    r = m.select("revision").distinct().select("revision", F.col("revision").cast("string").alias("lineage"), F.lit("current").alias("temporal_status"), F.lit("2024-01-01").cast("date").alias("effective_date"), F.lit(None).cast("int").alias("supersedes"), F.lit("kb").alias("issuer"), F.concat(F.lit("label "), F.col("revision").cast("string")).alias("name"), F.lit("2024-01-01").cast("date").alias("launch_date"), F.lit("confirmed").alias("launch_status"))
    return Snapshot("stand-in", {"matrix": m, "revisions": r})


def request(spark, sf_dir, **more):
    (_, v), = vectors_of(spark, sf_dir, [0])
    return search.ContractSearch("n1 title", tuple(v), limit=5, **more)


# unrounded row scores: the composite plan rounds only its result
RAW = LANE.replace("round(list_inner_product(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score", "list_inner_product(m.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score")


@query(RAW + ", d AS (SELECT revision, max(score) FILTER (WHERE view_type <> 'CONTRACT') AS s FROM l GROUP BY revision) SELECT revision, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, revision)::INTEGER AS rank FROM d ORDER BY s DESC, revision LIMIT 5")
def search_contracts(spark, sf_dir):
    return search.search_contracts(snap(spark, sf_dir), request(spark, sf_dir))["contracts"].withColumn("score", F.round("score", 6))


@query(RAW + """, d AS (SELECT revision FROM (SELECT revision, max(score) FILTER (WHERE view_type <> 'CONTRACT') AS s FROM l GROUP BY revision) ORDER BY s DESC, revision LIMIT 5), n AS (SELECT revision, node, max(score) AS s FROM l WHERE revision IN (FROM d) GROUP BY ALL)
SELECT revision, node, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY revision ORDER BY s DESC, node)::INTEGER AS rank FROM n) WHERE rank <= 8""")
def search_contract_nodes(spark, sf_dir):
    got = search.search_contracts(snap(spark, sf_dir), request(spark, sf_dir))["nodes"]
    return got.select("revision", "node", F.round("score", 6).alias("score"), "rank")


@query(RAW + """, d AS (SELECT revision FROM (SELECT revision, max(score) FILTER (WHERE view_type <> 'CONTRACT') AS s FROM l GROUP BY revision) ORDER BY s DESC, revision LIMIT 5), n AS (SELECT revision, node, max(score) AS s FROM l WHERE revision IN (FROM d) GROUP BY ALL),
t AS (SELECT revision, node FROM (SELECT *, row_number() OVER (PARTITION BY revision ORDER BY s DESC, node) AS k FROM n) WHERE k <= 8), x AS (SELECT DISTINCT revision, node FROM m WHERE revision IN (FROM d) AND (node = 'n1' OR view_type = 'TITLE'))
SELECT * FROM x EXCEPT SELECT * FROM t""")
def search_lexical_audit(spark, sf_dir):
    return search.search_contracts(snap(spark, sf_dir), request(spark, sf_dir))["lexical"]


@query(RAW + ", d AS (SELECT revision, max(score) FILTER (WHERE view_type <> 'CONTRACT') AS s FROM l GROUP BY revision) SELECT revision, round(s, 6) AS score FROM d WHERE revision NOT IN (0, 1) ORDER BY revision LIMIT 4")
def exhaustive_audit_step(spark, sf_dir):
    done = spark.createDataFrame([(0,), (1,)], "revision int")
    return search.audit(snap(spark, sf_dir), request(spark, sf_dir), done, 4).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT label AS revision FROM embeddings WHERE label % 3 <> 0")
def resume_by_shards(spark, sf_dir):
    r = matrix(spark, sf_dir).select("revision").distinct()
    return unfinished(r, r.where("revision % 3 = 0"), "revision")


@query(BM25.replace("round(greatest", "(greatest").replace(", 6) AS score FROM c, g", ") AS score FROM c, g") + """, den AS (SELECT d.doc_id AS id, row_number() OVER (ORDER BY list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) DESC, d.doc_id)::INTEGER AS rank
FROM documents d JOIN embeddings c ON c.vec_id = d.doc_id % (SELECT count(*) FROM embeddings), (SELECT embedding FROM embeddings WHERE vec_id = 1) q),
l2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM x), f AS (SELECT id, coalesce(1.0 / (60 + den.rank), 0) + coalesce(1.0 / (60 + l2.rank), 0) AS s FROM (FROM den WHERE rank <= 20) den FULL JOIN (FROM l2 WHERE rank <= 20) l2 USING (id))
SELECT id, round(s, 9) AS score FROM f ORDER BY s DESC, id LIMIT 20""")
def search_evidence(spark, sf_dir):
    """Every document takes part: its vector is that of its id modulo the number of vectors."""
    e = read(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    docs = read(spark, sf_dir, "documents").crossJoin(F.broadcast(n))  # one row
    rows = docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % F.col("n")).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").select("id", "text", "embedding")
    (_, v), = vectors_of(spark, sf_dir, [1])
    return search.search_evidence(rows, WORDS_AND, v, 20).select("id", F.round("score", 9).alias("score"))


@query("""WITH s AS (SELECT c.vec_id AS id, round(list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS a, c.vec_id % 7 + c.vec_id / 1000000.0 AS b FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
r AS (SELECT id, row_number() OVER (ORDER BY a DESC, id)::INTEGER AS rank, b FROM s) SELECT id, rank, row_number() OVER (ORDER BY b DESC, id)::INTEGER AS shadow_rank FROM r WHERE rank <= 30""")
def shadow_rerank(spark, sf_dir):
    shadow = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7 + F.col("vec_id") / 1000000.0).alias("score"))
    return search.shadow_rerank(dense_ranks(spark, sf_dir, 0, None), shadow, 30).select("id", "rank", "shadow_rank")


@query(MATRIX + DOC.format(agg="max(score) FILTER (WHERE view_type <> 'CONTRACT')").replace("FROM l GROUP", "FROM s GROUP"))
def offline_accumulator(spark, sf_dir):
    return small_ranks(R.ranked(R.document_scores(scores(spark, sf_dir), "max_child").withColumn("score", F.round("score", 8)), "revision"))


@query(PROD + """SELECT 0 AS position, lineage FROM p WHERE product_code = 'p7' UNION ALL SELECT 1, NULL UNION ALL SELECT 2, lineage FROM p WHERE product_code = 'p12'""")
def product_pick(spark, sf_dir):
    return C.pick([("p7", None), ("none", None), ("p12", None)], products(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE vec_id % 2 = 1 AND vec_id % 3 = 0) AS false_refusals, count(*) FILTER (WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0) AS missed_refusals, round(avg((vec_id % 5 > 0)::INT), 12) AS revision_accuracy FROM embeddings")
def answer_errors(spark, sf_dir):
    v = F.col("vec_id")
    return E.answer_errors(read(spark, sf_dir, "embeddings").select((v % 2 == 0).alias("should_refuse"), (v % 3 == 0).alias("refused"), (v % 5 > 0).alias("revision_right")))


@query("SELECT vec_id, 256 AS n_bytes, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def legacy_blobs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", pack_blob("embedding").alias("blob"))
    return e.select("vec_id", F.octet_length("blob").alias("n_bytes"), F.round(unpack_blob("blob")[0].cast("double"), 5).alias("first"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def check_ids(spark, sf_dir):
    """Every seventh id is made from another name."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("issuer"))
    name = F.when(F.col("c_custkey") % 7 == 3, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    c = c.withColumn("id", X.identity("lineage", issuer=F.col("issuer"), c_name=name))
    return V.wrong_ids(c, "id", "lineage", ["issuer", "c_name"]).select("c_custkey")


@query(SEQ + "SELECT document, 'l' || seq AS node FROM sq WHERE seq % 10 = 7")
def check_display(spark, sf_dir):
    """Every tenth line's node has a letter more than its spans."""
    pages = rendered(spark, sf_dir)
    p = held(S.parse(pages, BENEFIT, NOTICE))
    node = F.concat(F.lit("l"), F.col("seq").cast("string"))
    spans = p.select("document", node.alias("node"), "page", "start", "end", F.lit(0).alias("span_ordinal"))
    text = F.when(F.col("seq") % 10 == 7, F.concat("line", F.lit("x"))).otherwise(F.col("line"))
    return V.wrong_display(p.select("document", node.alias("node"), text.alias("text")), spans, pages)


@query("SELECT o_orderkey AS revision FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'P'")
def check_launch_evidence(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    revisions = o.select(F.col("o_orderkey").alias("revision"), day.alias("launch_date"), F.when(day.isNull(), "missing").otherwise("confirmed").alias("launch_status"))
    evidence = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("revision"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("normalized_value"))
    return V.wrong_launch_evidence(revisions, evidence)


@query(MATRIX + "SELECT DISTINCT revision FROM m WHERE revision % 3 = 1")
def check_views_present(spark, sf_dir):
    """A third of the revisions are made to lack their contract view."""
    m = matrix(spark, sf_dir)
    return V.missing(m.select("revision"), m.where("view_type = 'CONTRACT' AND revision % 3 <> 1"), ["revision"])


@query(MATRIX + ", w AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE row_index % 9 = 4) SELECT revision, node, view_type, count(*) AS n FROM w GROUP BY ALL HAVING n > 1")
def check_duplicate_views(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return V.duplicate_views(m.unionByName(m.where("row_index % 9 = 4")))


@query("""WITH c AS (SELECT conv_id AS document, turn FROM conversations), s AS (SELECT document FROM c WHERE turn = 2), e AS (SELECT document, 'root' AS node FROM s UNION SELECT c.document, 't' || c.turn FROM c JOIN s USING (document) WHERE c.turn IN (1, 2, 3, 5)),
z AS (SELECT document, count(*) AS n FROM e GROUP BY document), r AS (SELECT document, sum(n) OVER (ORDER BY document ROWS UNBOUNDED PRECEDING) AS used FROM z)
SELECT e.document, e.node FROM e JOIN r USING (document) WHERE used <= 2048""")
def evidence_bundles(spark, sf_dir):
    nodes, links = turns(spark, sf_dir)
    ranked = nodes.where("node = 't2'").select(F.col("document").alias("revision"), "node", F.col("document").alias("contract_rank"))
    return search.bundles(ranked, nodes.withColumn("text", F.lit("x")), links).select("document", "node")


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT conv_id AS document, 't' || turn AS node, text FROM conversations WHERE turn >= 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def nearest_items(spark, sf_dir):
    """First turn after the opening of each conversation: a keyed argmin."""
    nodes = turns(spark, sf_dir)[0].where("node_type = 'ITEM' AND node <> 't0'")
    first = nodes.groupBy("document").agg(F.min_by(F.struct("node", "text"), F.substring("node", 2, 10).cast("int")).alias("b"))
    return first.select("document", "b.node", "b.text")


