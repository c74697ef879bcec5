"""Queries of listings, coverage, packing, summaries and storage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import catalog as C
from quillon.operators import packing, summary
from quillon.operators import structure as S
from quillon.operators import validation as V
from quillon.operators.ordering import global_rank
from quillon.plans.registry import query, read
from quillon.plans.relational_queries import REV, revisions
from quillon.plans.retrieval_queries import DENSE, dense_ranks
from quillon.plans.structure_queries import BENEFIT, CHUNKS, LINES, NOTICE, PARSED, rendered
from quillon.sources.files import put_once

DENSE_50 = "WITH " + DENSE.strip().removeprefix(",").replace("LIMIT 100", "LIMIT 50") + ", d AS (FROM dense) "


@query(REV + "SELECT lineage, revision, effective_date, c_name AS name FROM rev JOIN customer ON c_custkey = lineage WHERE temporal_status = 'current'")
def current_products(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lineage"), F.col("c_name").alias("name"))
    return C.current_products(revisions(spark, sf_dir), names).select("lineage", "revision", "effective_date", "name")


@query(REV + "SELECT lineage, revision, effective_date, temporal_status, row_number() OVER (PARTITION BY lineage ORDER BY CASE temporal_status WHEN 'current' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, effective_date DESC NULLS LAST, revision)::INTEGER AS rank FROM rev")
def product_revisions(spark, sf_dir):
    return C.revision_ranks(revisions(spark, sf_dir)).select("lineage", "revision", "effective_date", "temporal_status", "rank")


@query("SELECT conv_id AS document, 't' || turn AS node FROM conversations WHERE role = 'user'")
def section_filter(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    nodes = c.select(F.col("conv_id").alias("document"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node"), F.lit("ITEM").alias("node_type"), F.when(F.col("role") == "user", "BENEFIT").otherwise("NOTICE").alias("major_class"))
    return C.section_filter(nodes, "Benefit").select("document", "node")


@query("SELECT source, doc_id, n_chars FROM documents WHERE (source, doc_id) >= ('src3', 43) ORDER BY source, doc_id LIMIT 6")
def adjacent_evidence(spark, sf_dir):
    return C.following(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source", "doc_id"], ["src3", 43], 5)[0]


@query("SELECT source, count(*) AS documents, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS characters, sha256(string_agg(regexp_replace(text, '\\s', '', 'g'), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source")
def source_coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pages = d.select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return V.source_coverage(pages).withColumnRenamed("document", "source").join(n, "source").select("source", "documents", F.col("characters").cast("long").alias("characters"), "sha256")


@query("SELECT o_orderkey, o_totalprice, l.n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def strict_zip(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return V.zipped(o.join(n.select("o_orderkey"), "o_orderkey", "left_semi"), n, "o_orderkey")


@query("""SELECT round(min(c), 6) AS least, round(avg(c), 6) AS mean, min(c) >= 0.5 AS passed FROM (SELECT greatest(-1, least(1, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def provider_preflight(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return V.preflight(pairs, 0.5).select(F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), "passed")


@query(DENSE_50 + "SELECT id, round(CASE WHEN id % 7 = 0 THEN score + 0.001 ELSE score END, 6) AS score, (CASE WHEN id % 5 = 0 THEN rank + 1 ELSE rank END)::INTEGER AS rank FROM d WHERE id % 7 = 0 OR id % 5 = 0")
def rank_revalidation(spark, sf_dir):
    """A captured ranking some of whose scores and ranks were altered, against a new computation."""
    got = dense_ranks(spark, sf_dir, 0, 50)
    score = F.when(F.col("id") % 7 == 0, F.col("score") + 0.001).otherwise(F.col("score"))
    captured = got.select("id", F.round(score, 6).alias("score"), (F.col("rank") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("rank"))
    return V.wrong_scores(captured, dense_ranks(spark, sf_dir, 0, None))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS source, CASE WHEN conv_id % 4 = 1 THEN n - 1 ELSE n END AS pages, CASE WHEN conv_id % 4 = 1 THEN n - 1 ELSE n END AS "rows" FROM c WHERE conv_id % 4 = 2 OR conv_id % 4 = 1 AND n > 1""")
def check_listing_pages(spark, sf_dir):
    """Some listings lack their first page, some state a row more than they have."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    k = F.col("conv_id") % 4
    pages = c.withColumn("n", F.count(F.lit(1)).over(w)).select("conv_id", F.col("conv_id").cast("string").alias("source"), F.row_number().over(w.orderBy("turn")).alias("page"), F.col("n").alias("pages_total"), (F.col("n") + F.when(k == 2, 1).otherwise(0)).alias("rows_total"), F.lit(1).alias("n_rows"))
    return V.wrong_listing_pages(pages.where((k != 1) | (F.col("page") > 1)))


@query("WITH RECURSIVE " + LINES.strip().removeprefix("WITH ") + ", src AS (SELECT (document, page) AS id, text FROM pt)," + CHUNKS + """SELECT (row_number() OVER (ORDER BY id, chunk) - 1)::INTEGER AS row_index, id[1] AS document, id[2] AS page, start, "end" FROM ch""")
def page_window_corpus(spark, sf_dir):
    """Chunks of every rendered page with contiguous row numbers."""
    rows = rendered(spark, sf_dir).select("document", "page", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "c"))
    at = global_rank(rows, ["document", "page", "chunk"])
    return at.select((F.col("rank") - 1).cast("int").alias("row_index"), "document", "page", "c.start", "c.end")


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\\D*'), regexp_extract(p_brand, '\\d+')::INTEGER, p_partkey)::INTEGER AS rank FROM part")
def version_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return global_rank(rows.withColumn("key", X.version_key(F.col("p_brand"))), ["key", "p_partkey"]).select("p_partkey", "p_brand", F.col("rank").cast("int").alias("rank"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT DISTINCT sha256(text) AS digest FROM documents")
def content_addressed_put(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(X.sha256(F.col("text")).alias("digest"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    held = d.where("doc_id % 3 = 0").select("digest", "content").dropDuplicates(["digest"])
    return put_once(held, d.select("digest", "content")).select("digest")


@query(LINES + "SELECT document, sum(length(visible) + 1)::BIGINT AS characters FROM li GROUP BY document")
def map_units_cover_all(spark, sf_dir):
    """Units of at most 1500 characters; together they hold every character once."""
    p = S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE).select("document", F.col("section").cast("string").alias("section"), F.col("seq").alias("position"), F.col("line").alias("text"))
    return packing.map_units(p, 1500).groupBy("document").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("characters"))


@query(PARSED.replace("WITH pg", "WITH RECURSIVE pg", 1) + """, w AS (SELECT document, section, seq, length(visible) + 1 AS n, sum(length(visible) + 1) OVER (PARTITION BY document) AS whole FROM ps),
c AS (SELECT document, section, seq, whole, (1500 * i)::INTEGER AS a, least(n, 1500 * i + 1500)::INTEGER AS b FROM (SELECT *, unnest(range(0, (n + 1499) // 1500)) AS i FROM w)),
o AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY seq, a) AS k FROM c WHERE whole > 1500),
u AS (SELECT document, section, seq, a, b, k, 0 AS unit, b - a AS total FROM o WHERE k = 1
UNION ALL SELECT o.document, o.section, o.seq, o.a, o.b, o.k, CASE WHEN o.section <> u.section OR u.total + o.b - o.a > 1500 THEN u.unit + 1 ELSE u.unit END, CASE WHEN o.section <> u.section OR u.total + o.b - o.a > 1500 THEN o.b - o.a ELSE u.total + o.b - o.a END FROM u JOIN o ON o.document = u.document AND o.k = u.k + 1)
SELECT document, unit, section::VARCHAR AS scope, seq::BIGINT AS position, a AS start, b AS "end" FROM u UNION ALL SELECT document, 0, 'document', seq, 0, n::INTEGER FROM w WHERE whole <= 1500""")
def map_units(spark, sf_dir):
    p = S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE).select("document", F.col("section").cast("string").alias("section"), F.col("seq").alias("position"), F.col("line").alias("text"))
    return packing.map_units(p, 1500)


@query("""WITH x AS (SELECT l_orderkey AS document, l_linenumber AS seq, l_quantity::BIGINT || '만원' AS q, round(l_discount * 100)::BIGINT AS d, l_orderkey % 5 AS k FROM lineitem)
SELECT document, seq, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 2 END AS part, CASE k WHEN 0 THEN 'annual_fee' WHEN 2 THEN 'condition' ELSE 'benefit' END AS field,
CASE k WHEN 0 THEN 10 WHEN 2 THEN 8 ELSE 10 END AS score, false AS heading,
CASE k WHEN 0 THEN '연회비 본인 ' || q WHEN 1 THEN '커피 ' || d || '% 할인(전월 실적 ' || q || ' 이상)' WHEN 2 THEN '전월 실적 ' || q || ' 이상' ELSE '주유 적립 | ' || d || '% 할인' END AS text FROM x WHERE k <> 4
UNION ALL SELECT document, seq, 0, 'condition', 8, false, '전월 실적 ' || q || ' 이상' FROM x WHERE k = 1
UNION ALL SELECT document, seq, 1, 'benefit', 0, true, '주유 적립' FROM x WHERE k = 3
UNION ALL SELECT document, seq, 3, 'condition', 8, false, '월 ' || q || ' 한도' FROM x WHERE k = 3""")
def summary_candidates(spark, sf_dir):
    """Line items as lines of documents: fees, offers with a condition, conditions, table rows with column roles, and examples, which are none."""
    li = read(spark, sf_dir, "lineitem")
    k, q = F.col("l_orderkey") % 5, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("만원"))
    rate = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("% 할인"))
    cells = F.when(k == 3, F.array(F.lit("주유 적립"), rate, F.concat(F.lit("월 "), q, F.lit(" 한도"))))
    line = F.when(k == 0, F.concat(F.lit("연회비 본인 "), q)).when(k == 1, F.concat(F.lit("커피 "), rate, F.lit("(전월 실적 "), q, F.lit(" 이상)"))).when(k == 2, F.concat(F.lit("전월  실적 "), q, F.lit(" 이상"))).when(k == 4, F.concat(F.lit("[예시] 커피 "), rate))
    text = F.coalesce(line, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")))
    rows = li.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("seq"), F.col("l_linenumber").alias("item"), F.when(k == 3, "TABLE_ROW").otherwise("PARAGRAPH").alias("node_type"), text.alias("text"), F.lit("").alias("context"), cells.alias("cells"), F.when(k == 3, F.array(F.lit("대상"), F.lit("혜택"), F.lit("한도"))).alias("headers"))
    return summary.candidates(rows)


_STATED = f"""WITH x AS (
SELECT l_orderkey AS document, l_linenumber AS seq, trim(
  CASE l_linenumber % 4 WHEN 0 THEN '연회비 본인' WHEN 1 THEN '연회비 가족' WHEN 2 THEN '커피' ELSE '주유' END
  || CASE WHEN l_suppkey % 7 < 2 THEN ' ' || l_quantity::BIGINT || '만원' WHEN l_suppkey % 7 = 2 THEN ' 라운지 이용' ELSE ' ' || round(l_discount * 100)::BIGINT || '% 할인' END
  || CASE l_returnflag WHEN 'A' THEN ' 제외' WHEN 'R' THEN '' ELSE ' (전월 실적 ' || l_quantity::BIGINT || '만원 이상)' END
  || CASE l_quantity::BIGINT % 5 WHEN 0 THEN ', 월 ' || l_linenumber || '회' WHEN 1 THEN ' 조건 없이' WHEN 2 THEN ' 바우처 신청' WHEN 3 THEN ' 연체 시' ELSE '' END) AS text FROM lineitem
), v AS (SELECT *, regexp_replace(text, '{summary.EXEMPTION}', '', 'g') AS rest, regexp_replace(text, '\\([^()]*\\)', ' ', 'g') AS main FROM x
), f AS (SELECT *, contains(text, '연회비') AS fee, regexp_matches(text, '{summary.AMOUNT}') AS amount, regexp_matches(text, '{summary.BENEFIT}') AS words, regexp_matches(text, '\\d+(?:\\.\\d+)?\\s*%|무료\\s*(?:제공|이용)') AS rated,
  (regexp_matches(text, '{{rate}}') OR regexp_matches(text, '{{sum}}')) AND NOT regexp_matches(text, '{{procedure}}') AS concrete, regexp_matches(text, '{{cap_line}}') AS cap_line, regexp_matches(text, '{{cap_words}}') AS cap_words,
  regexp_matches(main, '{summary.NEGATED}') AND NOT regexp_matches(regexp_replace(main, '{summary.NEGATED}', '', 'g'), '{summary.BENEFIT}') OR regexp_matches(text, '{{not_given}}') OR regexp_matches(text, '{{no_offer}}') AS void,
  regexp_matches(rest, '{summary.CONDITION}') OR contains(rest, '조건') AS left_over, regexp_matches(text, '{summary.EXEMPTION}') AS exempt,
  list_distinct(regexp_extract_all(text, '{summary.QUALIFIER}') || regexp_extract_all(text, '{summary.EXEMPTION}') || list_filter(regexp_extract_all(text, '\\(([^()]*)\\)', 1), lambda y: regexp_matches(y, '{summary.CONDITION}|한함|해당'))) AS within FROM v
), o AS (SELECT *, words AND concrete AND NOT (rated IS FALSE AND (cap_words OR cap_line)) AND NOT void AS offer, left_over OR cap_line AND NOT rated OR void AND regexp_matches(text, '{{denied}}') AS bound FROM f)
SELECT document, seq, 0 AS part, 'annual_fee' AS field, (CASE WHEN contains(text, '본인') THEN 10 ELSE 5 END - CASE WHEN contains(text, '가족') AND NOT contains(text, '본인') THEN 5 ELSE 0 END)::INTEGER AS score, false AS heading, text FROM o WHERE fee AND amount AND NOT regexp_matches(text, '{summary.FEE_BAD}')
UNION ALL SELECT document, seq, 0, 'benefit', 10, false, text FROM o WHERE NOT fee AND offer
UNION ALL SELECT document, seq, 0, 'condition', CASE WHEN len(within) > 0 OR exempt OR regexp_matches(t, '{summary.STRONG_TERM}') THEN 8 ELSE 1 END, false, t FROM (SELECT *, unnest(CASE WHEN offer THEN within ELSE [text] END) AS t FROM o WHERE NOT fee AND (bound OR exempt AND NOT offer))"""
for _name, _, _pattern in summary.SIGNALS:
    _STATED = _STATED.replace("{" + _name + "}", _pattern)


@query(_STATED)
def summary_fields(spark, sf_dir):
    """Line items as lines put together from a name, an amount, an exclusion and a term that do not depend on each other; the SQL finds the facts in the text."""
    q, linenumber = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    pick = lambda on, *texts: F.element_at(F.array(*(t if not isinstance(t, str) else F.lit(t) for t in texts)), (on + 1).cast("int"))
    name = pick(linenumber % 4, "연회비 본인", "연회비 가족", "커피", "주유")
    rate = F.concat(F.lit(" "), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("% 할인"))
    amount = F.when(F.col("l_suppkey") % 7 < 2, F.concat(F.lit(" "), q.cast("string"), F.lit("만원"))).when(F.col("l_suppkey") % 7 == 2, " 라운지 이용").otherwise(rate)
    kept = F.when(F.col("l_returnflag") == "A", " 제외").when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit(" (전월 실적 "), q.cast("string"), F.lit("만원 이상)")))
    term = pick(q % 5, F.concat(F.lit(", 월 "), linenumber.cast("string"), F.lit("회")), " 조건 없이", " 바우처 신청", " 연체 시", "")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), linenumber.alias("seq"), linenumber.alias("item"), F.lit("PARAGRAPH").alias("node_type"), F.trim(F.concat(name, amount, kept, term)).alias("text"), F.lit("").alias("context"))
    return summary.candidates(rows)
