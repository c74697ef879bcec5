"""Generations, strict files, listings, caches, rotation, sealing and product requests over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.holding import shared_folder
from quillon.operators import catalog as C
from quillon.operators import dispositions, graph
from quillon.operators import temporal as T
from quillon.operators.ordering import global_rank
from quillon.plans import resources
from quillon.plans.registry import query, read
from quillon.plans.relational_queries import PROD, products
from quillon.sources import files, ranges, snapshot
from quillon.sources.commits import CommitLog

SPELLINGS = ("BC Card", "하나-카드", "현대 카드", "ＫＢ국민카드", "lotte_card", "삼성", "Shinhan", "우리카드")
CODES = ("bc", "hana", "hyundai", "kb", "lotte", "samsung", "shinhan", "woori")


@query(f"SELECT c_custkey, ({list(SPELLINGS)})[c_nationkey % 8 + 1] AS name, ({list(CODES)})[c_nationkey % 8 + 1] AS issuer FROM customer")
def issuer_aliases(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(x) for x in SPELLINGS)), (F.col("c_nationkey") % 8 + 1).cast("int"))
    return C.issuer_codes(read(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def generation_round_trip(spark, sf_dir):
    """Published, found through the log, checked against its seal, pinned and read."""
    root = shared_folder(spark, "generations")
    published = snapshot.publish(spark, root, {"nation": read(spark, sf_dir, "nation"), "region": read(spark, sf_dir, "region")}, {"nation": ["n_nationkey"]})
    return snapshot.poll(spark, root, None).require(published)["nation"].select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderpriority, 1 + dense_rank() OVER (ORDER BY o_orderpriority) AS number, o_orderkey FROM orders")
def generations_in_order(spark, sf_dir):
    """A generation for each priority, published by several at once over a first one; the log gives each a number, and a reader that polls after each sees them in order.

    Numbers are given by arrival, so rows carry the place of their generation in the order of priorities instead; every number must have been taken once."""
    from concurrent.futures import ThreadPoolExecutor

    root, orders = shared_folder(spark, "publishers"), read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    snapshot.publish(spark, root, {"orders": orders.limit(0)})
    kinds = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # five
    with ThreadPoolExecutor(len(kinds) or 1) as pool:
        made = list(pool.map(lambda kind: snapshot.publish(spark, root, {"orders": orders.where(F.col("o_orderpriority") == kind)}), kinds))
    entries = CommitLog(spark, root).history()
    if sorted(e.number for e in entries) != list(range(len(kinds) + 1)) or {e.generation for e in entries[:-1]} != set(made) or snapshot.poll(spark, root, None).generation != entries[0].generation:
        raise ValueError("the log lost a generation")
    tables = [snapshot.load(spark, root, g)["orders"].select("o_orderpriority", F.lit(i + 2).cast("long").alias("number"), "o_orderkey") for i, g in enumerate(made)]
    return reduce(DataFrame.unionByName, tables)


@query("SELECT conv_id, turn, role, text FROM conversations")
def strict_jsonl(spark, sf_dir):
    """Written as JSON lines and read by the strict reader."""
    path = shared_folder(spark, "jsonl")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT conv_id AS source, (turn // 2 + 1)::INTEGER AS page, role, text FROM conversations WHERE length(text) > 0")
def paged_listing(spark, sf_dir):
    """Conversations as listings in pages of two records that state their count and whether more follow."""
    c = read(spark, sf_dir, "conversations")
    rows = c.where("length(text) > 0").groupBy(F.col("conv_id").alias("source"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page")).agg(F.collect_list(F.struct("role", F.concat(F.lit("."), "text", F.lit(".")).alias("text"))).alias("list"))
    last = rows.groupBy("source").agg(F.max("page").alias("last"))
    placeholder = F.array_append("list", F.struct(F.lit("-").alias("role"), F.lit("-").alias("text")))
    data = F.struct(placeholder.alias("list"), (F.size("list") + 1).alias("count"), F.when(F.col("page") < F.col("last"), "Y").otherwise("N").alias("more"))
    pages = rows.join(last, "source").select("source", "page", F.to_json(F.struct(F.lit("success").alias("result"), data.alias("data"))).alias("body"))
    got = files.read_json_pages(pages, "$.data.list", {"role": "$.role", "text": "$.text"}, "$.data.count", "$.data.more", ("$.result", "success"), {"role": "-"})
    return got.select("source", "page", "role", F.expr("substring(text, 2, length(text) - 2)").alias("text"))


@query("SELECT p_size AS id, 'p' || p_partkey AS product_code, p_name AS product_name, DATE '2024-01-01' + (p_partkey % 300)::INTEGER AS effective_date FROM part")
def table_listing(spark, sf_dir):
    """Parts as rows of HTML tables, one listing a size."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "yyyyMMdd")
    key = F.col("p_partkey").cast("string")
    row = F.concat(F.lit("<tr><td><a onclick=\"goDetail('p"), key, F.lit("')\">"), "p_name", F.lit("</a></td><td><a href='/files/"), key, F.lit("_"), day, F.lit(".pdf'>PDF</a></td></tr>"))
    html = F.concat(F.lit("<table><tr><th>name</th><th>file</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    pages = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("page_id")).agg(html.alias("html"))
    rules = files.ListingRules(link=r"(/files/\S+\.pdf)$", code=r"goDetail\('([^']+)'", day=r"_(\d{8})\.", headers=("name", "file"))
    return files.read_rows(pages, rules).select("id", "product_code", "product_name", "effective_date")


@query("""WITH e AS (SELECT user_id, min(ts::DATE) AS stored, count(*) AS n FROM events GROUP BY 1), u AS (SELECT user_id, max(ts::DATE) AS last FROM events WHERE event_type = 'view' GROUP BY 1),
g AS (SELECT user_id, stored, n, greatest(coalesce(last, stored), stored) AS last_used FROM e LEFT JOIN u USING (user_id) ORDER BY last_used DESC, user_id LIMIT 40)
SELECT user_id, stored, n, last_used FROM (SELECT *, sum(n) OVER (ORDER BY last_used DESC, user_id ROWS UNBOUNDED PRECEDING) AS used FROM g) WHERE used <= 2000""")
def recently_used(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    entries = e.groupBy("user_id").agg(F.min("day").alias("stored"), F.count(F.lit(1)).alias("n"))
    return T.recently_used(entries, e.where("event_type = 'view'").select("user_id", F.col("day").alias("used")), ["user_id"], 40, "n", 2000)


@query("""WITH o AS (SELECT 'u' || user_id AS path, count(*) AS bytes, max(ts::DATE) AS last_used FROM events WHERE NOT (user_id % 3 = 0) GROUP BY 1)
SELECT path, bytes, last_used FROM (SELECT *, sum(bytes) OVER (ORDER BY last_used DESC, path ROWS UNBOUNDED PRECEDING) AS used FROM o) WHERE used > 500""")
def cache_prune(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "user_id", F.to_date("ts").alias("day"))
    objects = e.groupBy("path").agg(F.count(F.lit(1)).alias("bytes"), F.max("day").alias("last_used"))
    return T.pruned(objects, e.where("user_id % 3 = 0").select("path"), 500)


@query("""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT ts::DATE AS day FROM events)), r AS (SELECT n_name AS issuer, row_number() OVER (ORDER BY n_name) AS t, count(*) OVER () AS n FROM nation)
SELECT day, issuer FROM d JOIN r ON (k - 1) % n + 1 = t""")
def issuer_rotation(spark, sf_dir):
    return T.rotation(read(spark, sf_dir, "nation").select(F.col("n_name").alias("issuer")), read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")))


@query("""WITH RECURSIVE c AS (SELECT conv_id AS request, turn AS rank, 31 + length(turn::VARCHAR) + length(length(text)::VARCHAR) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT request, rank, k, size + 4 <= 130 AS admitted, CASE WHEN size + 4 <= 130 THEN size + 4 ELSE 2 END AS bytes FROM c WHERE k = 1
UNION ALL SELECT c.request, c.rank, c.k, CASE WHEN s.bytes = 2 THEN c.size + 4 ELSE s.bytes + c.size + 2 END <= 130, CASE WHEN CASE WHEN s.bytes = 2 THEN c.size + 4 ELSE s.bytes + c.size + 2 END <= 130 THEN CASE WHEN s.bytes = 2 THEN c.size + 4 ELSE s.bytes + c.size + 2 END ELSE s.bytes END
 FROM s JOIN c ON c.request = s.request AND c.k = s.k + 1)
SELECT request, rank, admitted, bytes FROM s""")
def compact_seal(spark, sf_dir):
    """Turns as ranked groups of a response of at most 130 bytes."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("rank"), F.to_json(F.struct("turn", F.length("text").alias("n"))).alias("body"))
    return graph.seal(c, 130).select("request", "rank", "admitted", "bytes")


def served(spark, sf_dir):
    """Customers as a snapshot of products: every ninth is unsupported, every eleventh failed."""
    p = products(spark, sf_dir).withColumn("document_id", F.concat(F.lit("d"), F.col("lineage").cast("string"))).withColumn("temporal_status", F.lit("current")).withColumn("pdf_sha256", X.sha256("name"))
    of = lambda n: p.where(F.col("lineage") % n == 0).select("issuer", F.concat("product_code", F.lit("x")).alias("product_code"))
    issuers = read(spark, sf_dir, "nation").select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("issuer"), F.col("n_name").alias("display_name"), F.col("n_nationkey").alias("sort_order"))
    return snapshot.Snapshot("stand-in", {"revisions": p, "issuers": issuers, "unsupported": of(9), "failed": of(11)})


@query(PROD + """, s AS (SELECT lineage, issuer, product_code, name, row_number() OVER (ORDER BY launch_date DESC NULLS LAST, issuer, product_code, lineage, revision)::INTEGER AS rank FROM p WHERE contains(lower(name), '#0000000'))
SELECT * FROM s WHERE rank BETWEEN 16 AND 30""")
def find_products_page(spark, sf_dir):
    """The second page of a search by a part of the name, newest first, by the cursor of the first."""
    snap, cursors = served(spark, sf_dir), C.Cursor(b"stand-in")
    ask = lambda cursor: resources.find_products(snap, resources.FindProducts(keyword=" ＃0000000", sort="launch_date", limit=15, cursor=cursor), cursors)
    return ask(ask(None)["next_cursor"])["items"].select("lineage", "issuer", "product_code", "name", "rank")


@query(PROD + """, e AS (SELECT issuer, product_code, 'available' AS status FROM p UNION ALL SELECT issuer, product_code || 'x', CASE WHEN lineage % 9 = 0 THEN 'unsupported_drm' ELSE 'ocr_failed' END FROM p WHERE lineage % 9 = 0 OR lineage % 11 = 0)
SELECT * FROM e""")
def product_resources(spark, sf_dir):
    return resources.products(served(spark, sf_dir)).select("issuer", "product_code", "status")


@query("SELECT 'd' || c_custkey AS document_id, 'sha256/' || substr(sha256(c_name), 1, 2) || '/' || sha256(c_name) AS pdf_path FROM customer WHERE c_custkey = 7")
def document_resource(spark, sf_dir):
    return resources.document(served(spark, sf_dir), "d7").select("document_id", "pdf_path")


@query("SELECT vec_id // 1000 AS block, (count(*) * 256)::INTEGER AS n_bytes FROM embeddings GROUP BY 1")
def vector_blocks(spark, sf_dir):
    """The matrix as blocks of float32 bytes, which decode to the vectors again."""
    m = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    return files.encode_f32(m, 1000).select("block", F.octet_length("content").alias("n_bytes"))


_NUMBERED = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, embedding FROM embeddings"


@query(f"SELECT row_index, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, len(embedding)::INTEGER AS width FROM ({_NUMBERED})")
def matrix_round_trip(spark, sf_dir):
    """Vectors written as a sealed matrix of several parts, read again with every part's hash checked."""
    rows = global_rank(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "nth").select((F.col("nth") - 1).alias("row_index"), "embedding")
    path = shared_folder(spark, "matrix")
    ranges.write_matrix(rows, path, 64, unit=False)
    got = files.read_matrix(spark, path, 64, verify=True)
    return got.select("row_index", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"), F.size("embedding").alias("width"))


@query(f"SELECT row_index // 100 AS query_id, row_index % 100 AS row_index, embedding[1]::DOUBLE AS score FROM ({_NUMBERED}) WHERE row_index // 100 < (SELECT count(*) // 100 FROM embeddings)")
def score_matrix_round_trip(spark, sf_dir):
    """The first component of every vector as scores of a hundred rows a query: written, listed with a hash a segment, and read again through the list."""
    rows = global_rank(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "nth").select((F.col("nth") - 1).alias("at"), F.col("embedding")[0].alias("x"))
    segments = rows.groupBy(F.floor(F.col("at") / 100).cast("long").alias("row_index")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).where(F.size("s") == 100)
    path = shared_folder(spark, "scores")
    seal = ranges.write_matrix(segments.select("row_index", F.transform("s", lambda v: v["x"]).alias("embedding")), path, 100, unit=False)
    parts = spark.createDataFrame([(p["file"], p["first"]) for p in seal["parts"]], "file string, first long")
    found = ranges.source(spark, ranges.ByteRanges, width=400).load(path).withColumn("file", F.element_at(F.split("file", "/"), -1)).join(parts, "file")
    index = found.select((F.col("first") + (F.col("offset") / 400).cast("long")).alias("query_id"), "file", "offset", F.sha2("content", 256).alias("sha256"))
    return files.read_score_matrix(spark, path, index, 100)


def _source_json(key, name: str, blank: str = "") -> str:
    """SQL of the canonical JSON of a source; ``blank`` spoils it."""
    fields = {"category": "'cards'", "document_type": "'terms'", "effective_date": "'2024-01-01'", "file_name": f"{key} || '.pdf'", "issuer": "issuer", "product_code": key, "product_name": name, "source_post_id": "'7'", "source_url": "url", "source_version": "'v1'"}
    text = {**{k: f"'\"' || {v} || '\"'" for k, v in fields.items()}, "metadata": "'{\"n\":' || c_custkey || '}'"}
    return "'{" + blank + "' || " + " || ',' || ".join(f"'\"{k}\":' || {text[k]}" for k in sorted(text)) + " || '}'"


_REFUSED = f"""c AS (SELECT c_custkey, c_custkey % 13 AS k, c_custkey || 'p' AS code, CASE c_custkey % 13 WHEN 1 THEN 'nobody' ELSE 'kb' END AS issuer, c_name AS name, CASE c_custkey % 13 WHEN 2 THEN 'http://x/' ELSE 'https://x/' END || c_custkey AS url FROM customer),
s AS (SELECT *, CASE k WHEN 3 THEN {_source_json('code', "'another'")} WHEN 4 THEN {_source_json('code', 'name', ' ')} ELSE {_source_json('code', 'name')} END AS source FROM c),
r AS (SELECT *, 'source_' || CASE k WHEN 5 THEN repeat('0', 64) ELSE sha256(source) END AS source_id, CASE k WHEN 6 THEN 'NONE' ELSE 'SCDSA002' END AS magic, CASE k WHEN 7 THEN 0 ELSE c_custkey + 1 END AS size, sha256(code) AS digest FROM s)"""


def refused(spark, sf_dir):
    """Customers as protected products, some with planted faults by key."""
    k, key = F.col("c_custkey") % 13, F.col("c_custkey").cast("string")
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(key, F.lit("p")).alias("product_code"), F.when(k == 1, "nobody").otherwise("kb").alias("issuer"), F.col("c_name").alias("name"), F.lit(dispositions.UNSUPPORTED).alias("disposition"),
        F.lit("v1").alias("source_version"), F.concat(F.when(k == 2, "http://x/").otherwise("https://x/"), key).alias("source_url"), F.when(k == 6, "NONE").otherwise("SCDSA002").alias("protected_magic"), F.when(k == 7, 0).otherwise(F.col("c_custkey") + 1).alias("protected_size_bytes"),
    )
    said = lambda name: F.to_json(F.struct(F.lit("cards").alias("category"), F.lit("terms").alias("document_type"), F.lit("2024-01-01").alias("effective_date"), F.concat("product_code", F.lit(".pdf")).alias("file_name"), "issuer", F.struct(F.col("c_custkey").alias("n")).alias("metadata"), "product_code", name.alias("product_name"), F.lit("7").alias("source_post_id"), "source_url", "source_version"))
    plain = said(F.col("name"))
    rows = rows.withColumn("source_payload_json", F.when(k == 3, said(F.lit("another"))).when(k == 4, F.concat(F.lit("{ "), F.substr(plain, F.lit(2)))).otherwise(plain))
    return rows.withColumns({"source_id": F.concat(F.lit("source_"), F.when(k == 5, "0" * 64).otherwise(F.sha2("source_payload_json", 256))), "protected_sha256": F.sha2("product_code", 256)})


@query("""SELECT c_custkey || 'p' AS product_code, CASE WHEN c_custkey % 13 = 5 THEN CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey % 13 = 5) > 1 THEN 'source_id,repeated' ELSE 'source_id' END ELSE ['issuer', 'source_url', 'bound', 'payload', '', 'protected_magic', 'protected_size_bytes', 'active'][c_custkey % 13] END AS reasons
FROM customer WHERE c_custkey % 13 BETWEEN 1 AND 8""")
def check_dispositions(spark, sf_dir):
    """Planted: unknown issuers, other schemes, payloads of another product or not canonical, wrong ids (all alike), marks, sizes, and products that are served."""
    rows = refused(spark, sf_dir)
    active = rows.where("c_custkey % 13 = 8").select("issuer", "product_code")
    found = dispositions.wrong_unsupported(rows, spark.createDataFrame([("kb",), ("bc",)], "issuer string"), active)
    return found.select("product_code", F.array_join("reasons", ",").alias("reasons"))


@query("WITH " + _REFUSED + """, p AS (SELECT '{"disposition":"unsupported_drm","protected_magic":"' || magic || '","protected_sha256":"' || digest || '","protected_size_bytes":' || size || ',"source":' || source || ',"source_id":"' || source_id || '"}' AS j FROM r WHERE k NOT BETWEEN 1 AND 8)
SELECT count(*) AS n, sha256('{"documents":[' || string_agg(j, ',' ORDER BY j) || '],"schema_version":"refused.v1"}') AS sha256 FROM p""")
def disposition_seal(spark, sf_dir):
    """The hash of the list of all sound rows in canonical order."""
    return dispositions.seal(refused(spark, sf_dir).where("c_custkey % 13 NOT BETWEEN 1 AND 8"), dispositions.unsupported_payload(), "refused.v1")
