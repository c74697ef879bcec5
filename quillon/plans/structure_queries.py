"""Text, document-structure, graph and integrity queries.

The page texts are rendered from ``pages``: headings, list items and paragraphs become markdown lines, four
pages make a document, and each page ends in a running counter.  Tables come from ``lineitem``, dates from ``orders``.
Corpus syllables stand in for the domain's benefit and notice terms.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import dates, graph
from quillon.operators import structure as S
from quillon.operators import validation as V
from quillon.operators.ordering import dealt
from quillon.plans.registry import held, query, read

BENEFIT, NOTICE = ("thwh", "queaire", "schach"), ("sheds", "erst", "ñas")


def rendered(spark, sf_dir):
    """(document, page, text) of the rendered pages."""
    p = read(spark, sf_dir, "pages")
    parts = F.regexp_extract_all("html", F.lit("<(?:h1|li|p)>[^<\n]+"), F.lit(0))
    lines = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^<h1>", "# "), "^<li>", "- "), "^<p>", ""))
    page = (F.col("page_id") % 4 + 1).cast("int")
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"), page.cast("string"), F.lit(" / 4\n"))
    return p.select(F.floor(F.col("page_id") / 4).cast("long").alias("document"), page.alias("page"), text.alias("text"))


LINES = r"""WITH pg AS (SELECT page_id // 4 AS document, (page_id % 4 + 1)::INTEGER AS page,
  list_transform(regexp_extract_all(html, '<(?:h1|li|p)>[^<\n]+'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^<h1>', '# '), '^<li>', '- '), '^<p>', '')) AS ls FROM pages),
pt AS (SELECT document, page, array_to_string(ls, chr(10)) || chr(10) || page || ' / 4' || chr(10) AS text FROM pg),
ln AS (SELECT document, page, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no, unnest(l) AS visible FROM (SELECT document, page, string_split(substr(text, 1, length(text) - 1), chr(10)) AS l FROM pt)),
li AS (SELECT *, (sum(length(visible) + 1) OVER (PARTITION BY document, page ORDER BY line_no) - length(visible) - 1)::INTEGER AS start FROM ln)
"""


#: Lines with their number in the document and their whole text.
SEQ = LINES + ", sq AS (SELECT *, (row_number() OVER (PARTITION BY document ORDER BY page, line_no) - 1)::INTEGER AS seq, visible || chr(10) AS line FROM li) "


@query(LINES + "SELECT document, page, line_no, start, (start + length(visible) + 1)::INTEGER AS \"end\", sha256(visible || chr(10)) AS line_sha FROM li")
def span_lines_with_offsets(spark, sf_dir):
    return S.lines(rendered(spark, sf_dir)).select("document", "page", "line_no", "start", "end", X.sha256(F.col("line")).alias("line_sha"))


@query(LINES + "SELECT document, page, line_no, start, (start + length(visible) + 1)::INTEGER AS \"end\" FROM li")
def native_lines(spark, sf_dir):
    rows = rendered(spark, sf_dir).select("document", "page", F.posexplode(X.split_lines(F.col("text"))).alias("line_no", "l"))
    return rows.select("document", "page", "line_no", "l.start", "l.end")


@query(LINES + r"""SELECT document, page, line_no FROM li WHERE regexp_matches(visible, '^\d+ / 4$') AND document IN (SELECT document FROM pt GROUP BY document HAVING count(*) >= 2)""")
def repeated_edge_lines(spark, sf_dir):
    return S.repeated_edges(S.lines(rendered(spark, sf_dir)))


CLASS = """CASE WHEN b AND n THEN 'MIXED' WHEN b THEN 'BENEFIT' WHEN n THEN 'NOTICE' ELSE 'UNKNOWN' END"""
CLASSED = LINES + """, cl AS (SELECT *, contains(lower(visible), 'thwh') OR contains(lower(visible), 'queaire') OR contains(lower(visible), 'schach') AS b, contains(lower(visible), 'sheds') OR contains(lower(visible), 'erst') OR contains(lower(visible), 'ñas') AS n FROM li)
"""


# The whole parse: sections, items and tables as the last line that opens one, classes from above, headers carried over pages.
PARSED = CLASSED + rf""", s0 AS (SELECT *, (row_number() OVER (PARTITION BY document ORDER BY page, line_no) - 1)::INTEGER AS seq, {CLASS} AS own, trim(visible) AS t,
 regexp_matches(visible, '^\d+ / 4$') AND min(page) OVER (PARTITION BY document) < max(page) OVER (PARTITION BY document) AS boiler FROM cl),
s1 AS (SELECT *, NOT boiler AND t = '' AS blank, NOT boiler AND t <> '' AS solid, NOT boiler AND length(regexp_replace(visible, '[^|]', '', 'g')) >= 2 AS table_line FROM s0),
s2 AS (SELECT *, CASE WHEN NOT solid OR table_line THEN NULL WHEN regexp_matches(t, '^#{{1,2}}[ \t]+\S') THEN 'major' WHEN regexp_matches(t, '^#{{3,6}}[ \t]+\S') THEN 'item'
 WHEN length(t) > 120 OR contains(t, '|') OR regexp_matches(visible, '^\s*[-+*]\s+\S') OR regexp_matches(visible, '^\s*(※|\*{{1,3}}[^\s*]|\[\d+\])') THEN NULL
 WHEN regexp_matches(t, '^(\*\*|\[)') AND regexp_matches(t, '(\*\*|\])$') THEN 'item' WHEN (b OR n) AND length(t) <= 45 THEN 'major' END AS heading,
 coalesce(lag(table_line) OVER (PARTITION BY document, page ORDER BY seq), false) AS before,
 CASE WHEN table_line THEN list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(x)) END AS cells FROM s1),
s3 AS (SELECT *, coalesce(last_value(CASE WHEN heading = 'major' THEN seq END IGNORE NULLS) OVER (PARTITION BY document ORDER BY seq), -1) AS section,
 CASE WHEN table_line THEN coalesce(last_value(CASE WHEN table_line AND NOT before THEN seq END IGNORE NULLS) OVER (PARTITION BY document ORDER BY seq), -1) ELSE -1 END AS "table",
 table_line AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{{3,}}:?$'))) = 0 AS separator FROM s2),
s4 AS (SELECT *, CASE WHEN heading = 'major' THEN -1 ELSE coalesce(last_value(CASE WHEN heading = 'item' THEN seq END IGNORE NULLS) OVER w, first_value(CASE WHEN solid AND heading IS DISTINCT FROM 'major' THEN seq END IGNORE NULLS) OVER w, -1) END AS item,
 CASE WHEN section >= 0 THEN max(CASE WHEN seq = section THEN own END) OVER (PARTITION BY document, section) ELSE 'UNKNOWN' END AS section_class,
 min(CASE WHEN solid THEN seq END) OVER (PARTITION BY document, page) AS first_solid, last_value(CASE WHEN solid THEN table_line END IGNORE NULLS) OVER (PARTITION BY document ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_table,
 arg_min(cells, CASE WHEN NOT separator THEN seq END) OVER (PARTITION BY document, "table") AS own_head, bool_or(seq = "table" + 1 AND separator) OVER (PARTITION BY document, "table") AS declares
 FROM s3 WINDOW w AS (PARTITION BY document, section ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s5 AS (SELECT *, coalesce(max(CASE WHEN seq = item AND heading = 'item' THEN CASE WHEN own = 'UNKNOWN' THEN section_class ELSE own END END) OVER (PARTITION BY document, item, section), section_class) AS item_class,
 "table" >= 0 AND bool_or(seq = "table" AND "table" = first_solid AND coalesce(was_table, false)) OVER (PARTITION BY document, "table") AND NOT declares AS continued FROM s4),
s6 AS (SELECT *, CASE WHEN item >= 0 THEN item_class ELSE section_class END AS above, CASE WHEN "table" >= 0 THEN last_value(CASE WHEN seq = "table" AND NOT continued THEN own_head END IGNORE NULLS) OVER (PARTITION BY document ORDER BY seq) END AS headers FROM s5),
ps AS (SELECT *, CASE WHEN boiler THEN 'UNKNOWN' WHEN blank OR table_line THEN above WHEN heading = 'major' THEN own WHEN own = 'UNKNOWN' THEN above ELSE own END AS major_class,
 CASE WHEN boiler THEN 'BOILERPLATE' WHEN blank THEN 'UNCLASSIFIED' WHEN table_line THEN 'TABLE_ROW' WHEN heading IS NOT NULL THEN 'PARAGRAPH' WHEN regexp_matches(visible, '^\s*(※|\*{{1,3}}[^\s*]|\[\d+\]\s*\S)') THEN 'FOOTNOTE'
  WHEN regexp_matches(visible, '^\s*([-+*]|\d+[.)]|[가-힣][.)])\s+\S') THEN 'LIST_ITEM' WHEN above <> 'UNKNOWN' OR own <> 'UNKNOWN' THEN 'PARAGRAPH' ELSE 'UNCLASSIFIED' END AS node_type,
 CASE WHEN "table" < 0 THEN NULL WHEN separator THEN 'SEPARATOR' WHEN cells = headers THEN 'HEADER' ELSE 'BODY' END AS role FROM s6)
"""

# Windows of 1600 characters of (id, text) rows in ``src`` that overlap by 160 and end at the last blank or line end past their middle, as ``ch``.
CHUNKS = """st AS (SELECT id, text, length(text) AS n, 0 AS p, 0 AS stop, NULL::INTEGER AS a, NULL::INTEGER AS b FROM src WHERE length(text) > 0
UNION ALL SELECT id, text, n, CASE WHEN stop >= n THEN n ELSE greatest(p + 1, stop - 160) END, stop, l, r FROM (
 SELECT *, p + length(piece) - length(ltrim(piece, chr(32) || chr(10))) AS l, stop - (length(piece) - length(rtrim(piece, chr(32) || chr(10)))) AS r FROM (
  SELECT id, text, n, p, stop, substr(text, p + 1, stop - p) AS piece FROM (
   SELECT id, text, n, p, CASE WHEN whole < n AND cut > p + 800 THEN cut ELSE whole END AS stop FROM (
    SELECT *, p + 1600 - least(CASE WHEN strpos(rev, ' ') = 0 THEN 1601 ELSE strpos(rev, ' ') END, CASE WHEN strpos(rev, chr(10)) = 0 THEN 1601 ELSE strpos(rev, chr(10)) END) AS cut FROM (
     SELECT id, text, n, p, least(n, p + 1600) AS whole, reverse(substr(text, p + 1, 1600)) AS rev FROM st WHERE p < n))))) ),
ch AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY a) - 1)::INTEGER AS chunk, a::INTEGER AS start, b::INTEGER AS "end" FROM st WHERE a < b)
"""


@query(CLASSED + f"SELECT document, page, line_no, {CLASS} AS major_class FROM cl")
def major_class(spark, sf_dir):
    return S.lines(rendered(spark, sf_dir)).select("document", "page", "line_no", S.major_class(F.col("visible"), BENEFIT, NOTICE).alias("major_class"))


@query(CLASSED + r"""SELECT document, page, line_no, CASE WHEN regexp_matches(trim(visible), '^#{1,2}[ \t]+\S') THEN 'major' WHEN regexp_matches(trim(visible), '^#{3,6}[ \t]+\S') THEN 'item'
WHEN trim(visible) = '' OR length(trim(visible)) > 120 OR contains(visible, '|') OR regexp_matches(visible, '^\s*[-+*]\s+\S') OR regexp_matches(visible, '^\s*(※|\*{1,3}[^\s*]|\[\d+\])') THEN NULL
WHEN regexp_matches(trim(visible), '^(\*\*|\[)') AND regexp_matches(trim(visible), '(\*\*|\])$') THEN 'item' WHEN (b OR n) AND length(trim(visible)) <= 45 THEN 'major' END AS heading FROM cl""")
def heading_kind(spark, sf_dir):
    return S.lines(rendered(spark, sf_dir)).select("document", "page", "line_no", S.heading_kind(F.col("visible"), BENEFIT, NOTICE).alias("heading"))


@query(LINES + r"SELECT document, page, line_no, CASE WHEN regexp_matches(visible, '^\s*(※|\*{1,3}[^\s*]|\[\d+\]\s*\S)') THEN 'FOOTNOTE' WHEN regexp_matches(visible, '^\s*([-+*]|\d+[.)]|[가-힣][.)])\s+\S') THEN 'LIST_ITEM' END AS kind FROM li")
def line_kind(spark, sf_dir):
    return S.lines(rendered(spark, sf_dir)).select("document", "page", "line_no", S.line_kind(F.col("visible")).alias("kind"))


@query(PARSED + """SELECT document, page, line_no, seq, start, (start + length(visible) + 1)::INTEGER AS "end", node_type, major_class, heading, section, item, "table", continued, role, array_to_string(headers, '|') AS headers, array_to_string(cells, '|') AS cells, section_class, item_class FROM ps""")
def structure_parse(spark, sf_dir):
    p = S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE).drop("line", "visible")
    return p.withColumns({c: F.array_join(c, "|") for c in ("headers", "cells")})


@query(LINES + "SELECT document, count(*) AS n_lines, sum(length(visible) + 1)::BIGINT AS n_chars, count(*) FILTER (WHERE regexp_matches(visible, '^\\d+ / 4$') AND document IN (SELECT document FROM pt GROUP BY document HAVING count(*) >= 2)) AS n_boilerplate FROM li GROUP BY document")
def structure_is_lossless(spark, sf_dir):
    p = S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE)
    return p.groupBy("document").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.count_if(F.col("node_type") == "BOILERPLATE").alias("n_boilerplate"))


@query(SEQ + """SELECT document, 'l' || seq AS node, 'parent present' AS rule FROM sq WHERE seq % 10 = 3 UNION ALL SELECT document, 'l' || seq, 'leaf without children' FROM sq WHERE seq % 10 = 5
UNION ALL SELECT document, 'root', unnest(['root first', 'contiguous ordinals']) FROM (SELECT DISTINCT document FROM pt WHERE document % 3 = 2)""")
def check_tree(spark, sf_dir):
    """Some leaves are hung under nodes that are absent, some under the leaf before them, and some roots lose their number."""
    nodes = S.nodes(held(S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE)))
    seq = F.when(F.col("node").startswith("l"), F.col("start_seq"))
    parent = F.when(seq % 10 == 3, "gone").when(seq % 10 == 5, F.concat(F.lit("l"), (seq - 1).cast("string"))).otherwise(F.col("parent"))
    ordinal = F.when((F.col("node") != "root") | (F.col("document") % 3 != 2), F.col("ordinal"))
    return V.wrong_tree(held(nodes.withColumn("parent", parent).withColumn("ordinal", ordinal)))


@query(SEQ + """SELECT document, 'l' || seq AS from_node, CASE seq % 10 WHEN 3 THEN 'l' || seq WHEN 4 THEN 'none' ELSE 'root' END AS to_node, CASE seq % 10 WHEN 5 THEN 'OTHER' ELSE 'NEXT' END AS link_type FROM sq WHERE seq % 10 IN (3, 4, 5)""")
def check_links(spark, sf_dir):
    """The links of the tree, and some to themselves, to absent nodes and of unknown type."""
    p = held(S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE))
    k, here = F.col("seq") % 10, F.concat(F.lit("l"), F.col("seq").cast("string"))
    bad = p.where(k.isin(3, 4, 5)).select("document", here.alias("from_node"), F.when(k == 3, here).when(k == 4, "none").otherwise("root").alias("to_node"), F.when(k == 5, "OTHER").otherwise("NEXT").alias("link_type"))
    return V.wrong_links(held(S.links(p).unionByName(bad)), held(S.nodes(p)))


@query(LINES + r"""SELECT document, page, sum(n)::BIGINT AS source, coalesce(sum(n) FILTER (WHERE line_no > 0), 0)::BIGINT AS covered FROM (SELECT *, length(regexp_replace(visible, '\s', '', 'g')) AS n FROM li) WHERE page % 2 = 0 GROUP BY ALL HAVING source <> covered""")
def check_coverage(spark, sf_dir):
    """The first lines of every other page are left out of the spans."""
    pages = rendered(spark, sf_dir)
    spans = S.parse(pages, BENEFIT, NOTICE).where("page % 2 = 1 OR line_no > 0").select("document", "page", "start", "end")
    got = V.uncovered(spans, pages)
    return got.select("document", "page", F.col("source").cast("long").alias("source"), F.col("covered").cast("long").alias("covered"))


@query(SEQ + """SELECT document, page, start, (start + length(line) + CASE WHEN line_no % 5 = 3 THEN 1000000 ELSE 0 END)::INTEGER AS "end", sha256(CASE WHEN line_no % 5 = 2 THEN 'x' ELSE line END) AS text_sha256 FROM sq WHERE line_no % 5 IN (2, 3)""")
def check_spans(spark, sf_dir):
    """Some spans have the hash of another text, some end beyond their page."""
    pages = rendered(spark, sf_dir)
    k = F.col("line_no") % 5
    spans = S.lines(pages).select("document", "page", "start", F.when(k == 3, F.col("end") + 1_000_000).otherwise(F.col("end")).alias("end"), X.sha256(F.when(k == 2, "x").otherwise(F.col("line"))).alias("text_sha256"))
    return V.wrong_spans(spans, pages)


@query(LINES + "SELECT document, page, (start - 1)::INTEGER AS start FROM li WHERE line_no % 5 = 2")
def check_overlaps(spark, sf_dir):
    """Some spans begin a character too early."""
    rows = S.lines(rendered(spark, sf_dir)).select("document", "page", (F.col("start") - F.when(F.col("line_no") % 5 == 2, 1).otherwise(0)).alias("start"), "end")
    return V.overlapping_spans(rows).select("document", "page", "start")


@query("SELECT document, seq::INTEGER AS seq FROM (SELECT document, unnest(range(0, n + 2)) AS seq FROM (SELECT l_orderkey AS document, count(*) AS n FROM lineitem GROUP BY 1)) WHERE seq % 4 IN (1, 3)")
def check_table_rows(spark, sf_dir):
    """Some rows are made to lack their cells, some their role."""
    p, k = S.parse(tables(spark, sf_dir), near=True), F.col("seq") % 4
    return V.wrong_table_rows(p.withColumn("cells", F.when(k != 1, F.col("cells"))).withColumn("role", F.when(k != 3, F.col("role"))))


@query(PARSED + """, x AS (SELECT *, lead(seq) OVER d AS next, last_value(CASE WHEN semantic AND node_type <> 'FOOTNOTE' THEN seq END IGNORE NULLS) OVER p AS rs, last_value(CASE WHEN semantic AND node_type <> 'FOOTNOTE' THEN major_class END IGNORE NULLS) OVER p AS rc,
 last_value(CASE WHEN semantic THEN seq END IGNORE NULLS) OVER p AS ws, last_value(CASE WHEN semantic THEN page END IGNORE NULLS) OVER p AS wp FROM (SELECT *, node_type <> 'BOILERPLATE' AND t <> '' AS semantic FROM ps)
 WINDOW d AS (PARTITION BY document ORDER BY seq), p AS (PARTITION BY document ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM x WHERE node_type = 'FOOTNOTE' AND rs IS NOT NULL), it AS (SELECT * FROM ps WHERE seq = item),
ib AS (SELECT *, last_value(CASE WHEN item_class IN ('BENEFIT', 'MIXED') THEN item END IGNORE NULLS) OVER (PARTITION BY document ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_item FROM it)
SELECT document, 'l' || seq AS from_node, 'l' || next AS to_node, 'NEXT' AS link_type FROM x WHERE next IS NOT NULL UNION SELECT document, 'l' || next, 'l' || seq, 'PREVIOUS' FROM x WHERE next IS NOT NULL
UNION SELECT document, 'l' || seq, 'l' || rs, unnest(['FOOTNOTE_OF', 'APPLIES_TO']) FROM f
UNION SELECT document, 'l' || seq, 'l' || rs, 'APPLIES_TO' FROM x WHERE semantic AND node_type <> 'FOOTNOTE' AND heading IS NULL AND "table" < 0 AND major_class IN ('NOTICE', 'MIXED') AND rc IN ('BENEFIT', 'MIXED')
UNION SELECT document, 'l' || seq, 'l' || ws, 'CONTINUATION_OF' FROM x WHERE semantic AND wp < page AND heading IS NULL AND ("table" < 0 OR continued)
UNION SELECT m.document, 's' || m.section, 'i' || b.item, 'APPLIES_TO' FROM ps m JOIN it b ON b.document = m.document AND b.item < m.section WHERE m.seq = m.section AND m.section_class IN ('NOTICE', 'MIXED') AND b.item_class IN ('BENEFIT', 'MIXED')
UNION SELECT document, 'i' || item, 'i' || before_item, 'APPLIES_TO' FROM ib WHERE heading = 'item' AND item_class IN ('NOTICE', 'MIXED') AND section_class NOT IN ('NOTICE', 'MIXED') AND before_item IS NOT NULL""")
def node_links(spark, sf_dir):
    return S.links(held(S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE)))


@query(PARSED + """, v AS (SELECT *, visible || chr(10) AS line, regexp_replace(trim(visible), '\\s+', ' ', 'g') AS flat FROM ps), bd AS (SELECT * FROM v WHERE node_type <> 'BOILERPLATE'),
it AS (SELECT document, section, item, item_class, string_agg(line, '' ORDER BY seq) AS text FROM bd WHERE item >= 0 GROUP BY ALL),
e AS (SELECT document, CASE WHEN heading = 'item' THEN 'i' || item ELSE 's' || section END AS node, 'TITLE' AS view_type, flat AS text FROM v WHERE heading IS NOT NULL
UNION ALL SELECT document, 'i' || item, 'RAW_ITEM', text FROM it
UNION ALL SELECT it.document, 'i' || it.item, 'CONTEXTUAL_ITEM', concat_ws(chr(10), 'document: ' || it.document, 'major_class: ' || it.item_class, 'heading: ' || h.flat, it.text) FROM it LEFT JOIN (SELECT document, section, flat FROM v WHERE seq = section) h ON h.document = it.document AND h.section = it.section
UNION ALL SELECT document, 's' || section, 'MAJOR_SECTION', string_agg(line, '' ORDER BY seq) FROM bd WHERE section >= 0 AND section_class IN ('BENEFIT', 'NOTICE') GROUP BY document, section
UNION ALL SELECT document, 'root', 'CONTRACT', string_agg(line, '' ORDER BY seq) FROM bd GROUP BY document)
SELECT * FROM e WHERE length(text) <= 30000 AND trim(text, ' ' || chr(10)) <> ''""")
def derived_views(spark, sf_dir):
    p = held(S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE))
    return S.views(p, {"document": F.col("document").cast("string")})


@query(PARSED.replace("WITH pg", "WITH RECURSIVE pg", 1) + """, o AS (SELECT document, item, visible || chr(10) AS line, length(visible) + 1 AS n, row_number() OVER (PARTITION BY document, item ORDER BY seq) AS k FROM ps WHERE item >= 0 AND node_type <> 'BOILERPLATE'),
g AS (SELECT document, item, line, n, k, 0 AS batch, n AS total FROM o WHERE k = 1
UNION ALL SELECT o.document, o.item, o.line, o.n, o.k, CASE WHEN g.total + o.n > 2000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.total + o.n > 2000 THEN o.n ELSE g.total + o.n END FROM g JOIN o ON o.document = g.document AND o.item = g.item AND o.k = g.k + 1)
SELECT document, item, batch, string_agg(line, '' ORDER BY k) AS text FROM g GROUP BY document, item, batch""")
def detail_views(spark, sf_dir):
    return S.details(held(S.parse(rendered(spark, sf_dir), BENEFIT, NOTICE)))


@query(LINES + "SELECT document, count(*) AS n FROM li GROUP BY document")
def lossless_fallback(spark, sf_dir):
    return S.fallback(rendered(spark, sf_dir)).groupBy("document").agg(F.count(F.lit(1)).alias("n"))


def tables(spark, sf_dir):
    """Two pages an order: its line items as a table, cut after the first two rows; the second page goes on without a header.

    Line items are dealt by order before they become pages, about two lines a row, so the parse finds documents together (``near``).
    """
    li = read(spark, sf_dir, "lineitem")
    li = dealt(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", li, [(F.lit(1), S.PART_LINES // 2)])
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("rows"))
    row = lambda x: F.concat(F.lit("| "), x["l_linenumber"].cast("string"), F.lit(" | "), x["l_partkey"].cast("string"), F.lit(" |"))
    text = lambda some: F.concat(F.array_join(F.transform(some, row), "\n"), F.lit("\n"))
    first = F.concat(F.lit("| line | part |\n| --- | :---: |\n"), text(F.slice("rows", 1, 2)))
    second = F.when(F.size("rows") > 2, text(F.slice("rows", F.lit(3), F.size("rows"))))
    return rows.select(F.col("l_orderkey").alias("document"), F.posexplode(F.array(first, second)).alias("page", "text")).where("text IS NOT NULL").withColumn("page", F.col("page") + 1)


@query("""WITH c AS (SELECT l_orderkey AS document, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT document, 'HEADER' AS role, 1 AS n, false AS continued FROM c UNION ALL SELECT document, 'SEPARATOR', 1, false FROM c UNION ALL SELECT document, 'BODY', least(n, 2), false FROM c UNION ALL SELECT document, 'BODY', n - 2, true FROM c WHERE n > 2)
SELECT document, role, continued, n, 'line,part' AS headers FROM r""")
def table_blocks(spark, sf_dir):
    p = S.parse(tables(spark, sf_dir), near=True)
    return p.where("table >= 0").groupBy("document", "role", "continued").agg(F.count(F.lit(1)).alias("n"), F.first(F.array_join("headers", ",")).alias("headers"))


@query("""WITH c AS (SELECT l_orderkey AS document, count(*) AS n FROM lineitem GROUP BY 1) SELECT document FROM c WHERE n > 2""")
def table_fragmentation(spark, sf_dir):
    """Orders whose table blocks no single span of the first 40 characters holds: the containment join."""
    p = S.parse(tables(spark, sf_dir), near=True).where("table >= 0")
    blocks = held(p.groupBy("document", "page", "table").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    spans = blocks.groupBy("document", "page").agg(F.min("start").alias("start"), F.max(F.when(F.col("page") == 1, F.col("end"))).alias("end"))
    return V.uncovered_blocks(blocks, spans.where("end IS NOT NULL")).select("document").distinct()


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN l_quantity::BIGINT || '개월' ELSE l_quantity::BIGINT || '개월,' || round(l_discount * 100)::BIGINT || '%' END AS facts FROM lineitem""")
def numeric_facts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = lambda c: c.cast("long").cast("string")
    text = F.when(F.col("l_discount") == 0, F.concat(F.lit("기간 "), n(F.col("l_quantity")), F.lit(" 개월 x99원y"))).otherwise(F.concat(F.lit("기간 "), n(F.col("l_quantity")), F.lit(" 개월, 할인 "), n(F.round(F.col("l_discount") * 100)), F.lit("% 또는 "), n(F.round(F.col("l_discount") * 100)), F.lit(" %")))
    return li.select("l_orderkey", "l_linenumber", F.array_join(X.numeric_facts(text), ",").alias("facts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderdate::DATE END AS launch_date, CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'missing' WHEN 3 THEN 'invalid' ELSE 'conflicting' END AS status FROM orders""")
def launch_date_status(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day, dotted = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy년 M월 d일")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit("상품 출시일: "), day)).when(k == 1, F.concat(dotted, F.lit(" 신규 출시"))).when(k == 2, F.concat(F.lit("개정일: "), day, F.lit(" 출시"))).when(k == 3, F.lit("출시일 2020.13.40")).otherwise(F.concat(F.lit("출시일 "), day, F.lit(" 그리고 발매일 1901-01-01")))
    got = dates.launch_dates(dates.segments_of(o.select("o_orderkey", F.array(text).alias("texts")), "o_orderkey", "texts"))
    return got.withColumnRenamed("document", "o_orderkey")


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, 'p' || o_orderkey AS n FROM orders)
SELECT o_orderkey AS document, 0 AS candidate_ordinal, 'explicit_label' AS match_kind, d AS normalized_value, '출시일: (' || d || ') 이후' AS excerpt, n || 'a,' || n || 'b' AS nodes FROM o WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 0, 'date_before_launch', d, '이전 ' || d || ' 출시 안내', n || 'a' FROM o WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 0, 'explicit_label', NULL, '발매일 24.01.02', n || 'a' FROM o WHERE o_orderkey % 4 = 2""")
def launch_date_evidence(spark, sf_dir):
    """Labels and dates of two touching blocks, dates before the launch word, two-digit years, and dates of other kinds."""
    o = read(spark, sf_dir, "orders")
    k, day, page = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1).alias("page")
    first = F.when(k == 0, "출시일:").when(k == 1, F.concat(F.lit("이전 "), day, F.lit(" 출시 안내"))).when(k == 2, "발매일 24.01.02").otherwise(F.concat(F.lit("시행일: "), day, F.lit(" 출시")))
    second = F.when(k == 0, F.concat(F.lit("("), day, F.lit(") 이후"))).otherwise("끝")
    block = lambda i, text, a, b: o.select(F.col("o_orderkey").alias("document"), F.lit(i).alias("ordinal"), text.alias("text"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit("ab"[i])).alias("node"), page, a.alias("start"), b.alias("end"))
    segments = block(0, first, F.lit(0), F.length(first)).unionByName(block(1, second, F.length(first), F.length(first) + F.length(second)))
    return dates.evidence(segments).withColumn("nodes", F.array_join("nodes", ","))


@query("WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents)," + CHUNKS + 'SELECT id AS doc_id, chunk, start, "end", sha256(substr(text, start + 1, "end" - start)) AS text_sha256 FROM ch JOIN src USING (id)')
def chunk_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "c"))
    return d.select("doc_id", "chunk", "c.start", "c.end", X.sha256(F.substr("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))).alias("text_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE length(text) > 0")
def hydrate_spans(spark, sf_dir):
    """Spans of 1000 characters that tile every text, joined again."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.lit(1).alias("page"), "text")
    n = F.ceil(F.length("text") / 1000).cast("int")
    spans = d.where("length(text) > 0").select("document", "page", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("span_ordinal"))
    spans = spans.select("document", "page", "span_ordinal", (F.col("span_ordinal") * 1000).alias("start"), F.least(F.col("span_ordinal") * 1000 + 1000, F.col("n")).alias("end"))
    return graph.hydrate(spans, d, ["document"]).select(F.col("document").alias("doc_id"), X.sha256(F.col("text")).alias("text_sha256"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, length(regexp_replace(text, '\s', '', 'g')) AS solid FROM documents")
def whitespace_functions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.sha256(X.ws_collapse(F.col("text"))).alias("collapsed"), X.non_space_count(F.col("text")).cast("long").alias("solid"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text END AS text FROM documents")
def bounded_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.bounded(F.col("text"), 500).alias("text"))


@query("SELECT doc_id, 'Instruct: find\nQuery:' || lang AS q FROM documents")
def query_formatting(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.format_query(F.col("lang"), "find").alias("q"))


def nation_tree(spark, sf_dir):
    """Regions over nations over customers as (document, node, parent, node_type)."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    root = spark.createDataFrame([("root", None, "ROOT")], "node string, parent string, node_type string")
    r = read(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit("MAJOR_SECTION").alias("node_type"))
    n = read(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), F.lit("ITEM").alias("node_type"))
    c = read(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"), F.lit("PARAGRAPH").alias("node_type"))
    return root.unionByName(r).unionByName(n).unionByName(c).withColumn("document", F.lit(1))


TREE = """WITH RECURSIVE t AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
"""


@query(TREE + ", d AS (SELECT node, 0 AS depth FROM t WHERE node = 'r1' UNION ALL SELECT t.node, d.depth + 1 FROM d JOIN t ON t.parent = d.node) SELECT node, depth FROM d")
def descendants(spark, sf_dir):
    nodes = nation_tree(spark, sf_dir)
    return graph.descendants(nodes.where("node = 'r1'"), nodes).select("node", "depth")


@query(TREE + ", d AS (SELECT node AS seed, node, 0 AS depth FROM t WHERE node IN ('c1', 'c2', 'n3') UNION ALL SELECT d.seed, t.parent, d.depth + 1 FROM d JOIN t ON t.node = d.node WHERE t.parent IS NOT NULL) SELECT seed, node, depth FROM d")
def ancestors(spark, sf_dir):
    nodes = nation_tree(spark, sf_dir)
    return graph.ancestors(nodes.where("node IN ('c1', 'c2', 'n3')"), nodes).select("seed", "node", "depth")


def turns(spark, sf_dir):
    """Conversations as documents: turns are items below the root; NEXT and PREVIOUS links; turn k is a footnote of turn k - 3."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), "turn", "text")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    nodes = c.select("document", name(F.col("turn")).alias("node"), F.lit("root").alias("parent"), F.lit("ITEM").alias("node_type"), F.lit("BENEFIT").alias("major_class"), "text")
    root = c.select("document").distinct().select("document", F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("ROOT").alias("node_type"), F.lit("UNKNOWN").alias("major_class"), F.lit("").alias("text"))
    w = Window.partitionBy("document").orderBy("turn")
    near = c.withColumn("next", F.lead("turn").over(w)).where("next IS NOT NULL")
    link = lambda d, a, b, kind: d.select("document", name(a).alias("from_node"), name(b).alias("to_node"), F.lit(kind).alias("link_type"))
    back = c.select("document", F.col("turn").alias("far")).join(c.select("document", "turn"), "document").where("far = turn + 3")
    links = link(near, F.col("turn"), F.col("next"), "NEXT").unionByName(link(near, F.col("next"), F.col("turn"), "PREVIOUS")).unionByName(link(back, F.col("far"), F.col("turn"), "FOOTNOTE_OF"))
    return root.unionByName(nodes), links


@query("""WITH t AS (SELECT conv_id AS document, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), s AS (SELECT * FROM t WHERE turn = 2), c AS (SELECT conv_id AS document, turn FROM conversations)
SELECT document, 'root' AS node FROM s UNION SELECT document, 't' || turn FROM s UNION SELECT document, 't' || n FROM s WHERE n IS NOT NULL UNION SELECT document, 't' || p FROM s WHERE p IS NOT NULL
UNION SELECT s.document, 't' || c.turn FROM s JOIN c ON c.document = s.document AND c.turn IN (5, -1)""")
def one_hop_expansion(spark, sf_dir):
    nodes, links = turns(spark, sf_dir)
    return graph.expand(nodes.where("node = 't2'"), nodes, links)


@query("""WITH RECURSIVE c AS (SELECT conv_id AS document, turn FROM conversations), d AS (SELECT document, turn FROM c WHERE turn = 1 UNION SELECT c.document, c.turn FROM d JOIN c ON c.document = d.document AND abs(c.turn - d.turn) = 3) SELECT document, 't1' AS seed, 't' || turn AS node FROM d""")
def clause_groups(spark, sf_dir):
    nodes, links = turns(spark, sf_dir)
    return graph.clause_groups(nodes.where("node = 't1'"), nodes, links)


@query("SELECT conv_id AS document, count(*) + 1 AS n_nodes, sum(length(text))::BIGINT AS n_chars, CASE WHEN count(*) + 1 > 5 OR sum(length(text)) > 2000 THEN 'partial' ELSE 'full' END AS bundle FROM conversations GROUP BY 1")
def full_or_partial(spark, sf_dir):
    return graph.full_or_partial(turns(spark, sf_dir)[0], 5, 2000)


@query("SELECT conv_id AS document, 't' || turn AS node FROM conversations WHERE role <> 'user' UNION SELECT conv_id, 'root' FROM conversations")
def bundle_scope(spark, sf_dir):
    """Turns of the user are benefits, the others notices."""
    user = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node"), (F.col("role") == "user").alias("user"))
    nodes = turns(spark, sf_dir)[0].join(user, ["document", "node"], "left")
    nodes = nodes.withColumn("major_class", F.when(F.col("node_type") == "ROOT", "UNKNOWN").when(F.col("user"), "BENEFIT").otherwise("NOTICE"))
    return graph.bundle_scope(nodes, "notices").select("document", "node")


@query("""WITH c AS (SELECT n_chars % 7 = 0 AS a, n_chars % 5 = 0 AS b, n_chars % 3 = 0 AS f FROM documents), g AS (SELECT count(*) AS chunks, count(*) FILTER (WHERE a) AS starts_mid_word, count(*) FILTER (WHERE b) AS splits_table, count(*) FILTER (WHERE f) AS splits_fact FROM c)
SELECT *, round(starts_mid_word * 100.0 / chunks, 4)::DOUBLE AS starts_mid_word_percent, round(splits_table * 100.0 / chunks, 4)::DOUBLE AS splits_table_percent, round(splits_fact * 100.0 / chunks, 4)::DOUBLE AS splits_fact_percent FROM g""")
def chunk_quality(spark, sf_dir):
    n = F.col("n_chars")
    return V.chunk_quality(read(spark, sf_dir, "documents").select((n % 7 == 0).alias("starts_mid_word"), (n % 5 == 0).alias("splits_table"), (n % 3 == 0).alias("splits_fact")))


@query(LINES + "SELECT document, page, text FROM pt")
def page_split(spark, sf_dir):
    from quillon.sources.files import split_pages

    pages = rendered(spark, sf_dir)
    body = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), F.col("text"))
    docs = pages.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("t")))), lambda x: x["t"]), "").alias("text"), F.min("page").alias("first"), F.max("page").alias("last"))
    return split_pages(docs).withColumn("text", F.concat("text", F.lit("\n")))
