"""Operator semantics on hand-made rows."""

import datetime as dt
import hashlib
import json
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.vectors import cosine, normalise, score_blocks
from quillon.operators import catalog as C
from quillon.operators import dates, evaluation, graph, packing, paging, retrieval, summary, temporal
from quillon.operators import structure as S
from quillon.operators import validation as V

D = dt.date


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ａb　ß x ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.nfkc_casefold("t")).collect()] == ["ab ss x", None, ""]
    assert df.select(X.ws_collapse(F.col("t"))).first()[0] == "Ａb ß x"
    assert df.select(X.non_space_count(F.col("t"))).first()[0] == 4
    lines = spark.createDataFrame([("a\nb\r\nc\x0cd e",)], "t string").select(X.python_lines(F.col("t"))).first()[0]
    assert [x.line for x in lines] == "a\nb\r\nc\x0cd e".splitlines(keepends=True) and lines[-1].end == 10
    v = spark.createDataFrame([("v10",), ("v9",), ("v9a",)], "v string")
    assert [r.v for r in v.orderBy(X.version_key(F.col("v"))).collect()] == ["v9", "v9a", "v10"]
    d = spark.createDataFrame([("2024.01.02",), ("20240102",), ("x",), ("2024-1-2",)], "t string")
    assert [r[0] for r in d.select(X.source_date(F.col("t"))).collect()][:3] == [D(2024, 1, 2), D(2024, 1, 2), None]
    assert [r[0] for r in d.select(X.canonical_date(F.col("t"))).collect()][3] is None
    like = spark.createDataFrame([("Big STARBUCKS cafe",), ("É",)], "t string")
    assert [r[0] for r in like.select(X.like_contains(F.col("t"), "star_ucks")).collect()] == [True, False]
    assert X.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        X.canonical_json({"a": float("nan")})
    q = spark.createDataFrame([('a"b', None)], "x string, y string").select(X.canonical_object(x=F.col("x"), y=F.col("y"))).first()[0]
    assert q == '{"x":"a\\"b","y":null}'


def test_chunks_prefer_ends():
    text = "word " * 1000
    got = X.chunk_offsets(text, 100, 10)
    assert all(e - s <= 100 and not text[s:e].startswith(" ") and not text[s:e].endswith(" ") for s, e in got)
    covered = {i for s, e in got for i in range(s, e)}
    assert all(i in covered or text[i] == " " for i in range(len(text)))
    assert X.chunk_offsets("") == [] and X.chunk_offsets("   ") == [] and X.chunk_offsets("x" * 250, 100, 10)[-1][1] == 250


def test_numeric_facts(spark):
    df = spark.createDataFrame([("월 10,000 원, 5% 5% A5원 12개월 1.5배",)], "t string")
    assert df.select(X.numeric_facts(F.col("t"))).first()[0] == ["10,000원", "5%", "12개월", "1.5배"]


LAUNCHES = [
    (["상품 출시일: 2024년 3월 5일"], D(2024, 3, 5), "confirmed"),
    (["2023.1.2 신규 출시"], D(2023, 1, 2), "confirmed"),
    (["출시일 24.01.02"], None, "invalid"),
    (["출시일 2024.13.02"], None, "invalid"),
    (["출시일 2024-01-02", "발매일 2024-01-03"], None, "conflicting"),
    (["개정일: 2024-01-02 출시"], None, "missing"),
    (["시행일 2024-01-02"], None, "missing"),
    ([None, "출시일 1899-01-01"], None, "invalid"),
    (["출시일 2024-01-02", "출시일 2024.1.2."], D(2024, 1, 2), "confirmed"),
    (["출시일 2024-02-30"], None, "invalid"),
    (["출시일 2024-001-02"], None, "invalid"),
    (["출시일 2024.1.2.3"], None, "missing"),
    (["１２ 출시일：２０２４－０１－０２"], D(2024, 1, 2), "confirmed"),
    (["출시\u200b일 2024-01-02"], D(2024, 1, 2), "confirmed"),
    (["약관 변경일 2020-01-01 그리고 출시일 2024-01-02"], D(2024, 1, 2), "confirmed"),
    (["출시일", "2024-01-02"], None, "missing"),
    (["x2024-01-02 출시"], None, "missing"),
    (["판매개시일 [2021/7/8] 및 2021-07-08 출시"], D(2021, 7, 8), "confirmed"),
]


def test_launch_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LAUNCHES)], "k int, t array<string>")
    got = {r.document: (r.launch_date, r.status) for r in dates.launch_dates(dates.segments_of(df, "k", "t")).collect()}
    assert [got[i] for i in range(len(LAUNCHES))] == [(d, s) for _, d, s in LAUNCHES]


def test_launch_date_evidence(spark):
    touching = [("t", 0, "출시일", 1, 0, 3, None, None), ("t", 1, "(2024-01-02)", 1, 3, 15, None, None)]
    apart = [("a", o, t, p + o, s, e, g, c) for _, o, t, p, s, e, g, c in touching]
    grouped = [("g", o, t, None, None, None, "x", None) for _, o, t, *_ in touching]
    continued = [("c", o, t, None, None, None, None, o == 1) for _, o, t, *_ in touching]
    many = [("m", i, f"출시일 2024-01-{i + 1:02d} 및 출시일 2024-01-{i + 1:02d}", None, None, None, None, None) for i in range(12)]
    rows_ = [(d, o, f"{d}{o}", t, p, s, e, g, c) for d, o, t, p, s, e, g, c in touching + apart + grouped + continued + many]
    segments = spark.createDataFrame(rows_, "document string, ordinal int, node string, text string, page int, start int, end int, group string, continued boolean")
    status = {r.document: (r.launch_date, r.status) for r in dates.launch_dates(segments).collect()}
    assert status == {"t": (D(2024, 1, 2), "confirmed"), "a": (None, "missing"), "g": (D(2024, 1, 2), "confirmed"), "c": (D(2024, 1, 2), "confirmed"), "m": (None, "conflicting")}
    found = dates.evidence(segments).orderBy("document", "candidate_ordinal").collect()
    assert [(r.document, r.candidate_ordinal, r.match_kind, r.normalized_value, r.excerpt, r.nodes) for r in found if r.document == "t"] == [("t", 0, "explicit_label", "2024-01-02", "출시일 (2024-01-02)", ["t0", "t1"])]
    mine = [r for r in found if r.document == "m"]
    assert [r.candidate_ordinal for r in mine] == list(range(8)) and [r.normalized_value for r in mine] == [f"2024-01-{i + 1:02d}" for i in range(8)]
    long = spark.createDataFrame([("l", 0, "가 " * 100 + "출시일 2024-01-02" + " 나" * 200)], "document string, ordinal int, text string")
    one = dates.evidence(long).first()
    assert one.excerpt == ("가 " * 20 + "출시일 2024-01-02" + " 나" * 40) and dates.launch_dates(long.limit(0)).count() == 0


def revisions(spark, data):
    return spark.createDataFrame(data, "lineage string, revision string, effective_date date, supersedes string, temporal_status string")


def test_as_of(spark):
    r = revisions(spark, [
        ("a", "a1", D(2020, 1, 1), None, "superseded"), ("a", "a2", D(2021, 1, 1), "a1", "current"),
        ("b", "b1", D(2021, 5, 1), None, "superseded"), ("b", "b2", D(2020, 5, 1), "b1", "current"),  # the successor is backdated
        ("c", "c1", None, None, "ambiguous"), ("d", "d1", D(2020, 1, 1), None, "current"), ("d", "d2", D(2020, 1, 1), None, "current"),
    ])
    assert rows(temporal.as_of(r, "2020-12-31"), "revision") == [("a1",), ("b2",), ("c1",), ("d1",), ("d2",)]
    assert rows(temporal.as_of(r, "2022-01-01"), "revision") == [("a2",), ("b2",), ("c1",), ("d1",), ("d2",)]
    assert rows(temporal.as_of(r, "2019-01-01"), "revision") == [("c1",)]
    assert rows(temporal.ambiguous_lineages(temporal.as_of(r, "2022-01-01")), "lineage") == [("d",)]
    with pytest.raises(Exception, match="ambiguous lineage"):
        temporal.require_unambiguous(temporal.as_of(r, "2022-01-01")).collect()
    assert temporal.active(r).count() == 5 and temporal.active(r, True).count() == 7


def test_history(spark):
    obs = spark.createDataFrame([("l", "x", D(2020, 1, 1), 1), ("l", "x", D(2020, 1, 5), 2), ("l", "y", D(2020, 2, 1), 3), ("l", "z", D(2020, 2, 1), 4)], "lineage string, content string, observed date, revision long")
    assert rows(temporal.chain(obs), "revision", "predecessor", "status") == [(2, None, "superseded"), (3, None, "ambiguous"), (4, None, "ambiguous")]
    runs = spark.createDataFrame([("a", 3, False), ("a", 2, False), ("a", 1, True), ("b", 1, False), ("c", 1, True)], "k string, t int, ok boolean")
    assert rows(temporal.failure_streak(runs, "k", "ok", [F.desc("t")])) == [("a", 2), ("b", 1), ("c", 0)]
    gone = spark.createDataFrame([("d1", "i", "p1", 3), ("d2", "i", "p2", 5), ("d3", "h", "p", 1)], "document_id string, issuer string, product_code string, consecutive_absences int")
    assert rows(temporal.retirement(gone, 1, 0.01, 10, 100), "document_id", "status") == [("d1", "retired"), ("d2", "absent"), ("d3", "absent")]
    counts = spark.createDataFrame([(1, 100), (2, 80), (3, 5)], "day int, n int")
    assert rows(temporal.retention_gate(counts, "day", 0.9, 10), "day", "passed") == [(1, True), (2, False), (3, False)]
    with pytest.raises(ValueError):
        temporal.launch_range(revisions(spark, []), "2024-01-01", "2025-01-01", "2024-06-01")


def test_document_policies(spark):
    data = [(0, "r", "n0", "CONTRACT", 0.9), (1, "r", "n1", "DETAIL", 0.4), (2, "r", "n1", "TITLE", 0.4), (3, "r", "n2", "DETAIL", 0.2), (4, "r", "n2", "DETAIL", 0.2), (5, "r", "n3", "DETAIL", -0.1)]
    df = spark.createDataFrame(data, "row_index long, revision string, node string, view_type string, score double")
    lanes = retrieval.lane_max(df)
    assert rows(lanes.where("node = 'n2'"), "row_index") == [(3,)]
    n1 = retrieval.node_scores(lanes).where("node = 'n1'").first()
    assert n1.view_types == ["TITLE", "DETAIL"]
    got = [retrieval.document_scores(lanes, p).first().score for p in retrieval.POLICIES]
    assert got == pytest.approx([0.4, (0.4 + 0.4 + 0.2) / 3, 0.65])
    with pytest.raises(Exception, match="no child"):
        retrieval.document_scores(df.where("view_type = 'CONTRACT'"), "max_child").collect()
    with pytest.raises(ValueError):
        retrieval.document_scores(lanes, "mean")


def test_lexical_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Cash back, cash"), (2, "cash only"), (3, "back"), (4, "")], "id long, text string")
    assert rows(retrieval.match_all(docs, "Cash back")) == [(1,)] and rows(retrieval.match_any(docs, "cash back")) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        retrieval.match_all(docs, "  ")
    told = spark.createDataFrame([(1, "Crème BRÛLÉE, Ångström"), (2, "creme brulee angstrom"), (3, "cre\u0300me Nguyễn ø ß"), (4, "й")], "id long, text string")
    for asked, ids in (("crème", [1, 2, 3]), ("CREME brulée", [1, 2]), ("ångstrom", [1, 2]), ("nguyen", [3]), ("ø", [3]), ("o", []), ("й", [4]), ("и", [])):
        assert [r[0] for r in rows(retrieval.match_all(told, asked))] == ids, asked
    score = retrieval.bm25(docs, "back").where("id = 3").first().score
    n, df, avgdl = 4, 2, 6 / 4
    assert score == pytest.approx(max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / avgdl)))
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int"), spark.createDataFrame([(2, 1)], "id long, rank int")
    assert dict(rows(retrieval.rrf([a, b]), "id", "score")) == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61})
    assert dict(rows(retrieval.rrf([a, b], cutoffs=[1, None]), "id", "score")) == pytest.approx({1: 1 / 61, 2: 1 / 61})
    admitted = retrieval.admit(spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "k int, n int"), "n", 10, ["k"])
    assert rows(admitted, "k") == [(1,)]  # stops at the first overflow
    groups = [{"t": "x" * 50}, {"t": "y" * 500}, {"t": "z" * 50, "u": [1, "é"]}, {"t": "v" * 40}]
    for most in (20, 80, 150, 250, 700):
        kept, want = [], []
        for g in groups:
            fits = len(json.dumps([*kept, g], ensure_ascii=True, indent=2)) <= most
            kept += [g] * fits
            want.append((fits, len(json.dumps(kept, ensure_ascii=True, indent=2))))
        sealed = graph.seal(spark.createDataFrame([(q, i, json.dumps(g)) for q in ("a", "b") for i, g in enumerate(groups)], "request string, rank int, body string"), most)
        for q in ("a", "b"):
            assert [(r.admitted, r.bytes) for r in sealed.where(F.col("request") == q).orderBy("rank").collect()] == want
    assert {r.reason for r in sealed.collect()} <= {None, "budget"} and {r.reason for r in graph.seal(spark.createDataFrame([(1, 1, json.dumps(groups[1]))], "request int, rank int, body string"), 100).collect()} == {"too_large"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, embedding array<float>")
    got = df.select(normalise("embedding").alias("u"), cosine("embedding", F.array(F.lit(6.0), F.lit(8.0))).alias("c")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[0].c == pytest.approx(1.0) and got[1].u is None and got[1].c is None
    assert rows(score_blocks(df, [(7, [1.0, 2.0])])) == [(1, 7, 11.0), (2, 7, 0.0)]


def test_catalog(spark):
    assert C.issuer_code(" KB 국민-카드") == "kb" and C.issuer_code("Ｂｃ") == "bc"
    with pytest.raises(ValueError):
        C.issuer_code("acme")
    assert C.scope(issuers=["shinhan", "BC", "신한"]) == ["bc", "shinhan"]
    for bad in ({"issuer": "kb", "issuers": ["bc"]}, {"issuers": []}):
        with pytest.raises(ValueError):
            C.scope(**bad)
    names = spark.createDataFrame([("국민 카드",), ("nobody",)], "n string")
    assert C.issuer_codes(spark.createDataFrame([("국민 카드",)], "n string"), "n").first().issuer == "kb"
    with pytest.raises(Exception, match="unknown issuer"):
        C.issuer_codes(names, "n").collect()
    cursor = C.Cursor(b"secret")
    token = cursor.make({"q": 1}, "g1", 20)
    assert cursor.read(token, {"q": 1}, "g1") == 20
    for binding, generation, text in (({"q": 2}, "g1", token), ({"q": 1}, "g2", token), ({"q": 1}, "g1", token[:-1] + "x"), ({"q": 1}, "g1", "???")):
        with pytest.raises(ValueError):
            cursor.read(text, binding, generation)
    products = spark.createDataFrame([("L1", "Deep"), ("L2", "Deep Dream"), ("L3", "가")], "lineage string, name string")
    queries = spark.createDataFrame([(1, "deep  DREAM fees"), (2, "deep and deep dream"), (3, "가 or"), (4, "none")], "query_id int, query string")
    assert rows(C.resolve_names(queries, products)) == [(1, "resolved", ["L2"]), (2, "ambiguous", ["L1", "L2"]), (3, "resolved", ["L3"]), (4, "unresolved", [])]
    with pytest.raises(ValueError):
        C.check_limit(101)
    start, end = C.month_window("2024-05-31", 3)
    assert tuple(spark.range(1).select(start, end).first()) == (D(2024, 2, 29), D(2024, 5, 31))
    available = spark.createDataFrame([("kb", "1"), ("kb", "1"), ("bc", "2")], "issuer string, product_code string")
    assert rows(C.availability(available, available.where("issuer = 'bc'"), available.limit(0))) == [("bc", "2", "available"), ("kb", "1", None)]


PAGES = [
    (1, 1, "# 혜택\n- 할인 5%\n본문\n| a | b |\n|---|---|\n| 1 | 2 |\n1 / 2\n"),
    (1, 2, "| 3 | 4 |\n※ 각주\n\n## 유의사항\n내용입니다.\n2 / 2\n"),
]


def test_structure(spark):
    p = S.parse(spark.createDataFrame(PAGES, "document int, page int, text string")).orderBy("seq").collect()
    kinds = [r.node_type for r in p]
    assert kinds == ["PARAGRAPH", "LIST_ITEM", "PARAGRAPH", "TABLE_ROW", "TABLE_ROW", "TABLE_ROW", "BOILERPLATE", "TABLE_ROW", "FOOTNOTE", "UNCLASSIFIED", "PARAGRAPH", "PARAGRAPH", "BOILERPLATE"]
    assert [r.role for r in p if r.role] == ["HEADER", "SEPARATOR", "BODY", "BODY"]
    assert p[7].continued and p[7].headers == ["a", "b"] and p[10].major_class == "NOTICE" and p[1].major_class == "BENEFIT"
    assert "".join(r.line for r in p if r.page == 1) == PAGES[0][2]
    parsed = S.parse(spark.createDataFrame(PAGES, "document int, page int, text string"))
    nodes, links = S.nodes(parsed), S.links(parsed)
    assert V.wrong_tree(nodes).count() == 0 and V.wrong_links(links, nodes).count() == 0
    got = {(r.from_node, r.to_node, r.link_type) for r in links.collect()}
    assert {("l8", "l7", "FOOTNOTE_OF"), ("l8", "l7", "APPLIES_TO"), ("l7", "l5", "CONTINUATION_OF"), ("s10", "i1", "APPLIES_TO"), ("l0", "l1", "NEXT"), ("l1", "l0", "PREVIOUS")} <= got
    views = {(r.view_type, r.node) for r in S.views(parsed).collect()}
    assert {("TITLE", "s0"), ("MAJOR_SECTION", "s0"), ("MAJOR_SECTION", "s10"), ("RAW_ITEM", "i1"), ("CONTEXTUAL_ITEM", "i1"), ("CONTRACT", "root")} <= views
    assert S.views(parsed, limit=3).where("length(text) > 3").count() == 0
    assert S.fallback(spark.createDataFrame(PAGES, "document int, page int, text string")).count() == 13


def test_own_header_stops_inheritance(spark):
    pages = [(1, 1, "| a | b |\n|---|---|\n| 1 | 2 |\n"), (1, 2, "| c | d |\n|---|---|\n| 3 | 4 |\n")]
    p = S.parse(spark.createDataFrame(pages, "document int, page int, text string")).orderBy("seq").collect()
    assert not p[3].continued and p[5].headers == ["c", "d"] and [r.role for r in p] == ["HEADER", "SEPARATOR", "BODY"] * 2


def test_headings(spark):
    df = spark.createDataFrame([("## x",), ("### x",), ("- 전월 실적 제외",), ("**굵게**",), ("[굵게]",), ("혜택 1. 커피",), ("할인됩니다.",), ("할인 안내",), ("a|b 할인",), ("x" * 121 + "할인",)], "t string")
    assert [r[0] for r in df.select(S.heading_kind(F.col("t"))).collect()] == ["major", "item", None, None, "item", "item", None, "major", None, None]


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "root", None, "ROOT", "UNKNOWN", ""), (1, "i1", "root", "ITEM", "BENEFIT", "a"), (1, "l1", "i1", "PARAGRAPH", "BENEFIT", "b"), (1, "l2", "i1", "PARAGRAPH", "BENEFIT", "c"), (1, "i2", "root", "ITEM", "NOTICE", "d"), (1, "l3", "i2", "FOOTNOTE", "NOTICE", "e"), (1, "i3", "root", "ITEM", "NOTICE", "f")], "document int, node string, parent string, node_type string, major_class string, text string")
    links = spark.createDataFrame([(1, "i2", "i1", "APPLIES_TO"), (1, "i3", "i2", "APPLIES_TO"), (1, "l1", "l3", "PREVIOUS")], "document int, from_node string, to_node string, link_type string")
    seeds = nodes.where("node = 'l1'")
    assert {r.node for r in graph.expand(seeds, nodes, links).collect()} == {"root", "i1", "l1", "l2", "i2", "l3"}  # one pass: i3 stays out
    assert {r.node for r in graph.clause_groups(nodes.where("node = 'i1'"), nodes, links).collect()} == {"i1", "l1", "l2", "i2", "l3", "i3"}  # a fixpoint
    assert {r.node for r in graph.bundle_scope(nodes, "notices").collect()} == {"root", "i2", "l3", "i3"}
    ring = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "document int, from_node string, to_node string")
    assert graph.closure(spark.createDataFrame([(1, "a")], "document int, node string"), ring).count() == 2


def test_packing(spark):
    text = "one\n\ntwo two\n\nthree"
    assert [text[s:e] for s, e in packing.cuts(text, 12)] == ["one\n\n", "two two\n\n", "three"]
    assert packing.plan_units([("s", 0, "ab"), ("t", 1, "c")], 10) == [("document", [(0, 0, 2), (1, 0, 1)])]
    units = packing.plan_units([("s", 0, "a" * 7), ("s", 1, "b" * 2), ("t", 2, "c" * 25)], 10)
    assert units == [("s", [(0, 0, 7), (1, 0, 2)]), ("t", [(2, 0, 10)]), ("t", [(2, 10, 20)]), ("t", [(2, 20, 25)])]
    with pytest.raises(ValueError):
        packing.cuts("x", 0)
    spans = spark.createDataFrame([(1, i, 10) for i in range(20)], "k int, p int, n int")
    half = lambda batch: batch.where("p % 2 = 0 OR batch = 0 AND p < 4")
    with pytest.raises(ValueError, match="did not shrink"):
        packing.reduce_rounds(spans, lambda b: b, "k", "p", "n", 50)
    assert packing.reduce_rounds(spans, lambda b: b.where("p % 4 = 0"), "k", "p", "n", 100).count() == 5 and half
    batches = paging.greedy_batches(spans, "k", "p", "n", 64, 35)
    assert batches.groupBy("batch").count().where("count > 3").count() == 0


def plain_batches(rows_, most_rows, most_size):
    out, state = [], {}
    for k, o, s in sorted(rows_, key=lambda r: (r[0] is not None, r[0], r[1])):
        batch, n, total = state.get(k, (0, 0, 0))
        if n and (n >= most_rows or total + (s or 0) > most_size):
            batch, n, total = batch + 1, 0, 0
        state[k] = (batch, n + 1, total + (s or 0))
        out.append((k, o, s, batch))
    return out


@pytest.mark.parametrize(("most_rows", "most_size"), [(7, 40), (1 << 30, 100), (5, 1 << 40), (1, 3), (64, 0)])
def test_greedy_batches_over_blocks(spark, monkeypatch, most_rows, most_size):
    """One key of nearly all rows over many blocks and partitions, small keys, null keys and sizes, rows beyond the cap, zeros."""
    monkeypatch.setattr(paging, "BLOCK", 8)
    rng = np.random.default_rng(most_rows % 97)
    rows_ = [("a", i, int(s)) for i, s in enumerate(rng.integers(0, 30, 500))] + [(f"b{i % 3}", i, int(i % 50)) for i in range(40)] + [(None, i, 9) for i in range(30)] + [("z", 1, None), ("z", 2, 1000), ("z", 3, 1)]
    df = spark.createDataFrame(rows_, "k string, o long, s long").repartition(5)
    got = paging.greedy_batches(df, "k", "o", "s", most_rows, most_size)
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == plain_batches(rows_, most_rows, most_size)
    assert paging.greedy_batches(df.limit(0), "k", "o", "s", most_rows, most_size).collect() == []


def test_summary(spark):
    lines = [(1, 0, "PARAGRAPH", "연회비 본인 10,000원", ""), (1, 1, "PARAGRAPH", "연회비 가족 5,000원", ""), (1, 2, "LIST_ITEM", "커피 10% 할인 (전월 실적 30만원 이상)", ""), (1, 3, "PARAGRAPH", "아래 항목은 제외", ""), (1, 4, "LIST_ITEM", "주유 5% 할인", ""), (1, 5, "PARAGRAPH", "연회비 반환 금액 1,000원", ""), (1, 6, "PARAGRAPH", "적립 대상에서 제외", "")]
    df = spark.createDataFrame([(d, s, 0, k, t, c) for d, s, k, t, c in lines], "document int, seq int, item int, node_type string, text string, context string")
    got = {(r.seq, r.field) for r in summary.candidates(df).collect()}
    assert {(0, "annual_fee"), (1, "annual_fee"), (2, "benefit"), (2, "condition"), (4, "condition"), (6, "condition")} <= got and (4, "benefit") not in got and (5, "annual_fee") not in got
    one = summary.summaries(summary.candidates(df)).first()
    assert one.annual_fee == "연회비 본인 10,000원" and one.benefits == ["커피 10% 할인 (전월 실적 30만원 이상)"] and "전월 실적 30만원 이상" in one.conditions


SUMMARY = "document int, seq int, item int, node_type string, text string, context string, heading string, ancestors array<string>, headers array<string>, cells array<string>, role string"


def told(spark, text, kind="PARAGRAPH", context="", heading=None, ancestors=None, headers=None, cells=None, role=None, more=()):
    """(field, heading, text) of the candidates of one line after some others."""
    every = [*more, (kind, text, context, heading, ancestors, headers, cells, role)]
    rows_ = [(1, i, 0, k, t, c, h, a, hs, cs, r) for i, (k, t, c, h, a, hs, cs, r) in enumerate(every)]
    found = summary.candidates(spark.createDataFrame(rows_, SUMMARY)).where(F.col("seq") == len(more)).collect()
    return {(r.field, r.heading, r.text) for r in found}


def test_summary_lines(spark):
    for text in ("[예시: 10% 할인]", "※ 예시) 2천원 캐시백", "30,000원 X 12개월 = 360,000포인트 적립", "신용평점 1점 할인 10%", "자세한 할인 10%는 홈페이지 참조", "***", None):
        assert told(spark, text) == set(), text
    text = "전월 실적 30만원 이상 이용 시 2% 할인(무이자 할부 제외), 월 2회"
    got = told(spark, text)
    conditions = {t for f, _, t in got if f == "condition"}
    assert ("benefit", False, text) in got and "월 2회" in conditions and "무이자 할부 제외" in conditions and text not in conditions and any("30만원 이상" in c for c in conditions)
    text = "전 가맹점 이용금액 1,500원당 1마일 - 전월 실적 30만원 이상 이용 시"
    got = told(spark, text)
    assert ("benefit", False, text) in got and ("condition", False, text) not in got and any(f == "condition" and "30만원 이상" in t for f, _, t in got)
    intro = ("PARAGRAPH", "서비스 제외 대상은 아래와 같습니다.", "", None, None, None, None, None)
    assert told(spark, "- 무이자 할부 이용금액", "LIST_ITEM", more=[intro]) == {("condition", False, "- 무이자 할부 이용금액")}
    assert told(spark, "커피 10% 할인", "ITEM", heading="### 커피 할인") == {("benefit", True, "커피 할인"), ("benefit", False, "커피 10% 할인")}
    assert told(spark, "유의사항", "PARAGRAPH") == set() and told(spark, "할인 혜택", "PARAGRAPH", ancestors=["## 할인 혜택"]) == set()
    assert told(spark, "전월 실적 조건 없이 이용") == {("condition", False, "전월 실적 조건 없이 이용")}


def test_summary_repeats(spark, monkeypatch):
    """Facts are found once for every different line, and each of its places gets its candidates; scopes are those of the place, and no two fields run together."""
    said = [
        ("PARAGRAPH", "서비스 제외 대상은 아래와 같습니다.", "", None, None, None, None, None),
        ("LIST_ITEM", "주유 5% 할인", "", None, None, None, None, None),
        ("PARAGRAPH", "커피 10% 할인(전월 실적 30만원 이상)", None, None, None, None, None, None),
        ("LIST_ITEM", "주유 5% 할인", "", None, None, None, None, None),
        ("PARAGRAPH", None, "", None, None, None, None, None),
        (None, "커피 10% 할인", "", None, None, None, None, None),
        ("TABLE_ROW", None, "", None, None, ["구분", "혜택"], ["쇼핑", "5% 할인"], None),
        ("TABLE_ROW", None, "", None, ["구분", "혜택"], None, ["쇼핑", "5% 할인"], None),
    ]
    seen, facts = [], summary._facts
    monkeypatch.setattr(summary, "_facts", lambda parts: seen.append(parts) or facts(parts))
    df = lambda documents: spark.createDataFrame([(d, i, 0, *line) for d in documents for i, line in enumerate(said)], SUMMARY).repartition(3)
    one = sorted(tuple(r)[1:] for r in summary.candidates(df([0])).collect())
    many = sorted((r.document, *tuple(r)[1:]) for r in summary.candidates(df(range(40))).collect())
    assert many == [(d, *r) for d in range(40) for r in one]
    assert seen[1].count() == seen[0].count() == 9  # 7 different lines, one of them listed in both ways and one of two cells
    fields = {(r[0], r[2]) for r in one}
    assert (3, "benefit") in fields and (1, "benefit") not in fields and (6, "benefit") in fields and (7, "benefit") not in fields


def test_summary_column_roles(spark):
    row = lambda headers, cells, **k: told(spark, "| " + " | ".join(cells) + " |", "TABLE_ROW", headers=headers, cells=cells, role=k.pop("role", "BODY"), **k)
    assert not any(f == "benefit" for f, _, _ in row(["서비스", "혜택"], ["식당", "×"]))
    assert row(["서비스", "혜택"], ["커피", "5%"], role="HEADER") == set()
    got = row(["구분", "혜택"], ["온라인", "5% 포인트 미적립"])
    assert not any(f == "benefit" for f, _, _ in got) and any(f == "condition" and "미적립" in t for f, _, t in got)
    assert not any(f == "benefit" or h for f, h, _ in row(["구분", "혜택"], ["마일리지 적립", "×"]))
    got = row(["구분", "혜택"], ["쇼핑", "국내 5% 할인(무이자할부 제외)"])
    assert ("benefit", True, "쇼핑") not in got or any(f == "benefit" and "5% 할인" in t for f, _, t in got)
    assert ("benefit", False, "쇼핑 | 국내 5% 할인(무이자할부 제외)") in got and any(f == "condition" and "무이자할부 제외" in t for f, _, t in got)
    got = row(["대상", "조건", "할인"], ["주유", "전월 30만원 이상", "60원/ℓ 할인 10%"])
    assert ("condition", False, "전월 30만원 이상") in got and any(f == "benefit" and not h and t.startswith("주유") for f, h, t in got)
    assert row(["구분", "금액"], ["본인 연회비", "10,000원"]) == {("annual_fee", False, "| 본인 연회비 | 10,000원 |")}
    got = row(["혜택", ""], ["10% 할인", "5% 적립"])  # a blank header takes the one before it
    assert {("benefit", False, "10% 할인"), ("benefit", False, "5% 적립")} <= got
    assert summary.candidates(spark.createDataFrame([], SUMMARY)).count() == 0


def test_evaluation(spark, monkeypatch):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q", "b", 2), ("q", "z", 1), ("r", "a", 1)], "query_id string, id string, relevance int")
    got = {r.query_id: r for r in evaluation.ir_metrics(run, gold).collect()}
    ideal = 3 + 1 / math.log2(3)
    assert (got["q"].recall, got["q"].mrr) == (0.5, 0.5) and got["q"].ndcg == pytest.approx(3 / math.log2(3) / ideal) and got["r"].ndcg == 0
    v = np.array([0.1, np.nan, 0.5, 0.9])
    mean, low, high = evaluation.bootstrap_interval(v, 1, "x")
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(b"1:x").digest()[:8], "big")))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        means = np.nanmean(v[rng.integers(0, 4, (2000, 4))], axis=1)
    assert (low, high) == tuple(round(float(x), 12) for x in np.nanquantile(means, [0.025, 0.975]))
    monkeypatch.setattr(evaluation, "DRAWN", 28)  # in blocks, the same draws
    assert mean == 0.5 and low <= mean <= high and evaluation.bootstrap_interval(v, 1, "x") == (mean, low, high)
    with pytest.raises(ValueError):
        evaluation.bootstrap_interval(v, 1, "x", 10)
    assert evaluation.winner({("a", "b"): 0.1, ("a", "c"): 0.2, ("b", "a"): -0.3, ("b", "c"): 0.1, ("c", "a"): -1, ("c", "b"): -1}) == "a"
    assert evaluation.winner({("a", "b"): -0.1, ("b", "a"): -0.1}) is None
    assert evaluation.release_gate({"ndcg": 0.1}, 0.96, 0) == [] and len(evaluation.release_gate({"ndcg": 0.0}, 0.5, 1)) == 3


def test_draws_are_those_of_the_generator():
    """Stretches found by jumping ahead, with many numbers passed over, make the same indices."""
    for n in (2, 7, 1000, 3_000_000_000):
        want = np.random.Generator(evaluation._generator(5, "c")).integers(0, n, 4000)
        got = np.concatenate([evaluation._drawn(evaluation._halves(5, "c", a, 333), n) for a in range(0, 9990, 333)])
        assert (got[:4000] == want).all() and len(got) <= 9990
    assert len(evaluation._drawn(evaluation._halves(5, "c", 0, 9999), 3_000_000_000)) < 8000


@pytest.mark.parametrize("halves", [1 << 21, 1000])
def test_bootstrap_in_tasks(spark, halves):
    """Means and intervals equal to those of one task, also with nulls, one query, or none known."""
    rng = np.random.default_rng(6)
    rows_ = [("a", f"q{i:04d}", float(rng.random()), None if i % 3 else float(rng.random()), float("nan")) for i in range(137)] + [("b", "q", 0.25, 0.5, None)]
    df = spark.createDataFrame(rows_, "lane string, query_id string, recall double, ndcg double, mrr double").repartition(4)
    got = {(r.lane, r.metric): (r.n, r["mean"], r.low, r.high) for r in evaluation.bootstrap(df, 7, halves=halves).collect()}
    assert len(got) == 6
    for lane in "ab":
        for k, metric in enumerate(evaluation.METRICS):
            v = np.array([np.nan if r[2 + k] is None else r[2 + k] for r in sorted(r for r in rows_ if r[0] == lane)])
            want = evaluation.bootstrap_interval(v, 7, f"{lane}:{metric}") if np.isfinite(v).any() else (None, None, None)
            assert got[lane, metric] == (len(v), *want), (lane, metric)
    with pytest.raises(ValueError):
        evaluation.bootstrap(df, 7, samples=5)


def test_checks_find_faults(spark):
    nodes = spark.createDataFrame([(1, "root", None, "ROOT"), (1, "x", "gone", "ITEM"), (1, "l", "root", "PARAGRAPH"), (1, "y", "l", "ITEM"), (2, "a", None, "ROOT"), (2, "b", None, "ROOT")], "document int, node string, parent string, node_type string")
    assert {(r.document, r.rule) for r in V.wrong_tree(nodes).collect()} == {(1, "parent present"), (1, "leaf without children"), (2, "one root")}
    links = spark.createDataFrame([(1, "l", "l", "NEXT"), (1, "l", "root", "OTHER"), (1, "l", "none", "NEXT"), (1, "l", "root", "NEXT")], "document int, from_node string, to_node string, link_type string")
    assert V.wrong_links(links, nodes).count() == 3
    pages = spark.createDataFrame([(1, 1, "ab cd")], "document int, page int, text string")
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    spans = spark.createDataFrame([(1, 1, 0, 2, h("ab")), (1, 1, 3, 9, h("cd")), (1, 1, 3, 5, h("xx")), (2, 1, 0, 1, h("a"))], "document int, page int, start int, end int, text_sha256 string")
    assert V.wrong_spans(spans, pages).count() == 3 and V.overlapping_spans(spans).count() == 1
    assert V.uncovered(spans.limit(1), pages).count() == 1
    vec = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, [float("nan"), 0.0]), (4, None), (5, [1.0])], "id int, embedding array<float>")
    assert rows(V.wrong_vectors(vec, 2), "id") == [(2,), (3,), (4,), (5,)]
    assert V.schema_differences(pages, [("document", "int"), ("page", "bigint"), ("text", "string"), ("x", "int")]) == ["missing x", "page is int, not bigint"]
    rev = spark.createDataFrame([("l", "a", "b", "current"), ("l", "b", "a", "current"), ("m", "c", "a", "superseded")], "lineage string, revision string, supersedes string, temporal_status string")
    assert rows(V.wrong_supersession(rev), "revision", "rule") == [("a", "cycle"), ("b", "cycle"), ("c", "other lineage")] and rows(V.wrong_status(rev), "lineage") == [("l",), ("m",)]
    launch = spark.createDataFrame([("a", D(2024, 1, 1), "confirmed"), ("b", D(2024, 1, 1), "missing"), ("c", D(2024, 1, 1), "confirmed")], "revision string, launch_date date, launch_status string")
    evidence = spark.createDataFrame([("a", "2024-01-01")], "revision string, normalized_value string")
    assert rows(V.wrong_launch_evidence(launch, evidence)) == [("b",), ("c",)]
    with pytest.raises(Exception, match="unmatched position"):
        V.zipped(pages, pages.withColumn("page", F.lit(2)), "page").collect()


def test_cycles_of_any_length(spark):
    links = [(f"r{i}", f"r{i - 1}") for i in range(1, 12)] + [("r0", None), ("x", "x"), ("y", "gone")]
    links += [("c0", "c2"), ("c1", "c0"), ("c2", "c1"), ("behind", "c1"), ("far", "behind")] + [(f"d{i}", f"d{(i + 1) % 7}") for i in range(7)]
    rev = spark.createDataFrame([("l", a, b) for a, b in links], "lineage string, revision string, supersedes string")
    want = [("behind",)] * 0 + sorted([("x",), ("c0",), ("c1",), ("c2",)] + [(f"d{i}",) for i in range(7)])
    assert rows(V.on_cycles(rev)) == want
    assert rows(V.wrong_supersession(rev).where("rule <> 'cycle'"), "revision", "rule") == [("y", "absent")]
    assert V.on_cycles(rev.where("revision LIKE 'r%'")).count() == 0 and V.on_cycles(rev.limit(0)).count() == 0


def test_tree_ordinals(spark):
    good = [(1, "root", None, "ROOT", 0), (1, "s", "root", "MAJOR_SECTION", 1), (1, "l", "s", "PARAGRAPH", 2)]
    kind = "document int, node string, parent string, node_type string, ordinal int"
    assert V.wrong_tree(spark.createDataFrame(good, kind)).count() == 0
    bad = [*good, (2, "root", None, "ROOT", 1), (2, "s", "root", "ITEM", 0), (3, "root", None, "ROOT", 0), (3, "a", "root", "ITEM", 3), (3, "b", "a", "PARAGRAPH", 2)]
    got = {(r.document, r.node, r.rule) for r in V.wrong_tree(spark.createDataFrame(bad, kind)).collect()}
    assert got == {(2, "root", "root first"), (2, "s", "parent before child"), (3, "b", "contiguous ordinals"), (3, "a", "contiguous ordinals"), (3, "b", "parent before child")}
    pages = spark.createDataFrame([(1, 1, "# 혜택\n- 할인\n| a | b |\n| 1 | 2 |\n## 유의\nx\n"), (2, 1, "x\n")], "document int, page int, text string")
    assert V.wrong_tree(S.nodes(S.parse(pages))).count() == 0


def test_deep_closure(spark):
    chain = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(70)], "document int, from_node string, to_node string")
    assert graph.closure(spark.createDataFrame([(1, "n0")], "document int, node string"), chain).agg(F.max("depth")).first()[0] == 70


def test_queries_beyond_one_matrix(spark, monkeypatch):
    from quillon.functions import vectors

    monkeypatch.setattr(vectors, "MAX_QUERY_VALUES", 5)
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    assert rows(vectors.score_blocks(df, [(k, [float(k), 1.0]) for k in range(7)])) == sorted([(1, k, 3.0 * k + 4) for k in range(7)] + [(2, k, float(k)) for k in range(7)], key=str)


def test_caches_and_turns(spark):
    at = lambda d: D(2024, 1, d)
    entries = spark.createDataFrame([("a", 10, at(1)), ("b", 20, at(2)), ("c", 30, at(3)), ("d", 40, at(4))], "k string, bytes int, stored date")
    uses = spark.createDataFrame([("a", at(9)), ("a", at(5)), ("b", at(3)), ("zz", at(9))], "k string, used date")
    assert rows(temporal.recently_used(entries, uses, ["k"], 3), "k") == [("a",), ("b",), ("d",)]  # b and c tie, and keys decide
    assert rows(temporal.recently_used(entries, uses, ["k"], 3, "bytes", 50), "k") == [("a",), ("d",)]
    objects = spark.createDataFrame([("p1", 5, at(1)), ("p2", 5, at(2)), ("p3", 5, at(3)), ("p4", 5, at(4))], "path string, bytes int, last_used date")
    keep = spark.createDataFrame([("p1",)], "path string")
    assert rows(temporal.pruned(objects, keep), "path") == [("p2",), ("p3",), ("p4",)] and rows(temporal.pruned(objects, keep, 10), "path") == [("p2",)]
    pool = spark.createDataFrame([("kb", 2), ("bc", 1), ("hana", 3)], "issuer string, place int")
    days = spark.createDataFrame([(at(d),) for d in (1, 2, 3, 5)], "day date")
    assert rows(temporal.rotation(pool, days)) == [(at(1), "bc"), (at(2), "hana"), (at(3), "kb"), (at(5), "bc")]
    ledger, turn = [], lambda d: [tuple(r) for r in temporal.next_turn(pool, spark.createDataFrame(ledger, "issuer string, day string, attempt int"), d).collect()]
    for day, want in (("2024-01-01", ("bc", 1)), ("2024-01-01", ("bc", 2)), ("2024-01-02", ("kb", 1)), ("2024-01-03", ("hana", 1)), ("2024-01-04", ("bc", 1)), ("2024-01-04", ("bc", 2)), ("2024-01-04", ("bc", 3))):
        assert turn(day) == [want]
        ledger.append((want[0], day, want[1]))
    assert turn("2024-01-04") == [] and turn("2024-01-05") == [("kb", 1)]


def test_issuer_profiles(spark):
    pages = [(1, 1, "■ 안내 사항\n□ 커피\n국민카드 안내\n1 / 2\n", "kb"), (1, 2, "x\n국민카드 안내\n", "kb"), (2, 1, "Ⅰ 처음\n1. 하나\n○ 둘\n", "woori"), (3, 1, "◆ 처음\n● 하나\nⅠ 셋\n", "lotte"), (4, 1, "■ 처음\n□ 하나\n", None)]
    p = S.parse(spark.createDataFrame(pages, "document int, page int, text string, issuer string")).collect()
    kinds = {(r.document, r.visible): r.heading for r in p}
    assert [kinds[1, "■ 안내 사항"], kinds[1, "□ 커피"], kinds[2, "Ⅰ 처음"], kinds[2, "1. 하나"], kinds[2, "○ 둘"], kinds[3, "◆ 처음"], kinds[3, "● 하나"], kinds[3, "Ⅰ 셋"], kinds[4, "■ 처음"]] == ["major", "item", "major", "item", None, "major", "item", None, None]
    assert {r.node_type for r in p if r.visible == "국민카드 안내"} == {"BOILERPLATE"}


def test_lines_of_every_kind(spark):
    texts = ["a\nb\r\nc", "a\rb\x0cc\n", "", "\n", "x\u2028y", "a\r\n\r\nb\n", "\r", None]
    got = S.lines(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "document int, page int, text string")).orderBy("document", "line_no").collect()
    for i, t in enumerate(texts):
        assert [r.line for r in got if r.document == i] == (t or "").splitlines(keepends=True)
        assert [r.visible for r in got if r.document == i] == (t or "").splitlines()
        assert all((t or "")[r.start : r.end] == r.line for r in got if r.document == i)


def test_cycles_end_with_the_longest_chain(spark, monkeypatch):
    from quillon.operators import validation

    steps = []
    monkeypatch.setattr(validation, "held", lambda df: (steps.append(1), df.localCheckpoint())[1])
    # chains of 1, 5 and 13 links, a cycle of 3 with a tail of 6, one of 1 and one of 7
    links = [(1, 0)] + [(100 + i, 99 + i) for i in range(5)] + [(200 + i, 199 + i) for i in range(13)]
    links += [(300, 302), (301, 300), (302, 301), (303, 302)] + [(304 + i, 303 + i) for i in range(5)] + [(400, 400)] + [(500 + i, 500 + (i + 1) % 7) for i in range(7)]
    links += [(1000 + i, None) for i in range(5)] + [(10_000 + i, 20_000 + i) for i in range(2000)]  # many links that end at once
    rows = spark.createDataFrame(links, "revision long, supersedes long")
    assert sorted(r.revision for r in validation.on_cycles(rows).collect()) == [300, 301, 302, 400, *range(500, 507)]
    assert len(steps) <= 7  # log of the chains' length, not of the number of links


def test_a_parse_deals_documents_by_their_lines(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_LINES", 30)
    pages = spark.createDataFrame([(d, p, "| a | b |\n| - | - |\nx\n") for d in range(60) for p in (1, 2)], "document int, page int, text string")
    parsed = S.parse(pages)
    assert parsed.rdd.getNumPartitions() == 16  # 480 lines
    assert parsed.count() == 360
