"""What the parse of lines costs, and that no line is lost."""

from pyspark.sql import functions as F

from quillon.catalogue import QUERIES
from quillon.functions import text as X
from quillon.operators import structure as S
from quillon.plans import structure_queries


def lineitem(spark, path, sizes):
    """A folder with a lineitem table of so many items an order."""
    rows = [(order, i + 1, 1000 + i, 7) for order, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_an_order_of_many_items_keeps_them_all(spark, tmp_path):
    sf = lineitem(spark, tmp_path, {1: 1, 2: 2, 3: 3, 4: 250})
    got = {(r.document, r.role, r.continued): r.n for r in QUERIES["table_blocks"](spark, sf).collect()}
    assert got[4, "BODY", True] == 248 and got[3, "BODY", True] == 1 and (2, "BODY", True) not in got
    assert sorted(r.document for r in QUERIES["table_fragmentation"](spark, sf).collect()) == [3, 4]


def test_a_parse_sorts_its_lines_three_times(spark):
    pages = spark.createDataFrame([(d, p, "# a\n| a | b |\n| - | - |\nx\n1 / 2\n") for d in range(5) for p in (1, 2)], "document int, page int, text string")
    plan = S.parse(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 3 and plan.count("Exchange") == 1 and "Python" not in plan


def test_line_items_are_dealt_once_and_only_blocks_are_held(spark, tmp_path, monkeypatch):
    sf = lineitem(spark, tmp_path, {k: k % 7 + 1 for k in range(300)})
    monkeypatch.setattr(S, "PART_LINES", 100)
    plan = QUERIES["table_blocks"](spark, sf)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and plan.rdd.getNumPartitions() == 24  # 1,197 items, 50 a task
    kept = []
    monkeypatch.setattr(structure_queries, "held", lambda df: (kept.append(df), df)[1])
    assert QUERIES["table_fragmentation"](spark, sf).count() == sum(k % 7 + 1 > 2 for k in range(300))
    assert kept[0].columns == ["document", "page", "table", "start", "end"] and kept[0].count() == sum(1 + (k % 7 + 1 > 2) for k in range(300))


def test_headers_behind_separators_and_over_pages(spark):
    pages = [
        (1, 1, "|---|---|\n| ---- | --- |\n| :---: | ---: |\n| a | b |\n| 1 | 2 |\n"),
        (1, 2, "\n| 3 | 4 |\n|---|---|\n| 5 | 6 |\n"),  # its second line declares a header of its own
        (1, 3, "| 7 | 8 |\n\n|---|---|\nx\n| c | d |"),  # goes on; then a table of separators alone, which has no header
    ]
    p = S.parse(spark.createDataFrame(pages, "document int, page int, text string")).orderBy("seq").collect()
    rows = [(r.page, r.role, r.continued, r.headers) for r in p if r.table >= 0]
    ab, own, cd = ["a", "b"], ["3", "4"], ["c", "d"]
    assert rows[:5] == [(1, "SEPARATOR", False, ab), (1, "SEPARATOR", False, ab), (1, "SEPARATOR", False, ab), (1, "HEADER", False, ab), (1, "BODY", False, ab)]
    assert rows[5:] == [(2, "HEADER", False, own), (2, "SEPARATOR", False, own), (2, "BODY", False, own), (3, "BODY", True, own), (3, "SEPARATOR", False, own), (3, "HEADER", False, cd)]


def test_lines_are_cut_as_python_cuts_them(spark):
    texts = ["", "a", "\n\n", "a\r\n\rb\x0b\x0cc\x1c\x1d\x1e\x85d e f", "‧‪\x1f\t|\x7f\xa0 \U0001f600가\n￾", "가 나\r\n다 ~\r", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.split_lines(F.col("t"), X.LINE_ENDS).alias("a"), X.python_lines(F.col("t")).alias("b"))
    assert all((r.a or []) == r.b for r in df.collect())
