"""The persisted lexical index against the scan, with blocks left out."""

import random

from pyspark.sql import functions as F

from quillon.operators import retrieval
from quillon.sources import lexical

DOCS = "id long, text string"


def test_index_gives_the_ranks_of_the_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["the", "Café", "of", "naïve", "x1"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, weights=[40, 5, 30, 3, 2] + [1] * 200, k=rng.randint(1, 60)))) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, " .,! "), (7, "the cafe of a second text"), (7, "the cafe of a second text"), (None, "the of nothing"), (6000, "the of " * 30)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    lexical.build(docs, str(tmp_path / "i"), block_rows=64)
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"))
    assert index.stats.first().n == len(rows)
    queries = ("the of", "CAFE naive", "w1 w2", "the", "nowhere the")
    asked = spark.createDataFrame([(q, retrieval.query_tokens(q)) for q in queries], "query_id string, words array<string>")
    first, whole = index.search(asked, 10, places=6).collect(), index.search(asked, 5000, places=6).collect()
    every, some = index.matching(asked).collect(), index.matching(asked, every=False).collect()
    ids = lambda rows_: sorted(r.id or -1 for r in rows_)
    for query in queries:
        want = [(r.id, r.score) for r in retrieval.bm25(docs, query).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").collect()]
        for k, found in ((10, first), (5000, whole)):
            got = sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])
            assert [(r.id, r.score) for r in got] == want[:k] and [r["rank"] for r in got] == list(range(1, len(got) + 1)), (query, k)
        assert ids(r for r in every if r.query_id == query) == ids(retrieval.match_all(docs, query).collect())
        assert ids(r for r in some if r.query_id == query) == ids(retrieval.match_any(docs, query).collect())
    asked = spark.createDataFrame([("q", ["w1", "the"]), ("empty", []), ("none", ["nowhere"])], "query_id string, words array<string>")
    blocks = index.blocks(asked, 3).where("query_id = 'q'")
    assert 0 < blocks.where("live").count() < blocks.count()  # some blocks are left out
    assert {r.query_id for r in index.search(asked, 3).collect()} == {"q"}
    plan = index.search(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan  # no text is read


def test_empty_index(spark, tmp_path):
    lexical.build(spark.createDataFrame([], DOCS), str(tmp_path / "e"))
    index = lexical.LexicalIndex(spark, str(tmp_path / "e"))
    assert index.search(spark.createDataFrame([("q", ["a"])], "query_id string, words array<string>"), 3).collect() == []


def test_queries_stream_past_compact_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "HELD_BLOCKS", 2)
    rows = [(i, " ".join(["a"] * (300 if i == 7 else 1 + i % 3) + ["b"] * (i % 2) + [f"c{i}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    lexical.build(docs, str(tmp_path / "i"), block_rows=16)
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"))
    sizes = index.postings.where("token = 'a'").selectExpr("sum(n) n", "sum(length(places)) p", "max(max_tf) m", "sum(length(tfs)) t").first()
    assert sizes.n == 200 and sizes.p == 400 and sizes.m == 300 and 200 < sizes.t <= 200 + 3 * 16  # three bytes a posting, but for the block of a long text
    asked = spark.createDataFrame([(q, ["a", "b"]) for q in range(5)] + [(5, ["b", "a", "b"]), (6, ["b", "c0"]), (7, ["z"])], "query_id int, words array<string>")
    best = {}
    for r in index.search(asked, 4, places=6).collect():
        best.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(best) == [0, 1, 2, 3, 4, 5] and len({tuple(sorted(v)) for v in best.values()}) == 1  # one set of words, asked six times
    want = retrieval.bm25(docs, "a b").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(4).collect()
    assert [r[1:] for r in sorted(best[0])] == [tuple(r) for r in want]
    assert {r.query_id: r.texts for r in index.counts(asked).collect()} == {q: 100 for q in range(6)}
    assert {r.query_id: r.texts for r in index.counts(asked, every=False).collect()} == {**{q: 200 for q in range(6)}, 6: 101}
    plan = index.search(asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "places" not in above and above.count("Join") == 1  # postings are not joined with queries
