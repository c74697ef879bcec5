"""Queries that run over whole tables: the rows they reach."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.catalogue import QUERIES
from quillon.functions import vectors

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_sort_and_sets_reach_every_row(spark):
    part, customer = spark.read.parquet(f"{SF}/part.parquet"), spark.read.parquet(f"{SF}/customer.parquet")
    got = [(int(r.p_brand.removeprefix("Brand#")), r.p_partkey) for r in QUERIES["version_sort"](spark, SF).orderBy("rank").collect()]
    assert len(got) == part.count() and got == sorted(got)
    less, both = ({r.c_custkey for r in QUERIES[f"set_{x}"](spark, SF).collect()} for x in ("difference", "intersection"))
    assert less and both and not less & both and less | both == {r.c_custkey for r in customer.collect()}


def test_searches_ask_every_hundredth_row(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = {r.vec_id for r in e.where("vec_id % 100 = 0").collect()}
    assert len(asked) > 1
    assert {r.query_id for r in QUERIES["multi_query_scores"](spark, SF).select("query_id").distinct().collect()} == asked
    for name in ("ir_metrics", "span_recall"):
        assert {r.query_id for r in QUERIES[name](spark, SF).collect()} == asked
    assert {r.n for r in QUERIES["bootstrap_ci"](spark, SF).collect()} == {len(asked)}


def test_no_query_is_empty(spark):
    """An operator that always returned nothing would differ from its oracle."""
    empty = [name for name in sorted(QUERIES) if name.startswith(("check_", "rank_re", "section_")) and not QUERIES[name](spark, SF).limit(1).count()]
    assert empty == []


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).round(1)
    x[50:120] = x[3]  # ties
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    asked = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    x = x.astype(np.float32).astype(np.float64)
    got = vectors.score_pairs(df, asked, "id")
    assert got.count() == 300 * 30
    assert all(abs(r.score - x[r.id] @ x[r.query_id]) < 1e-9 for r in got.collect())
    kept = {}
    for r in vectors.score_pairs(df, asked, "id", best=10).collect():
        kept.setdefault(r.query_id, []).append((-round(r.score, 6), r.id))
    for q in range(0, 300, 10):
        assert sorted(kept[q])[:10] == sorted((-round(float(x[i] @ x[q]), 6), i) for i in range(300))[:10]
    assert vectors.score_pairs(df, asked.where("query_id < 0"), "id").count() == 0
    assert vectors.score_pairs(df.where(F.col("id") < 0), asked, "id").count() == 0


@pytest.mark.parametrize("name", ["asked_lane_max", "multi_query_scores"])
def test_no_pair_is_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Repartition" not in above and "Join" not in above
    assert plan.count("Generate explode") == 1  # queries are copied a block, rows are not


def test_best_of_groups_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 30)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(200, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, f"g{i % 23}", [float(v) for v in r]) for i, r in enumerate(x)], "id long, g string, embedding array<float>")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {(q, f"g{g}"): max((x[i] @ x[q], -i) for i in range(g, 200, 23)) for q in range(0, 200, 10) for g in range(23)}
    got = vectors.score_pairs(df, asked, "id", places=6, together=("g",), keep=lambda rows: vectors.group_best(rows, ["g"])).collect()
    assert len(got) == len(want) and {(r.query_id, r.g): (r.score, -r.id) for r in got} == want
    kept = {}
    for r in vectors.score_pairs(df, asked, "id", best=5, places=6).collect():
        kept.setdefault(r.query_id, []).append((-r.score, r.id))
    assert all(len(v) <= 5 * 7 and sorted(v)[:5] == sorted((-(x[i] @ x[q]), i) for i in range(200))[:5] for q, v in kept.items())  # so many a block, whatever the ties
    assert vectors.rounded(np.array([0.25, -0.25, -1e-9]), 1).tolist() == [0.3, -0.3, 0.0]
