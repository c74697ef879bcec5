"""Retrieval quality: ranking and set metrics per query, slices, paired deltas, bootstrap intervals and gates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import canonical_json
from quillon.holding import held

METRICS = ("recall", "ndcg", "mrr")


def ir_metrics(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """recall@k, nDCG@k (gain 2^rel - 1, discount log2(rank + 1)) and MRR@k of each query with gold.

    run: (query_id, id, rank); gold: (query_id, id, relevance > 0).  Queries without gold are absent.
    """
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    hits = run.where(F.col("rank") <= k).join(gold, ["query_id", "id"])
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))
    best = gold.withColumn("r", ideal_rank)
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"))
    got = ideal.join(per, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select("query_id", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"), z(F.col("dcg") / F.col("idcg")).alias("ndcg"), z(1.0 / F.col("first")).alias("mrr"))


def set_metrics(answers: DataFrame) -> DataFrame:
    """Precision, recall and exactness of array columns (query_id, gold, found); null where there is nothing to divide by."""
    both = F.size(F.array_intersect("gold", "found"))
    n = lambda c: F.size(F.array_distinct(c))
    return answers.select("query_id", F.when(n("found") > 0, both / n("found")).alias("precision"), F.when(n("gold") > 0, both / n("gold")).alias("recall"), (F.size(F.array_except("gold", "found")) + F.size(F.array_except("found", "gold")) == 0).alias("exact"))


def co_retrieval(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """Share of condition groups (query_id, group, at_k, span) whose spans all stand within their first at_k ranks."""
    hit = groups.join(spans.select("query_id", "span", "rank"), ["query_id", "span"], "left").withColumn("ok", F.coalesce(F.col("rank") <= F.col("at_k"), F.lit(False)))
    per = hit.groupBy("query_id", "group").agg(F.bool_and("ok").alias("ok"))
    return per.groupBy("query_id").agg(F.avg(F.col("ok").cast("double")).alias("co_retrieval"))


def critical_errors(rows: DataFrame) -> DataFrame:
    """Critical errors of each lane from flag columns of its queries."""
    omitted = F.count_if(F.col("high_risk") & F.col("numeric_omitted"))
    return rows.groupBy("lane").agg(omitted.alias("numeric_omissions"), F.count_if("condition_omitted").alias("condition_omissions"), F.count_if("revision_wrong").alias("revision_errors"), F.count_if(F.col("answered") & F.col("no_answer")).alias("no_answer_false_positives"))


def by_slice(metrics: DataFrame, members: DataFrame, names=METRICS) -> DataFrame:
    """Mean metrics of each slice; a query belongs to all its slices (query_id, slices)."""
    each = members.select("query_id", F.explode("slices").alias("slice"))
    return metrics.join(each, "query_id").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in names])


def paired_deltas(candidate: DataFrame, reference: DataFrame, names=METRICS) -> DataFrame:
    """Candidate minus reference of each query; null where either is null."""
    a = candidate.select("query_id", *[F.col(m).alias(f"a_{m}") for m in names])
    b = reference.select("query_id", *[F.col(m).alias(f"b_{m}") for m in names])
    return a.join(b, "query_id").select("query_id", *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in names])


DRAWN = 4_000_000  # indices drawn at a time (32 MB)


def bootstrap_interval(values: np.ndarray, seed: int, context: str, samples: int = 2_000) -> tuple[float, float, float]:
    """Mean and the 95 % interval of the mean over resampled queries; PCG64 seeded by SHA-256 of seed and context."""
    if samples < 2_000:
        raise ValueError("at least 2000 samples")
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"{seed}:{context}".encode()).digest()[:8], "big")))
    there = np.isfinite(values)
    known, n, means = np.where(there, values, 0.0), len(values), []
    step = max(1, DRAWN // max(1, n))
    for at in range(0, samples, step):  # the stream of draws is the same in any blocks
        drawn = rng.integers(0, n, (min(step, samples - at), n))
        counts = there[drawn].sum(1)
        means.append(known[drawn].sum(1)[counts > 0] / counts[counts > 0])
    low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
    return round(float(known.sum() / there.sum()), 12), round(float(low), 12), round(float(high), 12)


HALVES = 1 << 21  # 32-bit numbers of the stream that a task reads


def _generator(seed: int, context: str) -> np.random.PCG64:
    return np.random.PCG64(int.from_bytes(hashlib.sha256(f"{seed}:{context}".encode()).digest()[:8], "big"))


def _halves(seed: int, context: str, start: int, n: int) -> np.ndarray:
    """Numbers ``start`` .. of the generator's stream of 32-bit halves, found by jumping ahead."""
    g = _generator(seed, context)
    g.advance(start // 2)
    return g.random_raw((start + n + 1) // 2 - start // 2).view(np.uint32)[start % 2 :][:n]


def _drawn(halves: np.ndarray, n: int) -> np.ndarray:
    """Indices below n that ``integers`` makes of a stretch of halves: high words of products, low ones below a bound being passed over."""
    wide = halves.astype(np.uint64) * np.uint64(n)
    return (wide >> np.uint64(32)).astype(np.int64)[(wide & np.uint64(0xFFFFFFFF)) >= np.uint64(((1 << 32) - n) % n)]


def bootstrap(metrics: DataFrame, seed: int, key: str = "lane", names=METRICS, samples: int = 2_000, halves: int = HALVES) -> DataFrame:
    """(key, metric, n, mean, low, high) as ``bootstrap_interval`` gives them, its draws split over tasks.

    The stream of a (key, metric) is cut into stretches; a task jumps to its own.  How many numbers of each are passed over is counted first, so every resample knows where its draws begin;
    then resamples are made in blocks, each by a task that holds one number a query.  Only the means, ``samples`` a (key, metric), meet again.
    """
    if samples < 2_000:
        raise ValueError("at least 2000 samples")
    kind = dict(metrics.dtypes)[key]
    long = metrics.select(key, "query_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))
    vectors = long.groupBy(key, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "value"))), lambda x: x["value"]).alias("v"))  # one number a query
    vectors = held(vectors.withColumn("n", F.size("v").cast("long")).withColumn("known", F.exists("v", lambda x: x.isNotNull() & ~F.isnan(x))))
    # a little more than the draws, for those passed over
    stretches = F.when(F.col("known") & (F.col("n") > 1), F.ceil((F.col("n") * samples * (1 + 8 * F.col("n") / F.lit(float(1 << 32))) + 64) / halves).cast("long")).otherwise(F.lit(0).cast("long"))
    pieces = vectors.where(stretches > 0).select(key, "metric", "n", F.explode(F.sequence(F.lit(0).cast("long"), stretches - 1)).alias("piece"))

    def counted(batches):
        for b in batches:
            rows = zip(b.column("context").to_pylist(), b.column("n").to_pylist(), b.column("piece").to_pylist(), strict=True)
            made = [len(_drawn(_halves(seed, c, p * halves, halves), n)) for c, n, p in rows]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("metric"), b.column("piece"), pa.array(made, pa.int64())], names=[key, "metric", "piece", "made"])

    context = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("metric")).alias("context")
    dealt = pieces.select(key, "metric", "n", "piece", context).repartition(F.col(key), F.col("metric"), F.col("piece"))
    made = dealt.mapInArrow(counted, f"{key} {kind}, metric string, piece long, made long")
    made = made.groupBy(key, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "made"))), lambda x: x["made"]).alias("made"))  # a number a stretch
    block = F.greatest(F.lit(1), F.floor(F.lit(halves) / F.greatest(F.col("n"), F.lit(1)))).cast("long")
    blocks = vectors.where("known").join(made, [key, "metric"], "left").withColumn("block", block).select(key, "metric", "n", "v", "made", context, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"), F.col("block"))).alias("at"))

    def means(batches):
        for b in batches:
            for k, row in enumerate(b.select(["n", "v", "made", "context", "block", "at"]).to_pylist()):
                n, at, m = row["n"], row["at"], min(row["block"], samples - row["at"])
                v = np.array([np.nan if x is None else x for x in row["v"]])
                there = np.isfinite(v)
                known = np.where(there, v, 0.0)
                if n == 1:
                    drawn = np.zeros((m, 1), np.int64)
                else:
                    upto = np.concatenate([[0], np.cumsum(row["made"])])
                    p = int(np.searchsorted(upto, at * n, "right")) - 1
                    skip, parts, have = at * n - int(upto[p]), [], -(at * n - int(upto[p]))
                    while have < m * n:
                        parts.append(_drawn(_halves(seed, row["context"], p * halves, halves), n))
                        have, p = have + len(parts[-1]), p + 1
                    drawn = np.concatenate(parts)[skip : skip + m * n].reshape(m, n)
                counts = there[drawn].sum(1)
                got = known[drawn].sum(1)[counts > 0] / counts[counts > 0]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(key)[k].as_py()] * len(got), b.schema.field(key).type), pa.array([b.column("metric")[k].as_py()] * len(got), pa.string()), pa.array(got)], names=[key, "metric", "m"])

    def ends(group: pa.Table) -> pa.Table:
        low, high = np.quantile(group["m"].to_numpy(), [0.025, 0.975])
        return pa.table({key: group[key].slice(0, 1), "metric": group["metric"].slice(0, 1), "low": [round(float(low), 12)], "high": [round(float(high), 12)]})

    resampled = blocks.repartition(F.col(key), F.col("metric"), F.col("at")).mapInArrow(means, f"{key} {kind}, metric string, m double")
    intervals = resampled.groupBy(key, "metric").applyInArrow(ends, f"{key} {kind}, metric string, low double, high double")

    def averaged(batches):
        for b in batches:
            v = [np.array([np.nan if x is None else x for x in row]) for row in b.column("v").to_pylist()]
            mean = [round(float(np.where(np.isfinite(x), x, 0.0).sum() / np.isfinite(x).sum()), 12) if np.isfinite(x).any() else None for x in v]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("metric"), b.column("n"), pa.array(mean, pa.float64())], names=[key, "metric", "n", "mean"])

    means_of = vectors.select(key, "metric", "n", "v").mapInArrow(averaged, f"{key} {kind}, metric string, n long, mean double")
    return means_of.join(intervals, [key, "metric"], "left").select(key, "metric", "n", "mean", "low", "high")


def blind_preferences(ratings: DataFrame) -> DataFrame:
    """(wins, losses, ties, mean) of the candidate from blind ratings: +1, 0, -1 a rating, averaged by query first."""
    sign = F.when(F.col("preferred") == F.col("candidate_position"), 1).when(F.col("preferred") == "tie", 0).otherwise(-1)
    per = ratings.groupBy("query_id").agg(F.avg(sign).alias("score"))
    return per.agg(F.count_if(F.col("score") > 0).alias("wins"), F.count_if(F.col("score") < 0).alias("losses"), F.count_if(F.col("score") == 0).alias("ties"), F.round(F.avg("score"), 12).alias("mean"))


def winner(lows: dict[tuple[str, str], float]) -> str | None:
    """The policy whose delta interval lies above 0 against every other; lows: (candidate, reference) -> lower end."""
    names = {n for pair in lows for n in pair}
    best = [c for c in sorted(names) if all(lows.get((c, r), float("-inf")) > 0 for r in names - {c})]
    return best[0] if len(best) == 1 else None


def release_gate(intervals: dict[str, float], co_retrieval: float, critical: int, least: float = 0.95) -> list[str]:
    """Reasons against a release; none means it passes."""
    reasons = [f"{m}: interval reaches 0" for m, low in sorted(intervals.items()) if low <= 0]
    if co_retrieval < least:
        reasons.append("condition co-retrieval below the gate")
    if critical:
        reasons.append("critical errors")
    return reasons


def report_id(report: dict) -> str:
    return hashlib.sha256(canonical_json(report).encode()).hexdigest()


def stratified_draft(rows: DataFrame, seed: str, per_issuer: int, slices: list[str]) -> list[dict]:
    """A reproducible draft of gold questions: per issuer, slices in turn, least used first, then slice score, then stable hash.

    The pool is cut to what can be picked on the cluster (per issuer and slice, the best per_issuer * number of slices); the
    sequential choice among those runs on the driver.
    """
    from quillon.functions.text import stable_rank

    pool = rows.withColumn("order", stable_rank(seed, F.col("issuer"), F.col("id"))).withColumn("slice", F.explode("slices")).where(F.col("slice").isin(*slices))
    w = Window.partitionBy("issuer", "slice").orderBy(F.desc("slice_score"), "order")
    short = pool.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_issuer * len(slices)).collect()
    picked, used = [], {}
    for issuer in sorted({r.issuer for r in short}):
        taken: set = set()
        turn = 0
        while len(taken) < per_issuer:
            left = [r for r in short if r.issuer == issuer and r.id not in taken]
            if not left:
                break
            name = slices[turn % len(slices)]
            turn += 1
            mine = [r for r in left if r.slice == name]
            if not mine:
                if turn > len(slices) * (per_issuer + len(taken) + 1):
                    break
                continue
            best = min(mine, key=lambda r: (used.get(r.contract, 0), -r.slice_score, r.order))
            taken.add(best.id)
            used[best.contract] = used.get(best.contract, 0) + 1
            picked.append({"issuer": issuer, "slice": name, "id": best.id, "contract": best.contract})
    return picked


def recall_at(run: DataFrame, gold: DataFrame, ks=(5, 10)) -> DataFrame:
    """Recall of gold (query_id, id) within the first k ranks, for each k."""
    hits = gold.join(run.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks])


def answer_errors(answers: DataFrame) -> DataFrame:
    """No-answer confusion and revision accuracy from flag columns (should_refuse, refused, revision_right)."""
    return answers.agg(
        F.count_if(~F.col("should_refuse") & F.col("refused")).alias("false_refusals"),
        F.count_if(F.col("should_refuse") & ~F.col("refused")).alias("missed_refusals"),
        F.round(F.avg(F.col("revision_right").cast("double")), 12).alias("revision_accuracy"),
    )
