r"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r in (0, cap) that minimises the relative entropy
sum [r log r + (cap - r) log(cap - r)] subject to one token constraint per source,
``sum r * size = target``.  The convex dual has one variable per source; its
solution is an exponential tilt r = cap / (1 + exp(-lam * size / scale)).

Sizes are counted once, into a table of (id, source, size).  Newton steps on the dual run on its histogram (source, size,
rows): every step is one distributed aggregation and updates a table with one row a source, so there may be any number of
sources and the driver sees only whether one is open.  Sums are of decimals, so their order does not matter and reruns agree to the bit.

Rates become whole copies 0..cap by error diffusion from long to short documents
in buckets of about ``BUCKET`` rows of one source, so a hot source is split into
many tasks and each bucket ends within about half of its shortest documents of its rates.  Only ids and sizes are grouped;
texts meet their copies by a join.

Defined cases: null or wordless text has size 0 and takes 0; a null source is a source
of its own, after the others; very long texts are whole (one alone may miss a target by half its size); empty input gives no rows;
repeated rows are separate rows, each with its own copies (a rerun agrees: order and buckets depend only on source, size and id); ids of
any type; other columns and their names do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import NON_SPACE, Words, numbered, picked, position, table, with_hot_keys, written
from quillon.operators.ordering import global_rank

BUCKET = 2_000
CYCLE = (3, 1, 2)
EXACT = "decimal(28,6)"  # sums of these do not depend on their order


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, key, print, size) of each row: word counts of whole texts, the source as a key that is never null, and the text's hash."""
    source = F.col("source").cast("string")
    rows = picked(docs, id=id_col, source=source_col, text=text_col).select("id", "source", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), F.xxhash64(F.col("text")).alias("print"), "text")
    names = ["id", "source", "key", "print", "size"]

    def count(batches):
        for b in batches:
            w = Words(b.column(4), NON_SPACE)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(w.counts().astype(np.int64))], names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, f"id {kinds['id']}, source {kinds['source']}, key string, print long, size long")


def targets(sources: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """``sources`` (key, total, ...) with ``target``: shares of ``share`` of all totals by weight, in cycles over the sources in order of their keys, null last.

    What exceeds ``cap`` times a total is reshared by weight until nothing does.  With unit u a source gets weight * u, or its cap if that is less;
    raising u to what is left for the others, step by step, ends after as many steps as sources fill up.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = global_rank(sources, [F.col("key") == "n", F.col("key")], "rank")
    ranked = written(ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))), "mix-sources")
    whole = float(share) * float(ranked.agg(F.sum("total")).first()[0] or 0)
    unit, full = 0.0, -1
    while True:
        over = F.col("weight") * unit > cap * F.col("total")
        used, weight, n = ranked.agg(F.sum(F.when(over, F.col("total")).otherwise(0)), F.sum(F.when(over, F.lit(0).cast(EXACT)).otherwise(F.col("weight").cast(EXACT))), F.sum(over.cast("long"))).first()
        if n == full or not weight:  # all sources full
            unit = math.inf if n and not weight else unit
            break
        unit, full = max(unit, (whole - cap * float(used)) / float(weight)), n
    share_of = F.when(F.col("weight") > 0, F.least(F.col("weight") * unit, cap * F.col("total"))).otherwise(0.0)
    return ranked.withColumn("target", share_of)


def _rate(lam, size, scale, cap: float):
    """A document's rate: the tilt by its source's multiplier times its relative size."""
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * (size / scale)))
    return F.lit(cap) / (F.lit(1.0) + F.exp(-x))


def balance(hist: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7, steps: int = 50) -> DataFrame:
    """``sources`` (key, target, total, scale, ...) with the dual multiplier ``lam`` by damped Newton steps over ``hist`` (key, size, n).

    A source whose target is all or nothing needs no multiplier (null; its rates are cap or 0).
    """
    between = (F.col("target") > 0) & (F.col("target") < cap * F.col("total") * (1 - 1e-12))
    state = sources.select("key", "target", "scale", F.lit(0.0).alias("lam"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), between.alias("open"))
    state = written(state.where("open"), "mix-dual")
    for _ in range(steps):
        if not state.where("open").limit(1).count():
            break
        met = hist.join(state.where("open").select("key", "lam", "scale"), "key")  # at most as many rows a source as it has sizes
        r = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        mass = F.col("n") * F.col("size")
        got = met.select("key", (mass * r).cast(EXACT).alias("g"), (mass * F.col("size") / F.col("scale") * r * (1 - r / cap)).cast(EXACT).alias("h")).groupBy("key").agg(F.sum("g").cast("double").alias("g"), F.sum("h").cast("double").alias("h"))
        miss, lam = F.col("target") - F.col("g"), F.col("lam")
        stays = ~F.col("open") | (F.abs(miss) <= tolerance * F.greatest(F.lit(1.0), F.col("target")))
        low, high = F.when(miss > 0, lam).otherwise(F.col("low")), F.when(miss > 0, F.col("high")).otherwise(lam)
        step = F.when(F.col("h") > 0, lam + miss / F.col("h"))
        halved = F.when(F.abs(low) + F.abs(high) < math.inf, (low + high) / 2).otherwise(2 * lam + F.when(miss > 0, 1.0).otherwise(-1.0))  # outside the bracket: halve it, or double outwards
        new = F.when((step > low) & (step < high), step).otherwise(halved)
        moved = state.join(got, "key", "left").select("key", "target", "scale", F.when(stays, lam).otherwise(new).alias("lam"), F.when(stays, F.col("low")).otherwise(low).alias("low"), F.when(stays, F.col("high")).otherwise(high).alias("high"), (~stays).alias("open"))
        state = written(moved, "mix-dual")
    return sources.join(state.select("key", "lam"), "key", "left")


def diffuse(size: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies 0..cap whose words follow the rates; rows come from long to short."""
    copies, owed = np.zeros(len(size), np.int64), 0.0
    for i, (s, r) in enumerate(zip(size.tolist(), rate.tolist(), strict=True)):
        if s > 0:
            owed += r * s
            copies[i] = c = min(cap, max(0, math.floor(owed / s + 0.5)))
            owed -= c * s
    return copies


def rated(rows: DataFrame, weights=CYCLE, share: float = 1.5, cap: int = 2) -> DataFrame:
    """``rows`` of ``sized`` (a written table) with source_size, target, buckets and rate."""
    hist = written(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    totals = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    sources = targets(totals, weights, share, float(cap)).withColumn("scale", F.greatest(F.lit(1.0), F.col("total") / F.col("n")))
    told = balance(hist.where("size > 0"), sources, float(cap)).select("key", "n", F.col("total").alias("source_size"), "target", "scale", "lam", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    values = ["source_size", "target", "scale", "lam", "buckets"]
    got = with_hot_keys(rows, written(told, "mix-targets"), "key", values, ["id", "print"])
    edge = F.when(F.col("target") > 0, float(cap)).otherwise(0.0)
    return got.withColumn("rate", F.when(F.col("lam").isNull(), edge).otherwise(_rate(F.col("lam"), F.col("size"), F.col("scale"), float(cap)))).drop("scale", "lam")


def copies_of(rows: DataFrame, weights=CYCLE, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(id, source, key, print, size, source_size, target, copies, taken) of each of ``rows``."""
    kinds = dict(rows.dtypes)
    names = ["id", "source", "key", "print", "size", "source_size", "target"]
    parts = rated(rows, weights, share, cap).withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.col("buckets")))

    def round_bucket(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, sort_keys=[("size", "descending"), ("id", "ascending"), ("print", "ascending")])
        group = group.take(order)
        size = group["size"].to_numpy()
        copies = diffuse(size, group["rate"].to_numpy(), cap)
        return pa.table([*(group[c] for c in names), pa.array(copies), pa.array(copies * size)], names=[*names, "copies", "taken"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:5]) + ", source_size long, target double, copies long, taken long"
    return parts.select(*names, "rate", "bucket").groupBy("key", "bucket").applyInArrow(round_bucket, schema)


def mix(docs: DataFrame, weights=CYCLE, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    return copies_of(rows, weights, share, cap).select("id", "source", "size", "source_size", "target", "copies", "taken")


ADDED = ("size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, weights=CYCLE, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``ADDED``; an input column of such a name makes room."""
    told = written(copies_of(written(sized(docs, id_col, text_col, source_col), "mix-sizes"), weights, share, cap).where("copies > 0"), "mix-copies")
    # rows of one id, source and text are alike but for other columns: their copies are a list, most first, and the k-th row takes the k-th
    told = told.groupBy("id", "key", "print").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("several"), *(F.first(c).alias(c) for c in ("size", "source_size", "target")))
    told = written(told.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("print").alias("__print"), "several", *ADDED[:3]), "mix-taken")
    at = {name: position(docs, old) for name, old in (("id", id_col), ("text", text_col), ("source", source_col))}
    rows = numbered(docs)
    known = {"__id": F.col(f"c{at['id']}"), "__key": F.coalesce(F.concat(F.lit("s"), F.col(f"c{at['source']}").cast("string")), F.lit("n")), "__print": F.xxhash64(F.col(f"c{at['text']}"))}
    met = rows.join(told, known["__id"].eqNullSafe(told["__id"]) & (known["__key"] == told["__key"]) & (known["__print"] == told["__print"]))
    if told.where("size(several) > 1").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("__id", "__key", "__print").orderBy(F.lit(0)))
        met = met.withColumn("copies", F.get("several", nth - 1)).where("copies IS NOT NULL")
    else:
        met = met.withColumn("copies", F.get("several", F.lit(0)))
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    out = met.select(*(f"c{i}" for i in kept), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return out.toDF(*(docs.columns[i] for i in kept), *ADDED)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
