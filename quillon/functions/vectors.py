"""Vector expressions in double precision, and block-wise scoring for some or many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def dot(a, b) -> Column:
    """Inner product in doubles, summed in order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a) -> Column:
    """Unit vector, or null where the norm is below 1e-12."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    """Cosine clamped to [-1, 1]; null if either vector has no direction."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


MAX_QUERY_VALUES = 20_000_000  # values of a query matrix sent to the tasks (160 MB)


def score_blocks(matrix: DataFrame, queries: list[tuple[object, list[float]]], vector: str = "embedding", query_type: str = "long") -> DataFrame:
    """Every row of ``matrix`` times every query: the other columns with query_id and score.

    A batch of rows is one matrix product, so the matrix is read once whatever the number of queries;
    the query matrix is bounded and sent with the tasks.  More queries than the bound take several passes of it.
    """
    if len(queries) > 1 and sum(len(v) for _, v in queries) > MAX_QUERY_VALUES:
        half = len(queries) // 2
        return score_blocks(matrix, queries[:half], vector, query_type).unionAll(score_blocks(matrix, queries[half:], vector, query_type))
    names = [c for c in matrix.columns if c != vector]
    ids, q = [i for i, _ in queries], np.array([v for _, v in queries], np.float64)
    kinds = dict(matrix.dtypes)
    arrow = {"long": pa.int64(), "string": pa.string()}[query_type]

    def run(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index(vector))
            if not len(v):
                continue
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            s = x @ q.T
            for k, name in enumerate(ids):
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array([name] * len(v), arrow), pa.array(s[:, k].copy())], names=[*names, "query_id", "score"])

    return matrix.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + f", query_id {query_type}, score double")


ROW_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 16384, 64, 4096


def rounded(scores: np.ndarray, places: int) -> np.ndarray:
    """As ``round`` of SQL: halves away from zero, and no negative zero."""
    return np.copysign(np.floor(np.abs(scores) * 10.0**places + 0.5), scores) / 10.0**places + 0.0


def best_rows(s: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest of each column; of equal ones the first."""
    if k >= len(s):
        return np.ones(s.shape, bool)
    least = np.partition(s, len(s) - k, axis=0)[len(s) - k]
    above = s > least
    equal = s == least
    return above | equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0))


def starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of equal values begin in sorted rows."""
    changed = np.zeros(len(rows), bool)
    changed[0] = True
    for c in names:
        codes = rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


def group_best(rows: pa.Table, keys: list[str]):
    """Mask of the best row of each group and query; rows come in the order of the keys, then of their ids."""
    cuts = starts(rows, keys)
    sizes = np.diff(np.append(cuts, len(rows)))

    def keep(s: np.ndarray) -> np.ndarray:
        if len(cuts) == len(s):
            return np.ones(s.shape, bool)
        top = s == np.repeat(np.maximum.reduceat(s, cuts, axis=0), sizes, axis=0)
        before = np.cumsum(top, axis=0)
        return top & (before - np.repeat(before[cuts] - top[cuts], sizes, axis=0) == 1)

    return keep


def score_pairs(matrix: DataFrame, queries: DataFrame, row_id: str, query_id: str = "query_id", vector: str = "embedding", best: int | None = None, places: int | None = None, together: tuple[str, ...] = (), order: tuple[str, ...] = (), keep=None) -> DataFrame:
    """``score_blocks`` for a query set of any size: blocks of rows are held in turn, and the query set streams past each.

    ``queries`` has ``query_id`` and ``vector``.  Every row is moved once and every query once a block, so what is shuffled is the rows and a small part of the pairs' number.
    Scores are rounded to ``places``, if given.  With ``best``, only rows that can be among a query's so many best are kept in each block, with ``places`` exactly so many (of equal ones
    those of least id).  Rows with equal values of ``together`` are in one block, so what is the best of their group there is so at all; ``keep`` makes of a block's rows, in the order of
    ``order`` (else ``together``) and id, a function from its scores (rows, queries) to a mask.  The vectors must be whole and of one length.
    """
    rows_in = matrix.count()
    n = max(1, -(-rows_in // ROW_BLOCK), min(int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows_in // LEAST_BLOCK)))
    names = [c for c in matrix.columns if c != vector]
    none = lambda schema, c: F.lit(None).cast(schema[c].dataType).alias(c)
    rows = matrix.select(F.pmod(F.xxhash64(*(together or (row_id,))), F.lit(n)).cast("int").alias("__block"), F.lit(False).alias("__asked"), *names, F.col(vector).alias("__v"), F.lit(None).cast(queries.schema[query_id].dataType).alias("__query"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__block"), F.lit(True).alias("__asked"), *(none(matrix.schema, c) for c in names), F.col(vector).cast(matrix.schema[vector].dataType).alias("__v"), F.col(query_id).alias("__query"))
    out = T.StructType([*(matrix.schema[c] for c in names), T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    values = lambda t: t["__v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)

    def scored(rows: pa.Table, x: np.ndarray, mask, asked: pa.Table):
        step = max(1, min(QUERY_BLOCK, (1 << 18) // len(rows)))
        for a in range(0, len(asked), step):
            some = asked.slice(a, step)
            s = x @ values(some).T
            if places is not None:
                s = rounded(s, places)
            kept = np.ones(s.shape, bool) if mask is None else mask(s)
            if best is not None and places is not None:
                kept &= best_rows(s, best)
            elif best is not None and best < len(s):
                kept &= s >= np.partition(s, len(s) - best, axis=0)[len(s) - best] - 2e-6
            by, at = np.nonzero(kept.T)
            yield pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(at)) for c in names), some["__query"].combine_chunks().take(pa.array(by)), pa.array(s[at, by])], schema=schema)

    def run(batches):
        block, held, ready = None, [], None
        for b in batches:
            marks = b.column("__block").to_numpy() * 2 + b.column("__asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(b)] if len(b) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                piece = b.slice(a, z - a)
                if marks[a] % 2 == 0:  # rows come before the queries of their block
                    if marks[a] != block:
                        block, held, ready = marks[a], [], None
                    held.append(piece)
                elif marks[a] - 1 == block:
                    if ready is None:
                        rows = pa.Table.from_batches(held).combine_chunks().sort_by([(c, "ascending") for c in dict.fromkeys((*(order or together), row_id))])
                        ready, held = (pa.RecordBatch.from_arrays([rows[c].combine_chunks() for c in names], names=names), values(rows), keep and keep(rows)), []
                    yield from scored(*ready, pa.Table.from_batches([piece]))

    return rows.unionByName(asked).repartition(n, "__block").sortWithinPartitions("__block", "__asked").mapInArrow(run, out)
