"""Row-count windows and greedy plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.holding import held


def call_plan(documents: DataFrame, whole_max: int, per_call: int, before: int, after: int) -> DataFrame:
    """Tumbling page windows of each document with clamped context: one call if it is short enough."""
    n = F.col("page_count")
    step = F.when(n <= whole_max, n).otherwise(F.lit(per_call))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = documents.withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + step - 1, n))
    return rows.withColumn("context_first", F.greatest(F.lit(1), F.col("first") - before)).withColumn("context_last", F.least(n, F.col("last") + after))


def neighbours(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Previous and next value along an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


BLOCK = 1 << 18  # rows of a key's order that are followed at a time


def _follow(sizes: np.ndarray, run_ends: np.ndarray, most_rows: int, most_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums up to each row, row at which a batch that begins at a row is followed by the next, at most the end of its run)."""
    sums = np.cumsum(sizes)
    after = np.searchsorted(sums, sums - sizes + most_size, "right")
    at = np.arange(len(sizes))
    return sums, np.minimum(np.minimum(np.maximum(after, at + 1), at + most_rows), run_ends)


def _last_starts(following: np.ndarray, run_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last batch start that is reached from each row within its run, batches up to it), by pointer doubling."""
    to = np.where(following < run_ends, np.minimum(following, len(following) - 1), np.arange(len(following)))
    n = (to != np.arange(len(to))).astype(np.int64)
    while (n[to] > 0).any():
        n, to = n + n[to], to[to]
    return to, n + 1


def _run_ends(keys: pa.Array) -> np.ndarray:
    """For each row of a sorted column, where the run of its value ends."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    return np.repeat(ends, np.diff(np.concatenate([[0], ends])))


def _blocks(batches):
    """Tables of the rows of one block each; rows come in the order of ``__at``."""
    held, now = [], None
    for b in batches:
        number = b.column("__block").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                if now is not None and number[a] != now:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = number[a]
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def greedy_batches(rows: DataFrame, key: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """(key, order, size, batch): a batch of a key closes before the row that would pass either cap.

    Rows are range-partitioned by (key, order) and cut into blocks, so one key of all rows is many tasks.  Where the batches of a block begin depends on what came before only by the place of
    its first start, which lies within one batch of its beginning.  So each block tells, for every such place, its last start and how many there are (``next`` by binary search in running
    sums, pointers doubled); one pass over these short lists gives every block its first start, and the blocks number their rows by themselves.

    Null sizes count 0; sizes are whole numbers of 0 or more.
    """
    kinds = dict(rows.dtypes)
    names = ["k", "o", "s"]
    plain = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).alias("s"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__n"))
    ordered = plain.repartitionByRange("k", "o").sortWithinPartitions("k", "o").withColumn("__at", F.monotonically_increasing_id())
    ordered = held(ordered.withColumn("__block", F.shiftright("__at", BLOCK.bit_length() - 1)))  # places and bounds must not be drawn twice

    def told(batches):
        for t in _blocks(batches):
            sizes, ends = t["__n"].to_numpy(), _run_ends(t["k"].combine_chunks())
            sums, following = _follow(sizes, ends, most_rows, most_size)
            last, n = _last_starts(following, ends)
            lead = int(ends[0])
            window = min(lead, most_rows + 1, int(np.searchsorted(sums, most_size, "right")) + 1)
            tail = int(ends[-2]) if len(ends) > 1 and ends[-2] != ends[-1] else int(np.searchsorted(ends, ends[-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "at": t["__at"].combine_chunks()[:1], "block": t["__block"].combine_chunks()[:1], "first": t["k"].combine_chunks()[:1], "final": t["k"].combine_chunks()[-1:], "n": [len(sizes)], "total": [int(sums[-1])], "lead": [lead],
                    "sums": [sums[:window]], "last": [last[:window]], "starts": [n[:window]], "before": [(sums - sizes)[last[:window]]],
                    "tail_last": [int(last[tail])], "tail_starts": [int(n[tail])], "tail_before": [int((sums - sizes)[last[tail]])],
                },
                schema=schema,
            )

    listed = pa.list_(pa.int64())
    types = {"at": pa.int64(), "block": pa.int64(), "first": None, "final": None, "n": pa.int64(), "total": pa.int64(), "lead": pa.int64(), "sums": listed, "last": listed, "starts": listed, "before": listed, "tail_last": pa.int64(), "tail_starts": pa.int64(), "tail_before": pa.int64()}
    of_key = to_arrow_type(rows.schema[key].dataType)
    schema = pa.schema([(c, of_key if t is None else t) for c, t in types.items()])
    ddl = ", ".join(f"{c} {kinds[key] if t is None else 'long' if t == pa.int64() else 'array<long>'}" for c, t in types.items())

    def composed(batches):
        """(block, start, batch): a block's first start and the batch that is open before it (-1: none, so the first row starts one)."""
        open_key = rank = before = number = None  # of the open batch: its key, place, sum before it and number
        place = total = 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if rank is None or r["first"] != open_key:
                    start, carried = 0, -1
                else:
                    sums = np.array(r["sums"])
                    passed = (place + np.arange(len(sums)) - rank >= most_rows) | (total + sums - before > most_size)
                    start, carried = (int(np.argmax(passed)) if passed.any() else r["lead"]), number
                out.append((r["block"], start, carried))
                if r["lead"] < r["n"]:  # another key begins within
                    open_key, rank, before, number = r["final"], place + r["tail_last"], total + r["tail_before"], r["tail_starts"] - 1
                elif start < r["n"]:
                    open_key, rank, before, number = r["final"], place + r["last"][start], total + r["before"][start], carried + r["starts"][start]
                place, total = place + r["n"], total + r["total"]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["block", "start", "carried"])

    def numbered(batches):
        for t in _blocks(batches):
            ends = _run_ends(t["k"].combine_chunks())
            _, following = _follow(t["__n"].to_numpy(), ends, most_rows, most_size)
            starts, at = np.zeros(len(ends), bool), int(t["start"][0].as_py())
            follow = following.tolist()
            while at < len(follow):
                starts[at] = True
                at = follow[at]
            number = np.cumsum(starts) + int(t["carried"][0].as_py())
            fresh = np.flatnonzero(np.append(False, ends[1:] != ends[:-1]))  # other keys count from 0
            for a in fresh:
                number[a : ends[a]] -= number[a]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in names), pa.array(number, pa.int32())], names=[*names, "batch"])

    # one short list a block, in order, through one task that holds one of them at a time
    found = held(ordered.mapInArrow(told, ddl)).repartition(1).sortWithinPartitions("at").mapInArrow(composed, "block long, start long, carried long")
    both = ordered.join(found, ordered["__block"] == found["block"]).sortWithinPartitions("__at")
    out = both.mapInArrow(numbered, f"k {kinds[key]}, o {kinds[order]}, s {kinds[size]}, batch int")
    return out.toDF(key, order, size, "batch")


def storage_estimate(rows: DataFrame, text: str) -> DataFrame:
    """Predicted bytes: payload, 768 a row, four times the text for its index, 1 MiB, in pages of 4096."""
    raw = F.sum(F.octet_length(text)).cast("long")
    got = rows.agg(raw.alias("payload"), F.count(F.lit(1)).alias("n"))
    total = F.col("payload") + F.col("n") * 768 + F.col("payload") * 4 + 1048576
    return got.select("payload", "n", (F.ceil(total / 4096) * 4096).cast("long").alias("bytes"))
