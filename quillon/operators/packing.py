"""Units of bounded size from ordered pieces: whole documents, sections, or parts of them; and rounds that shrink."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.holding import held

_PARAGRAPH_END = re.compile(r"\r?\n[ \t]*(?:\r?\n)+")


def cuts(text: str, most: int) -> list[tuple[int, int]]:
    """[start, end) pieces of at most ``most`` characters, ending at the last paragraph end that fits, if any."""
    if most < 1:
        raise ValueError("no room for a piece")
    ends, out, at = [m.end() for m in _PARAGRAPH_END.finditer(text)], [], 0
    while at < len(text):
        stop = min(len(text), at + most)
        if stop < len(text):
            stop = max((e for e in ends if at < e <= stop), default=stop)
        out.append((at, stop))
        at = stop
    return out


def plan_units(pieces: list[tuple[str, int, str]], most: int, overhead: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(scope, [(piece, start, end)]) of a document's (section, position, text) pieces.

    One unit if all fit; else sections are packed one by one, a piece too long for any unit being cut.
    """
    room = most - overhead
    if sum(len(t) for _, _, t in pieces) <= room:
        return [("document", [(k, 0, len(t)) for _, k, t in pieces])]
    units: list[tuple[str, list[tuple[int, int, int]]]] = []
    for section in dict.fromkeys(s for s, _, _ in pieces):
        held, size = [], 0
        for _, k, t in (p for p in pieces if p[0] == section):
            for start, end in cuts(t, room):
                if held and size + end - start > room:
                    units.append((section, held))
                    held, size = [], 0
                held.append((k, start, end))
                size += end - start
        if held:
            units.append((section, held))
    return units


def map_units(pieces: DataFrame, most: int, overhead: int = 0) -> DataFrame:
    """(document, unit, scope, position, start, end): the plan of every document of (document, section, position, text)."""
    kind = dict(pieces.dtypes)["document"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        rows = list(zip(group["section"].to_pylist(), group["position"].to_pylist(), group["text"].to_pylist(), strict=True))
        flat = [(u, scope, k, s, e) for u, (scope, held) in enumerate(plan_units(rows, most, overhead)) for k, s, e in held]
        cols = list(zip(*flat, strict=True)) or [[]] * 5
        types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array([group["document"][0].as_py()] * len(flat), group.schema.field("document").type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["document", "unit", "scope", "position", "start", "end"])

    rows = pieces.select("document", F.col("section").cast("string").alias("section"), F.col("position").cast("long").alias("position"), "text")
    return rows.groupBy("document").applyInArrow(run, f"document {kind}, unit int, scope string, position long, start int, end int")


def reduce_rounds(spans: DataFrame, keep, key: str, order: str, size: str, budget: int, most_rounds: int = 16) -> DataFrame:
    """Rounds over distinct spans: batches within the budget, of which ``keep`` (batch, rows -> rows) leaves some, until one batch is left.

    A round that does not shrink raises; ``keep`` is the caller's model.
    """
    from quillon.operators.paging import greedy_batches

    frontier = held(spans.dropDuplicates([key, order]))
    for _ in range(most_rounds):
        n = frontier.count()
        batched = frontier.join(greedy_batches(frontier, key, order, size, 1 << 30, budget).select(key, order, "batch"), [key, order])
        last = not batched.where("batch > 0").limit(1).count()
        kept = held(keep(batched).select(*spans.columns).dropDuplicates([key, order]))
        if last:
            return kept
        if kept.count() >= n:
            raise ValueError("a round did not shrink")
        frontier = kept
    raise ValueError("too many rounds")
