r"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of documents of about ``SHARD_BYTES``.  Its words become symbols of
the benchmark's vocabulary; stretches whose neighbouring words never stand side by
side in a benchmark window cannot hold one and are left out, without loss.  What
remains is indexed: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet
matrix for ranks.  All windows of one length are searched backwards at once; occurrences
are located by sampled suffix positions (every ``SAMPLE``-th) and LF steps.  Their word spans are merged into removal spans.

Windows are 10 consecutive words of an item; an item of 1 to 9 words is one window.  They are arrays, built once on the driver
for each block of at most ``BLOCK_WORDS`` benchmark words (a broadcast of some 60 bytes a word at most); a larger benchmark takes several
blocks, of which a worker holds one at a time, over a shard that is read once.  Nothing is shuffled.

Words are equal by 64 bits of hash within one block and shard.  Defined cases: null text has no words; null item text gives no window; a null item_id is
named "null"; items that share an id count once; repeated rows are judged one by one; very long texts are whole (one alone may be a
shard); ids of any type; empty tables work; other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import ALNUM, Words, numbered, picked, position, table, text_bytes
from quillon.llm.quality import slices

WINDOW = 10
SHARD_BYTES = 32 << 20
SLICE_BYTES = 2 << 20  # words are looked up in slices, whose stretches make up the shard
BLOCK_WORDS = 1_000_000
SAMPLE = 8


class WaveletMatrix:
    """Ranks of a symbol sequence: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        current = symbols
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            running = np.zeros(len(current) + 1, np.int64)
            np.cumsum(ones, out=running[1:])
            zeros = len(current) - int(running[-1])
            self.levels.append((bit, running, zeros))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for bit, running, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + running[low], low - running[low])
            at = np.where(one, zeros + running[at], at - running[at])
        return at - low


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` by prefix doubling."""
    n, k = len(s), 1
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while n and int(rank.max()) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of symbols 0..alphabet-1; 0 stands at its end alone."""

    def __init__(self, s: np.ndarray, alphabet: int, sample: int = SAMPLE):
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, alphabet)
        self.before = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=alphabet), out=self.before[1:])
        self.kept = order % sample == 0
        self.kept_rank = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of the windows (one a row, all of one length)."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[live, j]
            a = self.before[c] + self.wavelet.rank(c, low[live])
            b = self.before[c] + self.wavelet.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[b > a]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps to the next sampled one."""
        out, steps, at, where = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(at):
            hit = self.kept[at]
            out[where[hit]] = self.positions[self.kept_rank[at[hit]]] + steps[where[hit]]
            where, at = where[~hit], at[~hit]
            if len(at):
                c = self.bwt[at]
                at = self.before[c] + self.wavelet.rank(c, at)
                steps[where] += 1
        return out


class Block:
    """The windows of some benchmark items as symbols (0 ends a shard, 1 parts its stretches), with the items each window belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.vocabulary, symbols = np.unique(w.hashes(lower=True), return_inverse=True)
        self.alphabet = len(self.vocabulary) + 2
        symbols = symbols.astype(np.int32) + 2
        self.names = [name for name, _ in items]
        counts, item = w.counts(), w.doc()
        inner = item[1:] == item[:-1]
        self.pairs = np.unique(symbols[:-1][inner].astype(np.int64) * self.alphabet + symbols[1:][inner])
        self.windows = []  # (length, distinct windows, first owner of each and one past the last, owners)
        for n in sorted({min(window, int(c)) for c in np.unique(counts) if c}):
            mine = np.flatnonzero(counts >= n) if n == window else np.flatnonzero(counts == n)
            room = counts[mine] - n + 1
            starts = np.repeat(w.first[mine] - (np.cumsum(room) - room), room) + np.arange(room.sum())
            rows = symbols[starts[:, None] + np.arange(n)]
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            owned = np.unique(which.ravel().astype(np.int64) * len(items) + np.repeat(mine, room))
            self.windows.append((n, distinct, np.searchsorted(owned // len(items), np.arange(len(distinct) + 1)), owned % len(items)))
        self.shortest = self.windows[0][0] if self.windows else 0

    def stretches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, symbols) of the stretches of a batch of texts that may hold a window; a 1 follows each stretch."""
        none = np.empty(0, np.int64)
        if not self.shortest or not len(w):
            return none, none
        hashes = w.hashes(lower=True)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        symbols = np.where(self.vocabulary[at] == hashes, at + 2, 0)
        doc = w.doc()
        linked = np.zeros(len(w), bool)  # word i and i + 1 may stand in one window
        near = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0) & (doc[:-1] == doc[1:]))
        if len(near) and len(self.pairs):
            pair = symbols[near] * self.alphabet + symbols[near + 1]
            k = np.searchsorted(self.pairs, pair)
            k[k == len(self.pairs)] = 0
            linked[near] = self.pairs[k] == pair
        run_start = np.ones(len(w), bool)
        run_start[1:] = ~linked[:-1]
        run = np.cumsum(run_start) - 1
        words = np.flatnonzero((symbols > 0) & (np.bincount(run)[run] >= self.shortest))
        if not len(words):
            return none, none
        ends = np.flatnonzero(np.append(run[words][1:] != run[words][:-1], True)) + 1
        return np.insert(words, ends, -1), np.insert(symbols[words], ends, 1)

    def search(self, symbols: np.ndarray):
        """(text positions, window length, owners) of each window that occurs in a shard of stretches."""
        if not len(symbols):
            return
        index = FMIndex(np.append(symbols, 0), self.alphabet)
        for n, windows, edges, owners in self.windows:
            low, high = index.search(windows)
            for k in np.flatnonzero(high > low):
                yield index.locate(np.arange(low[k], high[k])), n, owners[edges[k] : edges[k + 1]]


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_WORDS):
    """Benchmark items in blocks of about ``limit`` words, read as a stream."""
    block, n = [], 0
    rows = picked(benchmark, name=id_col, text=text_col)
    for name, text in rows.select(F.coalesce(F.col("name").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).toLocalIterator():
        size = len(text) // 2 + 1
        if block and n + size > limit:
            yield block
            block, n = [], 0
        block.append((name, text))
        n += size
    if block:
        yield block


_MARKED = [T.StructField("words", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, words, hits, spans, items) of each row: counts of words and of those in spans, merged word spans [start, end) as int64 pairs, and sorted item ids."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_marker(rows, benchmark, 1, window, False), T.StructType([rows.schema[0], *_MARKED]))


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the removal spans cut out of the text; untouched texts stay byte for byte."""
    rows = numbered(docs)
    return rows.mapInArrow(_marker(rows, benchmark, position(docs, text_col), window, True), T.StructType(rows.schema.fields)).toDF(*docs.columns)


def _without(texts, w: Words, spans: list[np.ndarray]) -> pa.Array:
    """The texts without their word spans."""
    raw, out = w.data.tobytes(), []
    for d, span in enumerate(spans):
        if not len(span):
            out.append(texts[d].as_py())
            continue
        at, parts = int(w.offsets[d]), []
        for a, e in span.reshape(-1, 2) + w.first[d]:
            parts.append(raw[at : int(w.starts[a])])
            at = int(w.ends[e - 1])
        out.append(b"".join([*parts, raw[at : int(w.offsets[d + 1])]]).decode())
    return pa.array(out, pa.string())


class Shard:
    """Slices of texts, held until they are enough for an index; ``blocks`` gives the benchmark's blocks one at a time."""

    def __init__(self, blocks):
        self.blocks, self.parts, self.size = blocks, [], 0

    def add(self, part, texts) -> None:
        self.parts.append((part, texts))
        self.size += len(text_bytes(texts)[0])

    def found(self):
        """(part, word counts, hit flags of its words, first word of each text, item names by text) of each slice."""
        shapes, items, edge = [], {}, None
        for block in self.blocks():
            shapes, place, symbols, words = [], [], [], 0
            for _, texts in self.parts:
                w = Words(texts, ALNUM)
                at, kept = block.stretches(w)
                place.append(np.where(at < 0, -1, at + words))
                symbols.append(kept)
                shapes.append((words, w.first))
                words += len(w)
            edge = np.zeros(words + 1, np.int64) if edge is None else edge
            starts = np.concatenate([first[:-1] + base for base, first in shapes] or [np.empty(0, np.int64)])
            place, symbols = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (place, symbols))
            for at, n, owners in block.search(symbols):
                at = place[at]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                for text in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                    items.setdefault(text, set()).update(block.names[i] for i in owners)
        hit, text = np.cumsum(edge[:-1]) > 0, 0
        for (part, _), (base, first) in zip(self.parts, shapes, strict=True):
            n = len(first) - 1
            yield part, np.diff(first), hit[base : base + first[-1]], first, [items.get(text + d, set()) for d in range(n)]
            text += n
        self.parts, self.size = [], 0


def _loaded(held):
    """The blocks, one at a time: each is dropped before the next is loaded, if there are several."""

    def blocks():
        for h in held:
            yield h.value
            if len(held) > 1:
                del h._value  # loaded again from the executor's copy

    return blocks


def _marker(rows: DataFrame, benchmark: DataFrame, index: int, window: int, cut: bool):
    context = rows.sparkSession.sparkContext
    held = [context.broadcast(Block(items, window)) for items in blocks_of(benchmark)] or [context.broadcast(Block([], window))]  # each of a bounded size
    names = rows.columns

    def out(shard: Shard):
        for part, counts, hit, first, items in shard.found():
            spans = [np.flatnonzero(np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].astype(np.int8), [0]]))).astype(np.int64) for d in range(len(counts))]
            if cut:
                cols = list(part.columns)
                if hit.any():
                    cols[index] = _without(cols[index], Words(cols[index], ALNUM), spans)
                yield pa.RecordBatch.from_arrays(cols, names=names)
            else:
                total = np.append(0, np.cumsum(hit))
                more = [pa.array(counts.astype(np.int64)), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), pa.array([s.tobytes() for s in spans], pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *more], names=[names[0], "words", "hits", "spans", "items"])

    def run(batches):
        shard = Shard(_loaded(held))
        for b in batches:
            at = 0
            for (texts,) in slices(pa.RecordBatch.from_arrays([b.column(index)], names=["t"]), "t", limit=SLICE_BYTES):
                shard.add(b.slice(at, len(texts)) if cut else b.slice(at, len(texts)).select([names[0]]), texts)
                at += len(texts)
                if shard.size >= SHARD_BYTES:
                    yield from out(shard)
        yield from out(shard)

    return run


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return marked.select("doc_id", F.col("words").alias("n_words"), F.col("hits").alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("hits") > 0).alias("contaminated"))
