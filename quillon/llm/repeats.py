r"""Substring dedup by level-wise doubling.

Texts are packed once into blocks (compressed Arrow, a table in the shared folder).
Level 1 looks at windows of half the length: of the half windows within each full window
only the one of least hash is an anchor (equal windows have equal anchors, so none
is missed).  The distinct anchors of each block are shuffled; anchors that occur once end there.  Level 2
extends the surviving ones to windows of twice the length and shuffles their
96-bit hashes to the anchor's partition, so that neighbouring windows travel together.  A longer
repeat is a chain of repeated windows of this length, so the doubling ends here: no
candidate of a further level could add a word.  Each level sends back, block by block, what survived.

A word is removed if it is covered by a window whose word sequence also starts earlier
(smaller doc_id, or same document and earlier start), judged on the input.

Partitions get packed rows, never a row for each window.  An anchor that occurs more than ``HOT`` times, and more often than a sixteenth of
all the anchors that blocks send to its partition, is hot: its windows are
dealt by block instead, each partition judges what it has, and only the earliest occurrence there goes on to the window's own partition.
So a passage in a third of all documents is spread over all partitions, and none gets more than one occurrence of it from each.

Defined cases: null text has no words; texts shorter than the window stay whole; very long texts are one block each; rows with a
null doc_id count as one last document; rows that share a doc_id count as one document each starting at word 0
(equal starts are not earlier, so identical rows of one id are not removed by each other); ids of a whole-number type keep their order, ids of
any other type are compared as text; empty tables work; other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import NON_SPACE, U64, Words, join_hash, mix, n_parts, picked, position, table, whole_windows, window_hashes, written
from quillon.llm.quality import slices
from quillon.operators.ordering import global_rank

WINDOW = 20
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 60_000
BLOCKS_OF_A_TASK = 7  # only spreads blocks evenly over partitions
HOT = 64  # occurrences
LAST = np.iinfo(np.int64).max


def pack(rows: DataFrame, name: str = "blocks") -> DataFrame:
    """(block, payload): rows (doc_id long, text) in compressed blocks of about BLOCK_BYTES and at most BLOCK_DOCS rows."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_DOCS):
                for ids, texts in slices(b.slice(at, BLOCK_DOCS), "doc_id", "text", limit=BLOCK_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([_encode(ids, texts)], pa.binary())], names=["block", "payload"])
                    n += 1

    return written(rows.mapInArrow(run, "block long, payload binary"), name)


def _encode(ids, texts) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids, texts.cast(pa.string())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _decode(payload: bytes):
    batch = pa.ipc.open_stream(payload).read_next_batch()
    return batch.column(0), batch.column(1)


def sliding(values: np.ndarray, k: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of k values, by doubling."""
    length, out = 1, values
    while 2 * length <= k:
        out = op(out[:-length], out[length:])
        length *= 2
    return op(out[: len(values) - k + 1], out[k - length : k - length + len(values) - k + 1])


class Windows:
    """Hashes, anchors and whole windows of a block's texts."""

    def __init__(self, texts, window: int):
        self.words = w = Words(texts, NON_SPACE)
        self.window, self.half = window, window // 2
        n = max(0, len(w) - window + 1)
        self.ok = whole_windows(w.first, window, n)
        self.halves = window_hashes(w.hashes(), self.half)
        self.least = sliding(self.halves, window - self.half + 1, np.minimum) if n else np.empty(0, np.uint64)
        self.doc = w.doc()

    def anchors(self) -> np.ndarray:
        """48 hash bits over 16 bits of how often (at most 65535), for each distinct anchor."""
        n = len(self.least)
        if not n:
            return np.empty(0, np.uint64)
        span = self.window - self.half + 1
        padded = np.zeros(n + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + n] = np.where(self.ok, self.least, U64(0))
        most = sliding(padded, span, np.maximum)[: len(self.halves)]
        at = np.flatnonzero((most == self.halves[: len(most)]) & (most > 0))
        found, n = np.unique(self.halves[at] & LEFT, return_counts=True)
        return found | np.minimum(n, 0xFFFF).astype(np.uint64)

    def full(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 more bits of hash of the windows at these positions, from their halves."""
        left, right = self.halves[at], self.halves[at + self.window - self.half]
        more = mix(left * U64(0x9FB21C651E98DF25) + right * U64(0xD6E8FEB86659FD93) + U64(0xA5A3564E27F8865B))
        return join_hash(left, right), (more >> U64(32)).astype(np.uint32)


LEFT = ~U64(0xFFFF)  # the 48 bits of an anchor


def part_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Partition by the top 24 bits of a hash."""
    return (((hashes >> U64(40)) * U64(n)) >> U64(24)).astype(np.int32)


def anchor_part(anchors: np.ndarray, n: int) -> np.ndarray:
    """Partition of anchors by their 48 bits mixed again: as the least of several hashes they are mostly small."""
    return part_of(mix(anchors & LEFT), n)


def by_part(parts: np.ndarray, n: int):
    """(part, positions) of each part that occurs."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(n + 1))
    for p in range(n):
        if edges[p + 1] > edges[p]:
            yield p, order[edges[p] : edges[p + 1]]


def gathered(batches, names: list[str], kinds: list):
    """All packed rows of a partition: column values, and arrays joined with the row number of each element."""
    rows, arrays, source = {"block": []}, {n: [] for n in names}, []
    k = 0
    for b in batches:
        for i in range(b.num_rows):
            rows["block"].append(b.column("block")[i].as_py())
            for n, t in zip(names, kinds, strict=True):
                arrays[n].append(np.frombuffer(b.column(n)[i].as_py(), t))
            source.append(np.full(len(arrays[names[-1]][-1]), k, np.int64))
            k += 1
    join = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    return rows["block"], {n: arrays[n] for n in names}, {n: join(arrays[n], t) for n, t in zip(names, kinds, strict=True)}, join(source, np.int64)


def _blob_batch(parts, blocks, blobs, names):
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=names)


def _send_anchors(window: int, n: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, texts = _decode(b.column("payload")[i].as_py())
                keys = Windows(texts, window).anchors()
                got = list(by_part(anchor_part(keys, n), n))
                if got:
                    yield _blob_batch([p for p, _ in got], [b.column("block")[i].as_py()] * len(got), [[keys[at].tobytes() for _, at in got]], ["part", "block", "keys"])

    return run


def _repeated_anchors(least: int):
    """To each block its anchors that occur twice or more, plus 1 if they are hot."""

    def run(batches):
        blocks, _, joined, source = gathered(batches, ["keys"], [np.uint64])
        keys = joined["keys"]
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, source = keys[order], source[order]
        h = keys & LEFT
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        times = np.add.reduceat((keys & ~LEFT).astype(np.int64), first)
        keep = np.repeat(times > 1, np.diff(np.append(first, len(h))))
        hot = np.repeat(times > max(least, len(keys) // 16), np.diff(np.append(first, len(h))))
        yield from _returned(blocks, source[keep], (h | hot.astype(np.uint64))[keep])

    return run


def _returned(blocks: list[int], source: np.ndarray, values: np.ndarray):
    order = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[order], np.arange(len(blocks) + 1))
    for k in range(len(blocks)):
        if edges[k + 1] > edges[k]:
            yield pa.RecordBatch.from_arrays([pa.array([blocks[k]], pa.int64()), pa.array([values[order[edges[k] : edges[k + 1]]].tobytes()], pa.binary())], names=["block", "payload"])


def _with_texts(blocks: DataFrame, returned: DataFrame) -> DataFrame:
    """Each block's returned rows, then its texts, in one partition."""
    both = returned.select("block", F.lit(0).alias("kind"), "payload").unionAll(blocks.select("block", F.lit(1).alias("kind"), "payload"))
    n = n_parts(blocks.sparkSession)
    number = F.shiftright("block", 32) * BLOCKS_OF_A_TASK + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF))
    return both.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions("block", "kind")


def _blocks_with(batches, kind):
    """(block, doc_ids, texts, values returned to it) for each block of a partition."""
    held, at = [], None
    for b in batches:
        for i in range(b.num_rows):
            block, payload = b.column("block")[i].as_py(), b.column("payload")[i].as_py()
            if block != at:
                held, at = [], block
            if b.column("kind")[i].as_py() == 0:
                held.append(np.frombuffer(payload, kind))
            else:
                ids, texts = _decode(payload)
                yield block, ids, texts, np.concatenate(held) if held else np.empty(0, kind)


def _order_ids(ids) -> np.ndarray:
    return ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


_SENT = ["part", "hot", "texts", "hashes", "mores", "places", "starts"]
_KINDS = [np.int64, np.uint64, np.uint32, np.uint32, np.uint32]
_SENT_SCHEMA = "part int, hot int, texts binary, hashes binary, mores binary, places binary, starts binary"


def _packed(parts, hots, packs):
    """Rows of windows: for each (texts, hashes, mores, places, starts) its texts as (block, number in it, order of id), which ``places`` count."""
    cols = [[], [], [], [], []]
    for pack in packs:
        for col, values, kind in zip(cols, pack, _KINDS, strict=True):
            col.append(values.astype(kind).tobytes())
    arrays = [pa.array(parts, pa.int32()), pa.array(hots, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)]
    return pa.RecordBatch.from_arrays(arrays, names=_SENT)


def _send_windows(window: int, n: int):
    def run(batches):
        for block, ids, texts, keys in _blocks_with(batches, np.uint64):
            if not len(keys):
                continue
            w = Windows(texts, window)
            at = np.flatnonzero(w.ok)
            keys = np.sort(keys)
            mine = w.least[at] & LEFT
            where = np.searchsorted(keys & LEFT, mine)
            where[where == len(keys)] = 0
            ok = keys[where] & LEFT == mine
            at, hot = at[ok], (keys[where[ok]] & ~LEFT).astype(np.int64)
            if not len(at):
                continue
            hashes, mores = w.full(at)
            doc = w.doc[at]
            starts = at - w.words.first[doc]
            order_ids = _order_ids(ids)
            parts = anchor_part(w.least[at], n)
            salt = int(mix(np.array([block], np.uint64))[0] % U64(n))
            parts = np.where(hot == 1, (parts + salt) % n, parts)
            got = list(by_part(parts + n * hot, 2 * n))
            packs = []
            for _, k in got:
                new = np.append(True, doc[k][1:] != doc[k][:-1])  # positions ascend, and so do the numbers of texts in the block
                docs = doc[k][new]
                packs.append((np.stack([np.full(len(docs), block), docs, order_ids[docs]]), hashes[k], mores[k], np.cumsum(new) - 1, starts[k]))
            yield _packed([p % n for p, _ in got], [p // n for p, _ in got], packs)

    return run


RUN = np.dtype([("doc", np.uint16), ("start", np.uint32), ("n", np.uint32)])


def _judge(batches, n: int):
    """Rows of ``_SENT``, with ``block`` and ``runs``: to each block its windows that start earlier elsewhere, as runs; of hot windows the earliest goes on."""
    texts, cols, hots = [], [[], [], [], []], []
    base = 0
    for b in batches:
        for i in range(b.num_rows):
            texts.append(np.frombuffer(b.column("texts")[i].as_py(), np.int64).reshape(3, -1))
            for col, name, kind in zip(cols, _SENT[3:], _KINDS[1:], strict=True):
                col.append(np.frombuffer(b.column(name)[i].as_py(), kind))
            cols[2][-1] = cols[2][-1] + np.uint32(base)
            hots.append(np.full(texts[-1].shape[1], b.column("hot")[i].as_py() == 1))
            base += texts[-1].shape[1]
    if not texts:
        return
    hashes, mores, places, starts = (np.concatenate(c) for c in cols)
    blocks, docs, ids = np.concatenate(texts, axis=1)
    hots = np.concatenate(hots)
    del texts, cols
    order = np.argsort(hashes, kind="stable")  # most windows are alone: they go before the finer sort
    h = hashes[order]
    twice = np.zeros(len(h), bool)
    np.equal(h[1:], h[:-1], out=twice[1:])
    twice[:-1] |= twice[1:]
    if hots.any():
        twice |= hots[places[order]]
    kept = order[twice]
    del order, h, twice
    hashes, mores, places, starts = (x[kept] for x in (hashes, mores, places, starts))
    fine = np.lexsort((starts, ids[places], mores, hashes))
    h, m, p, s = (x[fine] for x in (hashes, mores, places, starts))
    del hashes, mores, places, starts, kept, fine
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    at = np.flatnonzero(new)
    first = np.repeat(at, np.diff(np.append(at, len(h))))
    later = (ids[p] != ids[p][first]) | (s != s[first])
    on = np.flatnonzero(~later & hots[p])
    yield from _runs(blocks[p[later]], docs[p[later]], s[later])
    if len(on):  # ties of id and start all go on: none of them is earlier than the other
        got = list(by_part(part_of(h[on], n), n))
        packs = []
        for _, k in got:
            used, local = np.unique(p[on[k]], return_inverse=True)
            packs.append((np.stack([blocks[used], docs[used], ids[used]]), h[on[k]], m[on[k]], local, s[on[k]]))
        sent = _packed([x for x, _ in got], [0] * len(got), packs)
        yield pa.RecordBatch.from_arrays([*sent.columns, pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.binary())], names=[*_SENT, "block", "runs"])


def _runs(block: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """The windows of each block as runs of neighbours."""
    if not len(block):
        return
    order = np.lexsort((start, doc, block))
    block, doc, start = block[order], doc[order], start[order].astype(np.int64)
    cut = np.ones(len(block), bool)
    cut[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(cut)
    runs = np.empty(len(at), RUN)
    runs["doc"], runs["start"], runs["n"] = doc[at], start[at], np.diff(np.append(at, len(block)))
    which = block[at]
    edges = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
    m = len(edges) - 1
    none = [pa.nulls(m, pa.int32()), *([pa.nulls(m, pa.binary())] * 5)]
    yield pa.RecordBatch.from_arrays([none[0], *none, pa.array(which[edges[:-1]]), pa.array([runs[a:e].tobytes() for a, e in zip(edges, edges[1:], strict=False)], pa.binary())], names=[*_SENT, "block", "runs"])


def _finish(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for _, ids, texts, runs in _blocks_with(batches, RUN):
            w = Words(texts, NON_SPACE)
            edge = np.zeros(len(w) + 1, np.int64)
            if len(runs):
                start = w.first[runs["doc"]] + runs["start"]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + runs["n"] + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.zeros(len(w) + 1, np.int64)
            np.cumsum(gone, out=total[1:])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            raw, offsets = w.data.tobytes(), w.offsets
            kept = []
            for d in range(len(texts)):
                words = raw[offsets[d] : offsets[d + 1]].split()
                if removed[d]:
                    flags = gone[w.first[d] : w.first[d + 1]].tolist()
                    words = [x for x, f in zip(words, flags, strict=True) if not f]
                kept.append(b" ".join(words))
            cols = [ids, pa.array(w.counts().astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([k.decode() for k in kept], pa.string())] * with_text, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of each row; ``window`` is even."""
    if window < 2 or window % 2:
        raise ValueError("window must be even: its halves are the level below")
    n = 2 * n_parts(docs.sparkSession)  # windows are many: half as much in a task
    rows, ranks, kind = picked(docs, doc_id=id_col, text=text_col), None, dict(docs.dtypes)[docs.columns[position(docs, id_col)]]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        ranks = written(global_rank(rows.select(F.col("doc_id").cast("string").alias("id")).where("id IS NOT NULL").distinct(), [F.col("id")], "rank"), "repeat-ranks")
        rows = rows.join(ranks, F.col("doc_id").cast("string") == ranks.id, "left").select(F.col("rank").alias("doc_id"), "text")
    judged = _SENT_SCHEMA + ", block long, runs binary"
    blocks = pack(rows.select(F.col("doc_id").cast("long"), "text"), "repeat-blocks")
    anchors = blocks.mapInArrow(_send_anchors(window, n), "part int, block long, keys binary").repartitionById(n, F.col("part"))
    survivors = anchors.mapInArrow(_repeated_anchors(HOT), "block long, payload binary")
    windows = _with_texts(blocks, survivors).mapInArrow(_send_windows(window, n), _SENT_SCHEMA)
    met = written(windows.repartitionById(n, F.col("part")).mapInArrow(lambda batches: _judge(batches, n), judged), "repeat-windows")
    last = met.where("runs IS NULL").select(*_SENT).repartitionById(n, F.col("part")).mapInArrow(lambda batches: _judge(batches, n), judged)
    later = met.unionAll(last).where("runs IS NOT NULL").select("block", F.col("runs").alias("payload"))
    out = _with_texts(blocks, later).mapInArrow(_finish(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if ranks is not None:
        out = out.join(ranks, out.doc_id == ranks["rank"], "left").select("id", *out.columns[1:]).withColumnRenamed("id", "doc_id")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
