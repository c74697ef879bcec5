r"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set is its distinct 5-word shingles (A-Z lower-cased); documents with one set share a
set id, so copies enter once.  Texts are read and hashed once.  Exact at every size:

1. Row blocks of the incidence matrix are packed (hash, row) and dealt by hash.  Columns
   with one row are dropped: they add to no overlap.  What is left comes back by set.
2. A set of n shingles of which fewer than ceil(0.8 n) are shared cannot reach any
   partner's bound and ends there; so texts that share a passage cost nothing further.
3. The others are posted under their rarest shingles (prefix of n - ceil(0.8 n) + 1 in
   order of document frequency, then hash): linked sets share one of these.  Under each
   shingle, sizes and positions bound the overlap and discard pairs below it.  These pairs are the mask of the product.
4. The product of the masked pairs: a block holds some rows of the matrix as hubs and streams the rows that meet them.  Overlaps are
   accumulated one column block after the other, and after each the pairs that cannot reach ceil((n + m) 0.8 / 1.8) any more are discarded.
5. First every set meets only the most central set under each of its shingles, the one whose
   shingles are most frequent (a star, linear in postings: near copies link to what they were copied from).  Then components are
   taken, and a second product takes the remaining pairs, leaving out those within one
   component, which cannot change the result.  A group of near copies is thus never expanded into pairs.
6. Components by label propagation with pointer jumping over written tables.

Nothing gathers a hot key.  Shingles under which very many sets are posted, at most 16 a partition, have their most central set sent to all tasks;
pairs left under them are dealt as a grid of chunks.  A hub that very many rows meet is copied, each copy with its share of them.  Hot labels and
set ids are joined by ``with_hot_keys``.

Shingles are equal by 48 bits of hash within a pair; sets by 128 bits: should two sets have one 64-bit id, which a second hash tells,
their ids are replaced and the work is done again.

Defined cases: texts without words and null texts have size 0 and link with nothing; fewer than five words make one
shingle of the whole sequence; very long texts are whole; null doc_ids are never a component's name unless all its ids are null; repeated rows each get
a row; ids of any type, the least by its order; empty tables work; other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import NON_SPACE, U64, Words, join_hash, mix, n_parts, numbered, picked, position, table, whole_windows, window_hashes, with_hot_keys, written
from quillon.llm.quality import slices
from quillon.llm.repeats import by_part, gathered, part_of

N = 5
#: Similarity as a ratio of whole numbers: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 60_000
HASH = ~U64(0xFFFF)  # the 48 bits of a shingle's hash that are kept
LOW48 = U64(0xFFFFFFFFFFFF)
ID_BITS = 64  # of a set id; fewer only in tests
HOT_POSTS, HOT_PAIRS = 1000, 48  # least number of postings of a hot shingle, of pairs of a hot hub
COLUMN_BLOCKS = 4
PRODUCT_BYTES = 8 << 20  # of the rows that meet hubs at a time


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any partner: ceil(n * NUM / DEN)."""
    return -(-n * NUM // DEN)


def bound(n, m):
    """Least overlap of linked sets of n and m: ceil((n + m) * t / (1 + t))."""
    return -(-(n + m) * NUM // (NUM + DEN))


def incidence(texts, clash: np.ndarray, bits: int = ID_BITS, size: int = N) -> tuple[np.ndarray, ...]:
    """(row, hash) of the distinct shingles of a batch of texts in row order, set sizes, set ids (0 if empty) and second ids.

    Ids in ``clash`` stand for several sets and are replaced by others made from the second ids."""
    w = Words(texts, NON_SPACE)
    h = w.hashes(lower=True)
    windows = window_hashes(h, size)
    at = np.flatnonzero(whole_windows(w.first, size, len(windows)))
    rows, hashes = [w.doc()[at]], [windows[at]]
    counts = w.counts()
    for k in range(1, size):  # whole short texts
        docs = np.flatnonzero(counts == k)
        if len(docs):
            rows.append(docs)
            hashes.append(join_hash(window_hashes(h, k)[w.first[docs]], np.full(len(docs), k, np.uint64)))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    sizes = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    edges = np.append(0, np.cumsum(sizes))

    def summed(salt: int) -> np.ndarray:
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + U64(salt)), out=total[1:])
        return mix((total[edges[1:]] - total[edges[:-1]]) + sizes.astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    second = summed(0x2545F4914F6CDD1D)
    ids = summed(0x632BE59BD9B4E019) >> U64(64 - bits) | U64(1)
    if len(clash):
        ids = np.where(np.isin(ids, clash), mix(second + U64(1)) | U64(1), ids)
    return rows, hashes, sizes, np.where(sizes > 0, ids, U64(0)), second


_SENT = ["part", "block", "sids", "sizes", "keys"]


def _send_incidence(n: int, clash: np.ndarray, bits: int):
    """Row blocks of the matrix by column partition (block 0), and the rows themselves (block 1), which only pass through."""

    def run(batches):
        turn = TaskContext.get().partitionId() * 7  # deals the rows of tasks and slices evenly
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_DOCS):
                for ids, prints, texts in slices(b.slice(at, BLOCK_DOCS), "doc_id", "print", "text", limit=BLOCK_BYTES):
                    rows, hashes, sizes, sids, second = incidence(texts, clash, bits)
                    turn += 1
                    out = [(turn % n, 1, sids.tobytes(), sizes.astype(np.int32).tobytes(), _stream(ids, prints, second))]
                    _, keep = np.unique(sids, return_index=True)  # copies within the block enter once
                    first = np.zeros(len(sids), bool)
                    first[keep] = True
                    mine = first[rows]
                    rows, hashes = rows[mine], hashes[mine]
                    order = np.argsort(hashes)
                    rows, hashes = rows[order], hashes[order]
                    parts = part_of(hashes, n)
                    edges = np.searchsorted(parts, np.arange(n + 1))
                    for p in range(n):
                        here = slice(edges[p], edges[p + 1])
                        if edges[p + 1] > edges[p]:
                            docs, local = np.unique(rows[here], return_inverse=True)
                            out.append((p, 0, sids[docs].tobytes(), sizes[docs].astype(np.int32).tobytes(), ((hashes[here] & HASH) | local.astype(np.uint64)).tobytes()))
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=_SENT)

    return run


def _stream(ids, prints, second: np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids, prints, pa.array(second.view(np.int64))], names=["doc_id", "print", "second"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _without_rows(batches, held: list):
    """The blocks of the matrix; the batches of rows are put aside."""
    for b in batches:
        rows = b.column("block").to_numpy() == 1
        if rows.any():
            held.append(b.filter(pa.array(rows)))
            b = b.filter(pa.array(~rows))
        if b.num_rows:
            yield b


def _shared_columns(n: int):
    """Of a hash partition: for each set its shingles that other sets have too, as min(df, 65535) and hash."""

    def run(batches):
        aside = []
        _, apart, joined, source = gathered(_without_rows(batches, aside), ["sids", "sizes", "keys"], [np.uint64, np.int32, np.uint64])
        for b in aside:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.nulls(b.num_rows, pa.binary()), b.column("keys")], names=["part", "block", "sids", "sizes", "counts", "keys"])
        if not len(source):
            return
        sids, sizes = np.empty(len(source), np.uint64), np.empty(len(source), np.int32)
        keys = joined["keys"]
        edges = np.searchsorted(source, np.arange(len(apart["sids"]) + 1))
        for k in range(len(apart["sids"])):
            part = slice(edges[k], edges[k + 1])
            local = (keys[part] & U64(0xFFFF)).astype(np.int64)
            sids[part], sizes[part] = apart["sids"][k][local], apart["sizes"][k][local]
        h = keys >> U64(16)
        order = np.argsort(h, kind="stable")
        h = h[order]
        twice = np.zeros(len(h), bool)  # most columns have one row: they go before the finer sort
        same = h[1:] == h[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order, h = order[twice], h[twice]
        finer = np.lexsort((sids[order], h))
        order, h = order[finer], h[finer]
        s = sids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        order, h, s = order[new], h[new], s[new]
        cut = np.ones(len(h), bool)
        cut[1:] = h[1:] != h[:-1]
        df = np.diff(np.append(np.flatnonzero(cut), len(h)))
        df = np.repeat(df, df)
        keep = df > 1
        values = (np.minimum(df[keep], 0xFFFF).astype(np.uint64) << U64(48)) | h[keep]
        s, z = s[keep], sizes[order][keep]
        by_set = np.argsort(s, kind="stable")
        s, z, values = s[by_set], z[by_set], values[by_set]
        parts = part_of(s, n)
        edges = np.searchsorted(parts, np.arange(n + 1))
        for p in range(n):
            if edges[p + 1] > edges[p]:
                here = slice(edges[p], edges[p + 1])
                u, at, count = np.unique(s[here], return_index=True, return_counts=True)
                blobs = [u, z[here][at], count.astype(np.int32), values[here]]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([0], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["part", "block", "sids", "sizes", "counts", "keys"])

    return run


_SET = ["sid", "n", "keys", "doc_id", "print", "second"]


def _sets_that_can_link(ids: pa.DataType):
    """(sid, n, keys) of the sets that share enough shingles, keys in order of frequency, then hash; and of each row, without keys, its id, print and second set id."""

    def run(batches):
        aside = []
        _, apart, joined, _ = gathered(_without_rows(batches, aside), ["sids", "sizes", "counts", "keys"], [np.uint64, np.int32, np.int32, np.uint64])
        for b in aside:
            for sids, sizes, stream in zip(*(b.column(c) for c in ("sids", "sizes", "keys")), strict=True):
                rows = pa.ipc.open_stream(stream.as_py()).read_next_batch()
                sid, n = np.frombuffer(sids.as_py(), np.int64), np.frombuffer(sizes.as_py(), np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid, mask=n == 0), pa.array(n), pa.nulls(len(n), pa.binary()), *rows.columns], names=_SET)
        if not apart["sids"]:
            return
        heads, sizes, counts = (np.concatenate(apart[n]) for n in ("sids", "sizes", "counts"))
        u, at, inverse = np.unique(heads, return_index=True, return_inverse=True)
        n = sizes[at].astype(np.int64)
        have = np.bincount(inverse, weights=counts, minlength=len(u)).astype(np.int64)
        able = have >= needed(n)
        mine = np.repeat(inverse, counts)
        keep = able[mine]
        mine, keys = mine[keep], joined["keys"][keep]
        order = np.lexsort((keys, mine))
        mine, keys = mine[order], keys[order]
        which = np.flatnonzero(able)
        edges = np.searchsorted(mine, np.append(which, len(u)))
        for k in range(0, len(which), 2000):
            part = which[k : k + 2000]
            blobs = [keys[edges[i] : edges[i + 1]].tobytes() for i in range(k, k + len(part))]
            none = [pa.nulls(len(part), t) for t in (ids, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(u[part].view(np.int64)), pa.array(n[part]), pa.array(blobs, pa.binary()), *none], names=_SET)

    return run


POST = np.dtype([("hash", np.uint64), ("sid", np.uint64), ("comp", np.uint64), ("n", np.int32), ("rest", np.int32), ("mean", np.float32), ("cell", np.uint32), ("side", np.uint8)])
TOP = U64(1 << 63)  # turns the order of unsigned numbers into that of signed ones


def _posts_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """Postings of each set of a batch under its prefix, and their document frequencies; ``rest``: how many of its shingles stand at or after this one."""
    out, dfs = [np.empty(0, POST)], [np.empty(0, np.uint64)]
    for sid, comp, n, blob in zip(*(batch.column(c) for c in ("sid", "comp", "n", "keys")), strict=True):
        keys, n = np.frombuffer(blob.as_py(), np.uint64), n.as_py()
        lone = n - len(keys)
        first = keys[: max(0, n - int(needed(np.int64(n))) + 1 - lone)]
        p = np.zeros(len(first), POST)
        p["hash"] = first & LOW48
        p["sid"], p["comp"] = np.int64(sid.as_py()).view(np.uint64), np.int64(comp.as_py()).view(np.uint64)
        p["n"], p["rest"] = n, n - lone - np.arange(len(first))
        p["mean"] = (float((keys >> U64(48)).sum()) + lone) / n
        out.append(p)
        dfs.append(first >> U64(48))
    return np.concatenate(out), np.concatenate(dfs)


def _tell_hot(most: int):
    """Of shingles that may be hot: postings, the most central set, least and greatest component; and all postings, under no shingle."""

    def run(batches):
        total = 0
        kinds = [pa.int64(), pa.int64(), pa.float32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for b in batches:
            posts, df = _posts_of(b)
            total += len(posts)
            posts = posts[df > most]
            posts = posts[np.lexsort((posts["sid"], -posts["mean"], posts["hash"]))]
            at = _starts(posts["hash"])
            if len(at):
                lead, signed = posts[at], lambda x: (x ^ TOP).view(np.int64)
                low, high = np.minimum.reduceat(posts["comp"], at), np.maximum.reduceat(posts["comp"], at)
                cols = [lead["hash"].astype(np.int64), np.diff(np.append(at, len(posts))), -lead["mean"], signed(lead["sid"]), signed(lead["comp"]), lead["n"], lead["rest"], signed(low), signed(high)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, t in zip(cols, kinds, strict=True)], names=_HOT)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.array([total], kinds[1]), *(pa.nulls(1, t) for t in kinds[2:])], names=_HOT)

    return run


_HOT = ["hash", "posts", "mean", "sid", "comp", "n", "rest", "low", "high"]


def _starts(values: np.ndarray) -> np.ndarray:
    cut = np.ones(len(values), bool)
    cut[1:] = values[1:] != values[:-1]
    return np.flatnonzero(cut)


class Hot:
    """The hot shingles: their most central postings, into how many chunks their postings go, and which have sets of one component only."""

    def __init__(self, sets: DataFrame, parts: int):
        told = sets.mapInArrow(_tell_hot(HOT_POSTS), "hash long, posts long, mean float, sid long, comp long, n int, rest int, low long, high long")
        every = written(told.groupBy("hash").agg(F.sum("posts").alias("posts"), F.min(F.struct("mean", "sid", "comp", "n", "rest")).alias("lead"), F.min("low").alias("low"), F.max("high").alias("high")), "jaccard-hot")
        total = every.where("hash IS NULL").agg(F.sum("posts")).first()[0] or 0
        limit = max(HOT_POSTS, total / (16 * parts))
        rows = every.where(F.col("hash").isNotNull() & (F.col("posts") > limit)).orderBy("hash").collect()  # at most 16 a partition
        self.hash = np.array([r["hash"] for r in rows], np.uint64)
        self.chunks = np.array([int(r.posts // limit) + 1 for r in rows], np.int64)
        self.one = np.array([r.low == r.high for r in rows], bool)
        self.lead = np.zeros(len(rows), POST)
        for name in ("sid", "comp"):
            self.lead[name] = np.array([r["lead"][name] for r in rows], np.int64).view(np.uint64) ^ TOP
        for name in ("n", "rest"):
            self.lead[name] = [r["lead"][name] for r in rows]
        self.lead["mean"], self.lead["hash"] = [-r["lead"]["mean"] for r in rows], self.hash

    def among(self, posts: np.ndarray) -> np.ndarray:
        """Number of the hot shingle of each posting, -1 for others."""
        if not len(self.hash):
            return np.full(len(posts), -1)
        at = np.searchsorted(self.hash, posts["hash"])
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == posts["hash"], at, -1)


def _post(parts: int, hot: Hot, star: bool):
    """Postings by shingle.  Hot ones are left out of stars; else those with several components go to a grid of chunks."""

    def run(batches):
        for b in batches:
            posts, _ = _posts_of(b)
            which = hot.among(posts)
            deal = [posts[which < 0]]
            places = [part_of(deal[0]["hash"] << U64(16), parts)]
            for k in [] if star else np.unique(which[which >= 0]):
                if hot.one[k]:
                    continue
                mine, c = posts[which == k], int(hot.chunks[k])
                chunk = (mix(mine["sid"]) % U64(c)).astype(np.int64)
                for other in range(c):
                    sent = mine.copy()
                    sent["cell"] = np.minimum(chunk, other) * c + np.maximum(chunk, other) + 1
                    sent["side"] = np.where(chunk == other, 2, chunk < other)
                    deal.append(sent)
                    places.append((mix(sent["hash"] * U64(31) + sent["cell"].astype(np.uint64)) % U64(parts)).astype(np.int32))
            posts, place = np.concatenate(deal), np.concatenate(places)
            got = list(by_part(place, parts))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([0] * len(got), pa.int64()), pa.array([posts[at].tobytes() for _, at in got], pa.binary())], names=["part", "block", "posts"])

    return run


def _pairs(p: np.ndarray, q: np.ndarray):
    """(hub, member) of pairs of postings: the hub is the more central set, of equal ones that of the smaller id."""
    swap = (q["mean"] > p["mean"]) | ((q["mean"] == p["mean"]) & (q["sid"] < p["sid"]))
    hub, member = np.where(swap, q["sid"], p["sid"]), np.where(swap, p["sid"], q["sid"])
    order = np.lexsort((member, hub))
    hub, member = hub[order], member[order]
    new = np.ones(len(hub), bool)
    new[1:] = (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])
    return pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in (hub, member)], names=["hub", "member"])


def _feasible(p, q):
    """Which of the pairs of postings under one shingle can still reach their bound, by size and position."""
    most = np.minimum(p["rest"], q["rest"])
    return (p["sid"] != q["sid"]) & (p["comp"] != q["comp"]) & (most >= bound(p["n"].astype(np.int64), q["n"].astype(np.int64)))


def _sorted_posts(batches):
    """Postings by shingle (and cell of its grid), the most central set (largest mean document frequency of its shingles) first; where each shingle starts."""
    _, _, joined, _ = gathered(batches, ["posts"], [POST])
    posts = joined["posts"]
    posts = posts[np.lexsort((posts["sid"], -posts["mean"], posts["cell"], posts["hash"]))]
    cut = np.ones(len(posts), bool)
    cut[1:] = (posts["hash"][1:] != posts["hash"][:-1]) | (posts["cell"][1:] != posts["cell"][:-1])
    return posts, np.flatnonzero(cut)


def _star(batches):
    """Pairs of each posting with the most central set under its shingle."""
    posts, at = _sorted_posts(batches)
    if len(posts):
        lead = np.repeat(at, np.diff(np.append(at, len(posts))))
        p, q = posts[lead], posts
        ok = _feasible(p, q)
        yield _pairs(p[ok], q[ok])


def _hot_star(hot: Hot):
    """Pairs of the sets posted under hot shingles with the most central sets there."""

    def run(batches):
        for b in batches:
            posts, _ = _posts_of(b)
            which = hot.among(posts)
            q = posts[which >= 0]
            p = hot.lead[which[which >= 0]]
            ok = _feasible(p, q)
            yield _pairs(p[ok], q[ok])

    return run


STEP = 4_000_000


def _remaining(batches):
    """All pairs under a shingle that are feasible and not of one component, by a sweep over sizes."""
    posts, at = _sorted_posts(batches)
    ends = np.append(at, len(posts))[1:]
    out_p, out_q, held = [], [], 0
    for s, e in zip(at, ends, strict=True):
        if e - s < 2 or (posts["comp"][s:e] == posts["comp"][s]).all():
            continue
        run = posts[s:e][np.argsort(posts["n"][s:e], kind="stable")]
        n = run["n"].astype(np.int64)
        far = np.searchsorted(n, n * DEN // NUM, "right")  # partners at least as large, within the ratio of sizes
        width = far - np.arange(len(run)) - 1
        k = 0
        while k < len(run):
            to = k + max(1, int(np.searchsorted(np.cumsum(width[k:]), STEP, "right")))
            w = width[k:to]
            i = np.repeat(np.arange(k, min(to, len(run))), w)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            ok = _feasible(run[i], run[j])
            if run["cell"][0]:  # a cell of a grid: only pairs between its two chunks, or within one
                ok &= (run["side"][i] != run["side"][j]) | (run["side"][i] == 2)
            out_p.append(run[i[ok]])
            out_q.append(run[j[ok]])
            held += int(ok.sum())
            if held > STEP:
                yield _pairs(np.concatenate(out_p), np.concatenate(out_q))
                out_p, out_q, held = [], [], 0
            k = to
    if out_p:
        yield _pairs(np.concatenate(out_p), np.concatenate(out_q))


def product(hub_of: np.ndarray, hub_keys: np.ndarray, hub_sizes: np.ndarray, pair_hub: np.ndarray, pair_of: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs of rows of a block are linked.

    ``hub_keys`` are the columns of hub ``hub_of``; pair p is of hub ``pair_hub[p]`` and the row whose columns are the ``keys`` with ``pair_of`` p; sizes are
    those of the whole sets.  Overlaps are summed column block by column block, and pairs whose bound is out of reach are left out of further ones.
    """
    shift = U64(48 - (COLUMN_BLOCKS - 1).bit_length())
    grid = np.bincount(hub_of * COLUMN_BLOCKS + (hub_keys >> shift).astype(np.int64), minlength=len(hub_sizes) * COLUMN_BLOCKS).reshape(-1, COLUMN_BLOCKS)
    block = (keys >> shift).astype(np.int64)
    mine = np.bincount(pair_of * COLUMN_BLOCKS + block, minlength=len(sizes) * COLUMN_BLOCKS).reshape(-1, COLUMN_BLOCKS)
    left = np.minimum(grid[pair_hub], mine)
    reach = left.sum(1)  # the most that overlaps can become
    least = bound(hub_sizes[pair_hub], sizes)
    total, alive = np.zeros(len(sizes), np.int64), reach >= least
    rows = np.sort((hub_of.astype(np.uint64) << U64(48)) | hub_keys)
    for c in range(COLUMN_BLOCKS):
        at = np.flatnonzero((block == c) & alive[pair_of])
        if not len(at) or not len(rows):
            continue
        wanted = (pair_hub[pair_of[at]].astype(np.uint64) << U64(48)) | keys[at]
        where = np.searchsorted(rows, wanted)
        where[where == len(rows)] = 0
        got = np.bincount(pair_of[at][rows[where] == wanted], minlength=len(sizes))
        total += got
        reach = reach - left[:, c] + got
        alive &= reach >= least
    return alive & (total >= least)


def _linked(batches):
    """Links (a, b) of the hubs and the rows that meet them, which come in order: each hub, then its rows."""
    at, hub_keys, hub_size = None, np.empty(0, np.uint64), 0
    for batch in batches:
        offsets = np.append(0, np.cumsum(pa.compute.binary_length(batch.column("keys")).to_numpy().astype(np.int64)))
        i = 0
        while i < batch.num_rows:
            to = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + PRODUCT_BYTES, "right")) - 1), i + 30_000)
            b = batch.slice(i, to - i)
            i = to
            is_hub = b.column("kind").to_numpy() == 0
            n, sid, hub = (b.column(c).to_numpy() for c in ("n", "sid", "hub"))
            lists = [np.frombuffer(x.as_py(), np.uint64) & LOW48 for x in b.column("keys")]
            hubs = np.flatnonzero(is_hub)
            hub_lists = [hub_keys, *(lists[k] for k in hubs)]  # the hub of the slice before comes first
            hub_sizes = np.array([hub_size, *n[hubs]], np.int64)
            number = np.cumsum(is_hub)
            pairs = np.flatnonzero(~is_hub)
            if len(pairs):
                pair_lists = [lists[k] for k in pairs]
                lengths = [len(x) for x in pair_lists]
                ok = product(np.repeat(np.arange(len(hub_lists)), [len(x) for x in hub_lists]), np.concatenate(hub_lists), hub_sizes, number[pairs], np.repeat(np.arange(len(pairs)), lengths), np.concatenate(pair_lists), n[pairs])
                yield pa.RecordBatch.from_arrays([pa.array(hub[pairs][ok]), pa.array(sid[pairs][ok])], names=["a", "b"])
            if len(hubs):
                hub_keys, hub_size = hub_lists[-1].copy(), int(hub_sizes[-1])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs (hub, member) that are linked, by the product of the rows of ``sets``."""
    n = n_parts(pairs.sparkSession)
    degree = written(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "jaccard-hubs")
    limit = max(HOT_PAIRS, (degree.agg(F.sum("n")).first()[0] or 0) / (16 * n))
    copies = degree.select(F.col("hub"), F.ceil(F.col("n") / limit).cast("int").alias("copies"))
    hubs = copies.select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).join(sets.select(F.col("sid").alias("hub"), "n", "keys"), "hub").select("hub", "copy", F.lit(0).alias("kind"), F.col("hub").alias("sid"), "n", "keys")
    shared = F.broadcast(copies.where("copies > 1"))  # at most 16 a partition
    met = pairs.join(shared, "hub", "left").withColumn("copy", F.pmod(F.xxhash64("member"), F.coalesce("copies", F.lit(1))).cast("int"))
    rows = met.join(sets.select(F.col("sid").alias("member"), "n", "keys"), "member").select("hub", "copy", F.lit(1).alias("kind"), F.col("member").alias("sid"), "n", "keys")
    return hubs.unionAll(rows).repartition(n, "hub", "copy").sortWithinPartitions("hub", "copy", "kind").mapInArrow(_linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes of ``links`` (a, b)."""
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = edges.count()
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "n"), "labels")
    while True:
        near = with_hot_keys(edges, labels.select(F.col("node").alias("b"), "label", "n"), "b", ["label"], ["a"], total).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"), "n")
        moved = written(moved, "labels")
        held = moved.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        up = written(labels.select(F.col("node").alias("label"), F.col("label").alias("up")).join(held, "label"), "label-ups")
        jumped = with_hot_keys(moved, up, "label", ["up"], ["node"])
        moved = written(jumped.select("node", F.least("label", "up").alias("label"), "was", "n"), "labels")
        labels = moved.select("node", "label", "n")
        if not moved.where("label <> was").limit(1).count():
            return labels.select("node", "label")


def linked_sets(sets: DataFrame) -> DataFrame:
    """(sid, label): component of each of the sets (sid, n, keys) that links with another; others are absent."""
    n = n_parts(sets.sparkSession)

    def posted(rows: DataFrame, hot: Hot, star: bool):
        return rows.mapInArrow(_post(n, hot, star), "part int, block long, posts binary").repartitionById(n, F.col("part"))

    alone = sets.withColumn("comp", F.col("sid"))
    hot = Hot(alone, n)
    star = posted(alone, hot, True).mapInArrow(_star, "hub long, member long")
    if len(hot.hash):
        star = star.unionAll(alone.mapInArrow(_hot_star(hot), "hub long, member long"))
    star = written(star.distinct(), "jaccard-star")
    links = written(_links(star, sets), "jaccard-links")
    first = components(links)
    known = written(sets.join(first.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "keys", F.coalesce("label", "sid").alias("comp")), "jaccard-known")
    rest = posted(known, Hot(known, n), False).mapInArrow(_remaining, "hub long, member long").distinct().join(star, ["hub", "member"], "left_anti")
    more = written(_links(written(rest, "jaccard-rest"), sets), "jaccard-links")
    if more.limit(1).count():
        first = components(links.unionAll(more))
    return first.select(F.col("node").alias("sid"), "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, n_shingles, sid, label, component_id) of each row; sid and label are null for empty sets, print is a hash of the text."""
    n = n_parts(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("print"), "text")
    kind, clash = dict(rows.dtypes)["doc_id"], np.empty(0, np.uint64)
    while True:
        sent = rows.mapInArrow(_send_incidence(n, clash, ID_BITS), "part int, block long, sids binary, sizes binary, keys binary").repartitionById(n, F.col("part"))
        back = sent.mapInArrow(_shared_columns(n), "part int, block long, sids binary, sizes binary, counts binary, keys binary").repartitionById(n, F.col("part"))
        arrow = to_arrow_type(rows.schema["doc_id"].dataType)
        both = written(back.mapInArrow(_sets_that_can_link(arrow), f"sid long, n long, keys binary, doc_id {kind}, print long, second long"), "jaccard-sets")
        meta = both.where("keys IS NULL").select("doc_id", "print", F.col("n").alias("n_shingles"), "sid", "second")
        grouped = written(meta.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("second").alias("s"), F.max("second").alias("t")), "jaccard-ids")
        twice = [r.sid for r in grouped.where("s <> t").select("sid").collect()]  # of k sets, k * k / 2 ** 65 are expected
        if not twice:
            break
        clash = np.concatenate([clash, np.array(twice, np.int64).view(np.uint64)])
    linked = linked_sets(both.where("keys IS NOT NULL").select("sid", "n", "keys"))
    by_set = written(grouped.join(linked, "sid", "left").select("sid", "least", "n", F.coalesce("label", "sid").alias("label")), "jaccard-labels")
    by_label = written(by_set.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "jaccard-names")
    names = with_hot_keys(by_set, by_label, "label", ["component_id"], ["sid"])
    named = with_hot_keys(meta.drop("second"), written(names.select("sid", "label", "component_id", "n"), "jaccard-named"), "sid", ["label", "component_id"], ["doc_id", "print"])
    return named.select("doc_id", "print", "n_shingles", "sid", "label", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the least doc_id reachable by links."""
    return classes(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one of least id; rows without words all stay."""
    of = classes(docs, id_col, text_col).where("sid IS NOT NULL AND doc_id <=> component_id")
    one = of.groupBy("label").agg(F.min("print").alias("print"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))  # one text, should one id stand for several
    keep = written(one.select(F.col("id").alias("__id"), F.col("print").alias("__print"), "n"), "jaccard-kept")
    rows, at, text = numbered(docs), f"c{position(docs, id_col)}", F.col(f"c{position(docs, text_col)}")
    blank = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = rows.where(~blank).withColumn("__of", F.xxhash64(text)).join(keep, F.col(at).eqNullSafe(keep["__id"]) & (F.col("__of") == keep["__print"])).drop("__id", "__print")
    if keep.where("n > 1").limit(1).count():  # repeated rows of one id and one text
        kept = kept.dropDuplicates([at, "__of"])
    return kept.select(*rows.columns).unionAll(rows.where(blank)).toDF(*docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
