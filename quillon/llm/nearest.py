r"""Exact top-k by inner product with dual-tree search over cover trees.

Vectors are packed into blocks, each with its cover tree; a task takes one block of queries and a run of
candidate blocks, one after the other.  The tree over the queries and that of each
candidate block are walked together: a pair of nodes is left out when the largest inner
product its covering radii allow lies below the worst kth score among the node's queries,
which carries over from block to block.  Leaves are scored by exact matrix products of whole numbers.

A cover-tree node covers its points within its radius; its children are a greedy net at
``1 / BASE`` of that radius.  A node whose net would need more than a quarter of its points as centres, or
whose first ``PROBE`` centres cover fewer than two points each, stays a leaf, as in high dimensions.

Query blocks meet candidate blocks, never rows: the data sent is (query blocks) x (candidates), packed
as the smallest whole numbers that hold them, and each run returns at most k rows a query, merged by a window over (query).

Numbers beyond ``EXACT`` are no exact doubles as products: a block with such components is one leaf, scored in doubles with
a bound of their error; whatever lies within it of the kth score is decided by Python integers.  Scores are reported clipped to a long.

Defined cases: vectors that are null or hold null or non-finite components take no part (nor those with a component that is
not finite times ``SCALE``), nor do rows with a null id; shorter vectors count as padded with zeros; rows that share the query's id are left
out as its own, and a query id that occurs twice has the k best of all its rows; repeated candidate rows each count; equal scores go to
the smaller id; fewer than k candidates give fewer rows; empty tables give none; other columns and their names do not matter.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import n_parts, picked, table, written

K = 20
SCALE = 64
QUERY_BLOCK, BLOCK = 8192, 8192  # at most 2**16 each: points of a tree are 16 bits
RUN = 16  # candidate blocks a task takes one after the other
LEAF, BASE = 64, 1.6
PROBE = 32  # centres after which a net must hold two points a centre
BITS = 13
EXACT = 2.0**49
NONE = -(1 << 62)  # below every key, and safe to negate


class Tree:
    """Cover tree: nodes as (centre, norm of centre, radius, children, points); points of leaves only."""

    def __init__(self, x: np.ndarray, root=None):
        if root is not None:
            self.root = root
            return
        self.x, self.squares = x, (x * x).sum(1)
        at = np.arange(len(x), dtype=np.uint16)
        centre = x[int(np.argmin(self.squares - 2 * (x @ x.mean(0))))] if len(x) else None
        self.root = self._node(centre, at, self._distances(at, centre)) if len(x) else None

    def _distances(self, at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Distances of points to a centre; squares of whole numbers are exact in doubles."""
        x = self.x if len(at) == len(self.x) else self.x[at]
        return np.sqrt(np.maximum(self.squares[at] - 2 * (x @ centre) + centre @ centre, 0.0))

    def _node(self, centre: np.ndarray, at: np.ndarray, dist: np.ndarray):
        radius = float(dist.max())
        norm = float(np.sqrt(centre @ centre))
        if len(at) <= LEAF or radius == 0.0:
            return (centre, norm, radius, None, at)
        reach, left, children = radius / BASE, np.arange(len(at)), []
        near = dist  # the node's centre is its first child's
        c = centre
        while len(left):
            inside = near <= reach
            members = left[inside]
            if len(members):
                children.append((c, at[members], near[inside]))
            left = left[~inside]
            if len(children) * 4 > max(16, len(at)) or len(children) >= PROBE and len(at) - len(left) < 2 * len(children):
                return (centre, norm, radius, None, at)
            if len(left):
                c = self.x[at[left[0]]]
                near = self._distances(at[left], c)
        return (centre, norm, radius, [self._node(*child) for child in children], at)

def search(q: np.ndarray, tree: Tree, c: np.ndarray, ctree: Tree, floor: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Keys (score * 2**BITS + order) of the k best of block ``c`` for each query; ``floor``: kth score from blocks before; ``own``: ids of both, equal ones are left out."""
    best = np.full((len(q), k), NONE, np.int64)
    worst = floor.copy()
    back = (1 << BITS) - 1 - np.arange(len(c), dtype=np.int64)

    def limit(node) -> float:
        return float(worst[node[4]].min())

    def upper(a, b) -> float:
        """Largest product the radii allow, and as much more as rounding may hide (its terms may cancel)."""
        middle, spread = float(a[0] @ b[0]), a[1] * b[2] + b[1] * a[2] + a[2] * b[2]
        return middle + spread + 1e-9 * (abs(middle) + spread) + 1e-6

    stack = [(tree.root, ctree.root)]
    while stack:
        a, b = stack.pop()
        if upper(a, b) < limit(a):
            continue
        if a[3] is None and b[3] is None:
            rows, cols = a[4], b[4]
            for i in range(0, len(rows), 256):
                r = rows[i : i + 256]
                keys = (np.rint(q[r] @ c[cols].T).astype(np.int64) << BITS) + back[cols]
                if own is not None:
                    keys[own[0][r][:, None] == own[1][cols][None, :]] = NONE
                both = np.concatenate([best[r], keys], 1)
                best[r] = got = -np.partition(-both, k - 1, axis=1)[:, :k]
                worst[r] = np.maximum(worst[r], np.where(got.min(1) == NONE, -np.inf, got.min(1) >> BITS))
        elif b[3] is None or (a[3] is not None and a[2] > b[2]):
            stack += [(child, b) for child in a[3]]
        else:  # the most promising candidates are popped first
            stack += sorted(((a, child) for child in b[3]), key=lambda p: upper(*p))
    return best



def _wide(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each query as Python integers: doubles with their error bound leave few to be decided exactly."""
    a, b = (np.maximum(np.abs(x).max(1, initial=0.0), 1.0) for x in (q, c))
    qs, cs = q / a[:, None], c / b[:, None]  # no product overflows
    order = np.argsort(cid, kind="stable")
    out: list[list[tuple[int, int]]] = []
    exact = {}

    def whole(j: int) -> list[int]:
        if j not in exact:
            exact[j] = [int(x) for x in c[j]]
        return exact[j]

    for i in range(len(q)):
        mine = order[cid[order] != qid[i]]
        near, scale = cs[mine] @ qs[i], b[mine] / b.max()  # scores over a[i] * b.max()
        slack = (4 + q.shape[1]) ** 2 * 2.0**-50 * scale + 1e-300
        score = near * scale
        low = score - slack
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        me = [int(x) for x in q[i]]
        some = [(sum(x * y for x, y in zip(me, whole(j), strict=True)), int(cid[j])) for j in mine[score + slack >= floor].tolist()]
        out.append(heapq.nsmallest(k, some, key=lambda p: (-p[0], p[1])))
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    top = float(np.abs(x).max(initial=0.0))
    return x.astype(np.int16) if top < 2**15 else x.astype(np.int32) if top < 2**31 else x


def _unpacked(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.float64}[width]).reshape(-1, dim).astype(np.float64)


def _largest(x: np.ndarray, dim: int) -> float:
    with np.errstate(over="ignore"):
        return float(np.square(np.abs(x).max(initial=0.0)) * max(1, dim))


def packed(vectors: DataFrame, dim: int, size: int, name: str) -> DataFrame:
    """(block, ids, width, data, tree): blocks of at most ``size`` rows of (id, v) in id order, as whole-number components, with their cover tree."""
    names = ["block", "ids", "width", "data", "tree"]

    def run(batches):
        base, n, ids, parts = TaskContext.get().partitionId() << 32, 0, [], []

        def flush():
            nonlocal n, ids, parts
            i, x = np.concatenate(ids), np.concatenate(parts)
            for at in range(0, len(i), size):
                o = np.argsort(i[at : at + size], kind="stable")
                block = x[at : at + size][o]
                kept = _small(block)
                root = Tree(block).root if _largest(block, dim) < EXACT else None
                row = [base + n, i[at : at + size][o].tobytes(), kept.dtype.itemsize, kept.tobytes(), pickle.dumps(root)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)
                n += 1
            ids, parts = [], []

        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lens = v.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, dim), np.float64)
            x[np.repeat(np.arange(b.num_rows), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.floor(SCALE * flat)
            ids.append(b.column("id").to_numpy())
            parts.append(x)
            if sum(map(len, ids)) >= size:
                yield from flush()
        if ids:
            yield from flush()

    return written(vectors.mapInArrow(run, "block long, ids binary, width int, data binary, tree binary"), name)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = picked(vectors, id=id_col, v=vec_col).select(F.col("id").cast("long").alias("id"), "v")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _number(block):
    """Blocks in an order that deals them out evenly: few blocks a partition of the writer."""
    return F.shiftright(block, 32) + block.bitwiseAND(F.lit(0xFFFFFFFF))


def _beyond(score: int) -> str:
    """Orders scores that are clipped to the same long; empty for the others."""
    if -(1 << 63) <= score < 1 << 63:
        return ""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def _task(dim: int, k: int):
    def done(qid, top):
        out = [(int(q), int(v), int(max(-(1 << 63), min((1 << 63) - 1, s))), _beyond(int(s))) for q, row in zip(qid, top, strict=True) for s, v in row]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    def run(batches):
        at = q = qid = tree = top = None
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda name: b.column(name)[i].as_py()  # noqa: B023, E731
                key = (cell("qblock"), cell("run"))
                if key != at:
                    if at is not None:
                        yield done(qid, top)
                    at = key
                    qid = np.frombuffer(cell("qids"), np.int64)
                    q = _unpacked(cell("qdata"), cell("qwidth"), dim)
                    tree, top = Tree(q, pickle.loads(cell("qtree"))), [[] for _ in qid]
                cid = np.frombuffer(cell("ids"), np.int64)
                c = _unpacked(cell("data"), cell("width"), dim)
                if max(_largest(q, dim), _largest(c, dim)) >= EXACT:
                    fresh = _wide(q, c, qid, cid, k)
                else:  # one more than k, for the query's own row
                    floor = np.array([row[k - 1][0] if len(row) >= k else -np.inf for row in top], np.float64)
                    twice = len(np.unique(cid)) < len(cid)
                    keys = search(q, tree, c, Tree(c, pickle.loads(cell("tree"))), floor, k + 1, (qid, cid) if twice else None)
                    fresh = []
                    for row, me in zip(-np.sort(-keys, axis=1), qid, strict=True):
                        row = row[row != NONE]
                        who = cid[(1 << BITS) - 1 - (row & ((1 << BITS) - 1))]
                        fresh.append([(s, v) for s, v in zip((row >> BITS).tolist(), who.tolist(), strict=True) if v != me][:k])
                top = [heapq.nsmallest(k, old + new, key=lambda p: (-p[0], p[1])) for old, new in zip(top, fresh, strict=True)]
        if at is not None:
            yield done(qid, top)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of highest inner product, ties to smaller ids."""
    spark = vectors.sparkSession
    vectors, queries = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    dim = max(d.select(F.max(F.size("v"))).first()[0] or 0 for d in (vectors, queries))
    cand = packed(vectors, dim, BLOCK, "vectors")
    asked = packed(queries, dim, QUERY_BLOCK, "queries")
    # a run holds RUN blocks at most on average, fewer while cores would be idle
    n, blocks, groups = n_parts(spark), cand.count(), max(1, asked.count())
    runs = max(1, -(-blocks // RUN), min(blocks, -(-n // groups)))
    q = asked.select(F.col("block").alias("qblock"), *(F.col(c).alias(f"q{c}") for c in ("ids", "width", "data", "tree")), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    pairs = q.join(cand.withColumn("run", F.pmod(_number(F.col("block")), F.lit(runs)).cast("int")), "run")
    slot = F.pmod(_number(F.col("qblock")) * runs + F.col("run"), F.lit(n)).cast("int")
    found = pairs.repartitionById(n, slot).sortWithinPartitions("qblock", "run", "block").mapInArrow(_task(dim, k), "query_id long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
