r"""Quality classifier: regularised quadratic discriminant over document statistics.

``features`` turns each whole text into a few transformed statistics (byte classes,
word shape, repetition, length).  Per class, count, mean and scatter are summed on
the cluster (the driver receives d * d numbers a class, whatever the input), the
covariance is shrunk towards a scaled identity, and its Cholesky factor is cached
on the driver and sent with the scoring function.  The score is the posterior of
label 1 from the difference of the two Mahalanobis log-densities, flattened by a
temperature so that it stays graded.

Neither labels nor lang, source or doc_id enter a score.  Labels are learned from rows
whose crc32(doc_id as text) mod 4 is not 2, from at most ``FIT_ROWS`` labelled ids (those of least hash); so features are computed for these
and once for each row that is scored, whatever the size.

Defined cases: null text counts as
empty and is scored like any text; very long texts are whole; null or conflicting repeated labels are left out
(a doc_id labelled both 0 and 1), equal repeats count once; with one class or no labels every score is that class's
rate (0.5 without labels); repeated rows are scored one by one; ids of any type; an empty table gives no rows; other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import NON_SPACE, Words, numbered, picked, position, table, text_bytes, written

SHRINK = 0.05
TEMPERATURE = 4.0
THRESHOLD = 0.7
FIT_ROWS = 20_000  # labelled ids the model is fitted on
PLACES = 1 << 40
SLICE_BYTES = 2 << 20


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _lut(bytes(range(65, 91)))
_LOWER = _lut(bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _lut(b"0123456789")
_MARKS = _lut(b".,;:'\"()-?")
_LINE = _lut(b"\n")
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _MARKS | ~NON_SPACE)
_CLASSES = (_UPPER, _MARKS, _SYMBOL, _LINE)  # digits are left out: personal data is no sign of junk
N_FEATURES = 10


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(column) -> np.ndarray:
    """One row of N_FEATURES numbers for each text of an Arrow string column."""
    w = Words(column, NON_SPACE)
    n_docs = len(w.offsets) - 1
    size = np.diff(w.offsets).astype(float)
    counts = w.counts().astype(float)
    rates = [(_sums(c[w.data], w.offsets) + 0.02 * k) / (size + k) for c, k in zip(_CLASSES, (80, 40, 40, 40), strict=True)]
    doc, hashes = w.doc(), w.hashes()
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    distinct = np.bincount(d[at], minlength=n_docs).astype(float)
    top = np.zeros(n_docs)
    np.maximum.at(top, d[at], runs)
    twice = np.zeros(n_docs)  # repeated word pairs: looped text
    if len(hashes) > 1:
        pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        inner = doc[:-1] == doc[1:]
        pd_, ph = doc[:-1][inner], pair[inner]
        o = np.lexsort((ph, pd_))
        pd_, ph = pd_[o], ph[o]
        again = (pd_[1:] == pd_[:-1]) & (ph[1:] == ph[:-1])
        np.add.at(twice, pd_[1:][again], 1)
    lens = (w.ends - w.starts).astype(float)
    mean_len = (_sums(lens, w.first) + 6 * 5) / (counts + 5)
    sym_end = _SYMBOL[w.data[w.ends - 1]] if len(w) else np.zeros(0, bool)
    lone = (lens == 1) & (_SYMBOL[w.data[w.starts]] if len(w) else np.zeros(0, bool))
    cols = [
        *(np.log(r) for r in rates),
        np.log(mean_len),
        (top + 1) / (counts + 20),
        np.log((distinct + 20) / (counts + 20)),
        np.log((twice + 0.4) / (counts + 20)),
        (_sums(sym_end, w.first) + 0.02) / (counts + 4),
        (_sums(lone, w.first) + 0.02) / (counts + 4),
    ]
    return np.column_stack(cols) if n_docs else np.zeros((0, N_FEATURES))


class Model:
    """Class means, Cholesky factors of shrunk covariances and log-prior; ``score`` gives the posterior of label 1."""

    def __init__(self, stats: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, temperature: float = TEMPERATURE):
        """stats: class -> (rows, sum, sum of outer products)."""
        self.rate = 0.5
        total = sum(n for n, _, _ in stats.values())
        if total:
            self.rate = stats.get(1, (0, 0, 0))[0] / total
        self.temperature, self.parts = temperature, None
        if not all(stats.get(c, (0,))[0] >= 2 for c in (0, 1)):
            return
        mean = sum(s for _, s, _ in stats.values()) / total
        scale = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in stats.values()) / total - np.outer(mean, mean)), 1e-12))
        self.mean, self.scale, self.parts = mean, scale, []
        for c in (0, 1):
            n, s, q = stats[c]
            mu = s / n
            cov = (q / n - np.outer(mu, mu)) / np.outer(scale, scale)
            d = len(mu)
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts.append(((mu - mean) / scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.rate)
        z = (x - self.mean) / self.scale
        dens = [-0.5 * ((((z - mu) @ inv.T) ** 2).sum(1) + logdet) for mu, inv, logdet in self.parts]
        margin = (dens[1] - dens[0] + np.log(self.rate / (1 - self.rate))) / self.temperature
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def slices(batch, *names, limit: int = SLICE_BYTES):
    """A batch cut into runs of rows of about ``limit`` bytes of its last named column."""
    cols = [batch.column(n) for n in names]
    n, at = len(cols[-1]), 0
    if not n:
        return
    _, offsets = text_bytes(cols[-1])
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(n, to)
        yield [c.slice(at, to - at) for c in cols]
        at = to


def held_out(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled ids outside the held-out fold, those of least hash."""
    rows = picked(labels, doc_id=id_col, y=label_col).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", "y")
    one = written(one.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))), "quality-labels")
    total = one.count()
    if total > most:  # a little more than wanted comes to one task, whatever the table
        one = one.where(F.col("place") <= int(1.1 * most / total * PLACES))
    return one.orderBy("place", "doc_id").limit(most).select("doc_id", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_ROWS) -> Model:
    """Sums over labelled rows outside the held-out fold; only class sums reach the driver."""
    y = F.broadcast(labelled(labels, "doc_id", label_col, most))  # at most FIT_ROWS ids
    rows = picked(docs, doc_id=id_col, text=text_col).join(y, "doc_id").select(F.col("y").cast("int").alias("y"), "text")

    def partial(batches):  # features and their sums in one pass: a second one would double the Python workers
        stats = {}
        for b in batches:
            for ys, texts in slices(b, "y", "text"):
                x, ys = features(texts), ys.to_numpy()
                for c in (0, 1):
                    got = x[ys == c]
                    if len(got):
                        n, s, q = stats.get(c, (0, 0.0, 0.0))
                        stats[c] = (n + len(got), s + got.sum(0), q + got.T @ got)
        for c, (n, s, q) in stats.items():
            v = np.concatenate([[float(n)], s, q.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["y", "i", "v"])

    sums = rows.mapInArrow(partial, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    d, stats = N_FEATURES, {}
    for c in (0, 1):
        v = np.zeros(1 + d + d * d)
        for y_, i, value in sums:
            if y_ == c:
                v[i] = value
        stats[c] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Model(stats)


def scores_of(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    rows = picked(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            for ids, texts in slices(b, "doc_id", "text"):
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(features(texts)))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""
    index = position(docs, text_col)
    rows = numbered(docs)

    def run(batches):
        for b in batches:
            keep = [np.zeros(0, bool)]
            for (texts,) in slices(pa.RecordBatch.from_arrays([b.column(index)], names=["t"]), "t"):
                keep.append(model.score(features(texts)) >= least)
            yield b.filter(pa.array(np.concatenate(keep)))

    return rows.mapInArrow(run, T.StructType(rows.schema.fields)).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores_of(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
