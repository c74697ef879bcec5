r"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's characters are folded (A-Z and accented Latin-1 capitals lower-cased, runs of other ASCII signs become one space, one space at either
end), and its features are the distinct n-grams of ``SIZES`` characters, by 64-bit hashes.  From at most ``FIT_ROWS`` labelled ids a class (those of
least hash, outside the held-out fold) come the vocabulary and the model:

1. n-grams of toxic texts that occur in at least ``LEAST`` of them (or one in ``RARE``), at most ``CANDIDATES``;
2. how many texts of either class hold each, its log-count ratio r, and the ``FEATURES`` of largest log-likelihood gain;
3. a logistic regression on presence * r, fitted by Spark, each row weighted by its class's share of all labels.

The model is two arrays of ``FEATURES`` numbers, sent with the scoring function; every text is scored whole in one pass.

Neither labels nor lang, source or doc_id enter a score.  Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0.

Defined cases: null text counts as empty and is scored like any text; very long texts are whole; null or conflicting repeated labels are left out (a doc_id
labelled both 0 and 1), equal repeats count once; with one class, no labels or no n-gram every score is that class's rate (0 without labels); repeated rows are
scored one by one; ids of any type, null ones are never learned from; an empty table gives no rows; other columns and their names do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import U64, picked, table, text_bytes, written
from quillon.llm.quality import slices

SIZES = (4, 5, 6)
FIT_ROWS = 4_000  # labelled ids of each class
LEAST, RARE = 3, 200
CANDIDATES = 200_000
FEATURES = 8_192
SMOOTH = 0.5
PENALTY = 1e-3
THRESHOLD = 0.5
PLACES = 1 << 40
PIECE = 512 << 10  # bytes of text whose n-grams a worker holds at a time, or one text
BUCKETS = 22  # bits of the filter in front of the exact lookup

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123)
_BASE, _SPREAD = U64(0x9E3779B97F4A7C15 | 1), U64(0xD6E8FEB86659FD93)


class Grams:
    """Folded characters of a batch of texts and the hashes of their n-grams."""

    def __init__(self, column):
        data, offsets = text_bytes(column)
        data = _FOLD[data]
        if len(data) > 1:
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            data[1:][capital] += 0x20
        lead = (data & 0xC0) != 0x80
        lead[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text that begins within a character begins a character
        at = np.flatnonzero(lead)
        codes = data[at].astype(np.uint32)
        size = np.diff(np.append(at, len(data)))
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            codes[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
        first = np.searchsorted(at, offsets)
        n = len(offsets) - 1
        # a space before and after each text
        place = np.arange(len(codes)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1
        all_codes = np.full(len(codes) + 2 * n, 32, np.uint32)
        all_codes[place] = codes
        first = first + 2 * np.arange(n + 1)
        keep = np.ones(len(all_codes), bool)
        if n:
            keep[1:] = (all_codes[1:] != 32) | (all_codes[:-1] != 32)
            keep[first[:-1]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.codes, self.first, self.n = all_codes[keep], kept[first], n

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def hashes(self):
        """(size, hash of the n-gram at each place, which places hold a whole one)."""
        h = self.codes.astype(U64)
        for size in range(2, max(SIZES) + 1):
            if len(self.codes) < size:
                return
            h = h[: len(self.codes) - size + 1] * _BASE
            h += self.codes[size - 1 :]
            if size in SIZES:
                whole = np.ones(len(h), bool)
                for k in range(1, size):
                    cut = self.first[1:-1] - k
                    whole[cut[(cut >= 0) & (cut < len(h))]] = False
                yield size, h, whole


class Vocabulary:
    """Exact lookup of hashes behind a filter of one bit a bucket."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.seen = np.zeros(1 << BUCKETS, bool)
        self.seen[self._bucket(hashes)] = True

    @staticmethod
    def _bucket(h):
        return (h * _SPREAD) >> U64(64 - BUCKETS)

    def found(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all features present, each once."""
        docs, features = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, h, whole in grams.hashes():
            at = np.flatnonzero(self.seen[self._bucket(h)] & whole)
            i = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            hit = self.sorted[i] == h[at]
            docs.append(grams.doc(at[hit]))
            features.append(self.order[i[hit]])
        n = max(1, len(self.sorted))
        both = np.unique(np.concatenate(docs) * n + np.concatenate(features))
        return both // n, both % n


class Model:
    """Feature hashes, their weights (ratio times coefficient) and the intercept; without features the rate of class 1."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        self.words, self.weights, self.intercept = (Vocabulary(hashes) if len(hashes) else None), weights, intercept

    def score(self, texts) -> np.ndarray:
        margin = np.full(len(texts), self.intercept)
        if self.words is not None:
            docs, features = self.words.found(Grams(texts))
            margin += np.bincount(docs, self.weights[features], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def _sample(labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, place) of at most ``most`` labelled ids of each class, those of least hash, and how many ids each class has."""
    one = labels.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))
    one = written(one.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))), "toxic-labels")
    sizes = {r.y: r["count"] for r in one.groupBy("y").count().collect()}  # two rows
    parts = []
    for y in (0, 1):  # a little more than wanted comes to one task, whatever the table
        share = min(1.0, 1.1 * most / max(1, sizes.get(y, 0)) + 1e-6)
        parts.append(one.where((F.col("y") == y) & (F.col("place") <= int(share * PLACES))).orderBy("place", "doc_id").limit(most))
    return parts[0].unionByName(parts[1]), sizes


def _toxic_grams(batches):
    """(hash, texts that hold it) of each batch of toxic texts."""
    for b in batches:
        for (texts,) in slices(b, "text", limit=PIECE):
            g = Grams(texts)
            each = []
            for _, h, whole in g.hashes():
                for d in range(g.n):
                    a, z = g.first[d], min(g.first[d + 1], len(h))
                    each.append(np.unique(h[a:z][whole[a:z]]) if z > a else h[:0])
            h, n = np.unique(np.concatenate(each) if each else np.empty(0, U64), return_counts=True)
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000].astype(np.int64))], names=["h", "n"])


def _gain(a: int, n1: int, b: int, n0: int) -> float:
    """Log-likelihood gain of telling the classes apart by a feature that a of n1 and b of n0 texts hold."""
    total, held = n1 + n0, a + b
    out = 0.0
    for seen, row, col in ((a, n1, held), (b, n0, held), (n1 - a, n1, total - held), (n0 - b, n0, total - held)):
        if seen:
            out += seen * math.log(seen * total / (row * col))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS) -> Model:
    """The classifier from labelled texts outside the held-out fold; the driver holds at most ``CANDIDATES`` hashes and ``FEATURES`` weights."""
    none = np.empty(0, U64), np.empty(0)
    y = picked(labels, doc_id=id_col, y=label_col).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids, sizes = _sample(y, most)
    texts = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(ids), "doc_id").select("y", "place", F.coalesce("text", F.lit("")).alias("text"))  # at most 2 * most ids
    texts = written(texts, "toxic-sample")
    rows = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    if not n0 or not n1:
        return Model(*none, 30.0 if n1 else -30.0)
    least = max(min(LEAST, n1), n1 // RARE)
    toxic = texts.where("y = 1").select("text").mapInArrow(_toxic_grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    known = np.array([r.h for r in toxic.orderBy(F.desc("n"), "h").limit(CANDIDATES).collect()], np.int64).view(U64)
    if not len(known):
        return Model(*none, math.log(n1 / n0))

    def held(batches):
        words, counts = Vocabulary(known), np.zeros((2, len(known)), np.int64)
        for b in batches:
            for ys, t in slices(b, "y", "text", limit=PIECE):
                d, f = words.found(Grams(t))
                of = ys.to_numpy()[d]
                for c in (0, 1):
                    counts[c] += np.bincount(f[of == c], minlength=len(known))
        i = np.flatnonzero(counts.any(0))
        for k in range(0, len(i), 50_000):
            j = i[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(counts[0][j]), pa.array(counts[1][j])], names=["i", "n0", "n1"])

    counted = texts.select("y", "text").mapInArrow(held, "i long, n0 long, n1 long").groupBy("i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()  # at most CANDIDATES rows
    best = sorted(counted, key=lambda r: (-_gain(r.n1, n1, r.n0, n0), r.i))[:FEATURES]
    hashes = known[[r.i for r in best]]
    ratio = np.array([math.log((r.n1 + SMOOTH) / (n1 + 2 * SMOOTH)) - math.log((r.n0 + SMOOTH) / (n0 + 2 * SMOOTH)) for r in best])
    total = sum(sizes.values())
    weight = {0: sizes.get(0, 0) / total * (n0 + n1) / n0, 1: sizes.get(1, 0) / total * (n0 + n1) / n1}

    def present(batches):
        words = Vocabulary(hashes)
        for b in batches:
            for ys, places, t in slices(b, "y", "place", "text", limit=PIECE):
                d, f = words.found(Grams(t))
                cuts = np.searchsorted(d, np.arange(len(t) + 1))
                yield pa.RecordBatch.from_arrays([ys, places, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(f.astype(np.int32)))], names=["y", "place", "features"])

    fit = _fitted(texts.mapInArrow(present, "y int, place long, features array<int>"), ratio, weight)
    return Model(hashes, fit[0] * ratio, fit[1])


def _fitted(rows: DataFrame, ratio: np.ndarray, weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on presence * ratio; one ordered partition of at most 2 * FIT_ROWS rows, so that reruns agree."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    size = len(ratio)
    sparse = F.udf(lambda f: Vectors.sparse(size, f, ratio[f]), VectorUDT())
    rows = written(rows.select("place", F.col("y").cast("double").alias("label"), F.when(F.col("y") == 1, weight[1]).otherwise(weight[0]).alias("weight"), sparse("features").alias("features")), "toxic-features")
    model = LogisticRegression(maxIter=100, regParam=PENALTY, standardization=False, weightCol="weight").fit(rows.repartition(1).sortWithinPartitions("place"))
    return model.coefficients.toArray(), model.intercept


def scores_of(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    rows = picked(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            for ids, texts in slices(b, "doc_id", "text", limit=PIECE):
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(texts))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores_of(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
