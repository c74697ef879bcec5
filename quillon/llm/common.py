"""Shared parts of the training-data operators: word tables, vectorised hashing, shared storage.

Words are runs of bytes of a class given as a 256-entry table; because every
byte of a multi-byte UTF-8 character is above 0x7F, byte classes and character
classes agree for the classes used here.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ROW_GROUP = 16 << 20  # bytes a task holds of a table it writes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~_SPACE
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_STEP = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240917)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[0x41:0x5B] = _BYTES[0x61:0x7B]
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); a local session may do without one, a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def position(df: DataFrame, name: str) -> int:
    """Index of the column of this very name, else of the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1, ...: no name of the input can clash, hold a dot or differ in case only."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``new=old`` alone, whatever else the input has."""
    return numbered(df).select(*(F.col(f"c{position(df, old)}").alias(new) for new, old in names.items()))


def with_hot_keys(rows: DataFrame, table: DataFrame, key: str, values: list[str], spread: list[str], total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique ``key``, ``values``, and ``n``: how many rows have the key).

    Keys with more than a quarter of a partition's fair share of rows are at most 4 * partitions, so they go as a broadcast and
    their rows are dealt by ``spread`` instead; all other rows meet their key by a shuffle.  ``table`` is read three times.
    """
    parts = 4 * n_parts(rows.sparkSession)
    if total is None:
        total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * parts > total
    names = [f"__v{i}" for i in range(len(values))]
    given = [F.col(v).alias(n) for v, n in zip(values, names, strict=True)]
    few = table.where(hot).select(F.col(key).alias("__few"), *given)
    many = table.where(~hot).select(F.col(key).alias("__many"), F.lit(0).alias("__none"), *(c.alias(f"{n}m") for c, n in zip(given, names, strict=True)))
    near = rows.join(F.broadcast(few), rows[key] == few["__few"], "left")  # at most 4 * partitions rows
    near = near.withColumn("__deal", F.when(F.col("__few").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")))
    both = near.join(many, (near[key] == many["__many"]) & (near["__deal"] == many["__none"]), "left")
    return both.select(*(rows[c] for c in rows.columns), *(F.when(F.col("__few").isNotNull(), F.col(n)).otherwise(F.col(f"{n}m")).alias(v) for v, n in zip(values, names, strict=True)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, _STEP + 4096), base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= _STEP + 4096:
            _POWERS[base] = got
    return got


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Word positions of a batch of texts: ``starts``/``ends`` into ``data``, ``first[d]:first[d+1]`` the words of text d."""

    def __init__(self, column, inside: np.ndarray = NON_SPACE):
        self.data, self.offsets = text_bytes(column)
        n = len(self.data)
        word = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before &= ~edge[:n]
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``lower`` folds A-Z."""
        codes = _BYTES_LOWER if lower else _BYTES
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _STEP, "right")))
            at, to = int(self.starts[i]), int(self.ends[j - 1])
            n = to - at
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes[self.data[at:to]] * _powers(_BASE, n)[:n], out=sums[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * _powers(_INV, n + 1)[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
            i = j
        return out


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0xA0761D6478BD642F) + right * U64(0xE7037ED1A0B428DB) + U64(0x8EBC6AF09C88C6E3))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by doubling; windows over text borders are the caller's to drop."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    have, level, length, done, bit = None, words, 1, 0, k
    while bit:
        if bit & 1:
            have = level if have is None else join_hash(have[: len(words) - done - length + 1], level[done:])
            done += length
        bit >>= 1
        if bit:
            level = join_hash(level[:-length], level[length:])
            length *= 2
    return have[: len(words) - k + 1]


def whole_windows(first: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """Which of the windows 0..n_windows-1 lie within one text."""
    ok = np.zeros(n_windows, bool)
    counts = np.diff(first)
    room = np.maximum(counts - k + 1, 0)
    starts = np.repeat(first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
    ok[starts] = True
    return ok
