"""Immutable generations: tables written beside each other, sealed, then made known by an entry of the commit log.

A generation is a folder of Parquet tables with a seal (rows, columns and a checksum of each); readers see it only through the log
(``commits``), whose entry is written last.  Queries hold a ``Snapshot``, so a swap never changes what a running query reads.
All access goes through Spark and its file systems, so any storage they can reach works.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import canonical_json
from quillon.sources.commits import Commit, CommitLog

log = logging.getLogger(__name__)


class GenerationMismatch(ValueError):
    """A request names another generation than the one pinned."""


class SealBroken(ValueError):
    """A generation's tables are not those that were sealed."""


class Snapshot:
    def __init__(self, generation: str, tables: dict[str, DataFrame], number: int | None = None):
        self.generation, self.tables, self.number = generation, tables, number

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def require(self, expected: str | None) -> Snapshot:
        if expected is not None and expected != self.generation:
            raise GenerationMismatch(f"generation {self.generation} is pinned, {expected} was expected")
        return self


def _folder(root: str, generation: str) -> str:
    return f"{root.rstrip('/')}/gen={generation}"


def _checksum(df: DataFrame) -> int:
    """A number that does not depend on the order of rows: the exclusive or of their hashes and how often each occurs."""
    text = F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") if "map" in t or "variant" in t else F.col(f"`{c}`").alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes))))
    each = df.select(F.xxhash64(text).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.bit_xor(F.xxhash64("h", "n"))).first()[0] or 0


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, parent: int | None = None) -> str:
    """Write a generation, seal it and enter it in the log; returns its id.  Tables with keys are range-partitioned and sorted by them.

    With ``parent``, the number of the snapshot it was made from, a commit made meanwhile raises ``CommitConflict``; without, it comes after whatever is there.
    """
    generation = uuid.uuid4().hex
    for name, df in tables.items():
        by = (keys or {}).get(name)
        ordered = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
        ordered.write.parquet(f"{_folder(root, generation)}/{name}")
    written = {name: spark.read.parquet(f"{_folder(root, generation)}/{name}") for name in tables}
    seal = [(name, written[name].count(), canonical_json(df.dtypes), _checksum(written[name])) for name, df in tables.items()]
    spark.createDataFrame(seal, "name string, n long, columns string, checksum long").coalesce(1).write.parquet(f"{_folder(root, generation)}/sealed_tables")
    CommitLog(spark, root).commit(generation, parent)
    return generation


def current(spark: SparkSession, root: str, since: int | None = None) -> Commit:
    """The last entry of the log (from entry ``since`` on)."""
    found = CommitLog(spark, root).last(since)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return found


def load(spark: SparkSession, root: str, generation: str | None = None, whole: bool = False) -> Snapshot:
    """Read a sealed generation, the last one unless it is named; rows and columns (and with ``whole`` every value) must be those of its seal."""
    number = None
    if generation is None:
        number, generation, _ = current(spark, root)
    tables = {}
    try:
        sealed = spark.read.parquet(f"{_folder(root, generation)}/sealed_tables").collect()  # one row a table
        for name, n, columns, checksum in sealed:
            df = spark.read.parquet(f"{_folder(root, generation)}/{name}")
            if canonical_json(df.dtypes) != columns or df.count() != n or whole and _checksum(df) != checksum:
                raise SealBroken(f"{name} of generation {generation} does not match its seal")
            tables[name] = df
    except AnalysisException as error:  # a folder or its footers are gone
        raise SealBroken(f"generation {generation} cannot be read") from error
    return Snapshot(generation, tables, number)


def poll(spark: SparkSession, root: str, held: Snapshot | None) -> Snapshot:
    """The newest readable generation after the held one; the held one while there is none.

    Entries are tried from the newest back to the held one, never further; those that are broken are logged.  Without a held one the newest that can be read is taken, and
    if there is none the newest one's fault raises.
    """
    entries = CommitLog(spark, root)
    at = None if held is None else held.number
    newest = entries.last(at)
    if newest is None and at is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    if newest is None or newest.number == at or held is not None and newest.generation == held.generation:
        return held
    fault = None
    for entry in entries.history(newest.number):
        if at is not None and entry.number <= at or held is not None and entry.generation == held.generation:
            return held
        try:
            got = load(spark, root, entry.generation)
        except SealBroken as error:
            log.warning("entry %d: %s", entry.number, error)
            fault = fault or error
        else:
            got.number = entry.number
            return got
    if held is None:
        raise fault
    return held


def object_path(digest: str) -> str:
    """Place of content-addressed bytes below a root."""
    if len(digest) != 64 or any(c not in "0123456789abcdef" for c in digest):
        raise ValueError("not a SHA-256 digest")
    return f"sha256/{digest[:2]}/{digest}"


def byte_range(header: str, size: int) -> tuple[int, int]:
    """[start, end] of a single-range header; several ranges or ones outside raise."""
    unit, _, spec = header.partition("=")
    first, dash, last = spec.partition("-")
    if unit.strip() != "bytes" or not dash or "," in spec:
        raise ValueError("unsupported range")
    if first == "":
        n = int(last)
        if n <= 0 or size == 0:
            raise ValueError("unsatisfiable range")
        return max(0, size - n), size - 1
    start, end = int(first), min(int(last), size - 1) if last else size - 1
    if start >= size or end < start:
        raise ValueError("unsatisfiable range")
    return start, end


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Distinct wanted keys that the cache does not hold."""
    return wanted.select(*key).distinct().join(cache.select(*key), key, "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The cache with fresh entries for keys it lacks; entries it has stay."""
    return cache.unionByName(fresh.dropDuplicates(key).join(cache.select(*key), key, "left_anti"))


def unfinished(queries: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """Queries that no finished shard holds: what a resumed run has left to do."""
    return queries.join(shards.select(key).distinct(), key, "left_anti")
