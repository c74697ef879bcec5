r"""URL filters: nested host/path rules by a sort-merge range join.

A rule's canonical key is its host with labels reversed, each followed by ``\x01``, then ``\x02``, then its path.  A url asks
once for its host and once for each domain above it, with the same path; so a rule fits exactly those keys that begin with
its own, an interval of the sorted keys, and intervals are nested or apart.

Keys are cut into one range a partition at boundaries from a sample of (key, row), so a host or url with a third of all rows
is spread over many partitions; the sample (at most about ``SAMPLES`` keys a partition) only places the cuts.  A rule goes to each partition its
interval meets: all rules once, and those that reach over a cut again, at most as many a partition as prefixes of one key.  In each
partition one pass over rules and keys in sorted order keeps a stack of the open nested rules; the top one
is the longest that fits.  Rules are a DataFrame of any size or a list; there is one way at every size.

The longest rule (host plus path, in characters) of all of a url's keys wins; equal lengths go to the rule of smaller name
(host plus path), then to the smaller verdict, in code point order.

Defined cases: a null url, or one without ``://``, has empty host and path; no rule fits an empty path unless its path is empty.
Rules with a null host or path are no rules, those with a null verdict give the default.  Repeated rows are judged one by one, whatever their
ids; very long urls are whole keys.  An empty table gives no rows; without rules every row has the default.  Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import n_parts, picked, table, written

SAMPLES = 64
#: (host, path, verdict) of the contract, in its order.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_path(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def _key(host, path):
    """Canonical key; the signs it is made of are escaped within hosts."""
    for sign, told in (("\x03", "\x03c"), ("\x01", "\x03a"), ("\x02", "\x03b")):
        host = F.replace(host, F.lit(sign), F.lit(told))
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01\x02"), path)


def _domains(host):
    """A host and all domains above it."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _cuts(keys: DataFrame, parts: int) -> list[tuple[str, int]]:
    """At most parts - 1 ascending (key, row), which cut ``keys`` into ranges of about equal size."""
    every = max(1, keys.count() // (SAMPLES * parts))
    held = sorted((r.key, r.row) for r in keys.where(F.pmod(F.xxhash64("row", "key"), F.lit(every)) == 0).collect())
    return [held[len(held) * i // parts] for i in range(1, parts)] if len(held) >= parts else held[: parts - 1]


def _deal_keys(cuts):
    def run(batches):
        for b in batches:
            at = [bisect_right(cuts, x) for x in zip(b.column("key").to_pylist(), b.column("row").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["part", *b.schema.names])

    return run


def _deal_rules(cuts):
    keys = [k for k, _ in cuts]

    def run(batches):
        for b in batches:
            parts, rows = [], []
            for i, key in enumerate(b.column("key").to_pylist()):
                low = bisect_left(keys, key)
                high = bisect_left(keys, True, low, key=lambda k: not k.startswith(key))  # noqa: B023
                parts += range(low, high + 1)
                rows += [i] * (high + 1 - low)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in b.columns)], names=["part", *b.schema.names])

    return run


def _sweep(batches):
    """(row, size, rule, verdict) of the longest open rule at each key of a partition in key order, rules first."""
    stack, out = [], []
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("key", "row", "size", "rule", "verdict"))
        for key, row, size, rule, verdict in zip(*columns, strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row is None:
                stack.append((key, size, rule, verdict))
            elif stack:
                out.append((row, *stack[-1][1:]))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["row", "size", "rule", "verdict"])


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row; ``default`` where no rule fits."""
    spark = pages.sparkSession
    n = n_parts(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = picked(rules, host="host", path="path", verdict="verdict").where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min(F.coalesce("verdict", F.lit(default))).alias("verdict"))
    kept = rules.select(_key(F.col("host"), F.col("path")).alias("key"), (F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    host, path = host_path(F.col("url"))
    rows = written(picked(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "url-rows")
    keys = rows.select("row", "path", F.explode(_domains(F.col("host"))).alias("domain")).select(_key(F.col("domain"), F.col("path")).alias("key"), "row")
    cuts = _cuts(keys, n)
    asked = keys.mapInArrow(_deal_keys(cuts), "part int, key string, row long")
    given = kept.mapInArrow(_deal_rules(cuts), "part int, key string, size int, rule string, verdict string")
    both = given.withColumn("row", F.lit(None).cast("long")).unionByName(asked, allowMissingColumns=True)
    met = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", F.col("row").asc_nulls_first()).mapInArrow(_sweep, "row long, size int, rule string, verdict string")
    best = met.groupBy("row").agg(F.min(F.struct((-F.col("size")).alias("size"), "rule", "verdict")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(h, q, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, h || q AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
