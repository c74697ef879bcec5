r"""Phrase collocation mining: counts of word n-grams by sorting packed keys, scored by their weakest cut.

1. Texts are cut into pieces and words, chunk by chunk; a chunk keeps its own word list with counts and its texts as codes of that list.
2. Word lists are added up per language; words that occur at least ``least`` times get ids from 1, dense, in order of (language, word).  A chunk holds a word once,
   so no word is more than one row a chunk.
3. Each chunk meets the ids of its own words (a cogroup by chunk), pieces break at all other words, and n-grams of ids become keys of fixed width: as many
   bytes an id as the largest id needs.  A chunk sorts its keys by radix, counts runs, and deals them over ranges of the mixed key, so that neither a common word nor a
   common phrase meets in one task (a range gets one counted run of a key and chunk); how many ranges there are follows from the number of words.
4. A range radix-sorts its runs and adds equal keys; keys below ``least`` end there.
5. Joins of the counts give each phrase its cuts, score, longer phrases, words and rank; each task keeps the first ``top`` of a language before they are gathered.

A phrase that occurs often enough has only words, parts and shorter phrases that do, so nothing is lost on the way.

Scores are decimals of 38 digits: exact for counts up to 10^16.  A phrase is dropped if one that is one word longer holds it often enough: longer ones still
imply such a one.

Defined cases: null text counts as empty, null lang as ``und``, together with that very name; very long texts are whole; repeated rows count each; equal scores go by
count, then by phrase in order of UTF-8 bytes.  Empty tables, or texts without phrases, give no rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import U64, Words, join_hash, n_parts, picked, table, written
from quillon.llm.quality import slices
from quillon.operators.ordering import running_sums

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
CHUNK = 6 << 20  # bytes of text in a chunk
KEYS = 2_000_000  # n-gram places a range is meant for; what a task fetches, sorts and sends to Python is one range

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK_ROW = "chunk long, codes binary, lang array<string>, word array<string>, n array<long>"


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as ``width`` bytes each, all first bytes first: alike bytes stand together and compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


def encoded(langs, texts):
    """(codes, lang, word, count) of some texts: 0 in codes is the end of a piece, k + 1 the k-th entry of the list."""
    w = Words(texts, _WORD)
    if not len(w):
        return None
    data = w.data.tobytes()  # translated byte by byte; as an index each would be eight bytes
    bounds = np.empty(2 * len(w), np.int64)
    bounds[0::2], bounds[1::2] = w.starts, w.ends
    # words and the gaps between them in turn: one string array over the bytes as they are
    strings = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data.translate(_LOWER.tobytes()))).dictionary_encode()
    langs = langs.fill_null("und").dictionary_encode()
    doc = w.doc()
    pair = langs.indices.to_numpy()[doc].astype(np.int64) * len(strings.dictionary) + strings.indices.to_numpy()[0::2]
    entries, code, n = np.unique(pair, return_inverse=True, return_counts=True)
    cuts = np.flatnonzero(np.frombuffer(data.translate(_CUT.tobytes()), bool))  # places of the few cuts, not a count for every byte
    ends = np.flatnonzero((np.searchsorted(cuts, w.starts[1:]) != np.searchsorted(cuts, w.ends[:-1])) | (doc[1:] != doc[:-1])) + 1
    codes = np.insert(code.ravel().astype(np.uint32) + np.uint32(1), ends, np.uint32(0))
    which, name = np.divmod(entries, len(strings.dictionary))
    return codes, langs.dictionary.take(pa.array(which)), strings.dictionary.take(pa.array(name)).cast(pa.string()), n


def _chunks(batches):
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for b in batches:
        for langs, texts in slices(b, "lang", "text", limit=CHUNK):
            got = encoded(langs, texts)
            if got is not None:
                codes, lang, word, n = got
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([_planes(codes, 4)], pa.binary()), one(lang), one(word), one(pa.array(n.astype(np.int64)))], names=["chunk", "codes", "lang", "word", "n"])
                at += 1
                del got, codes, lang, word, n
                pa.default_memory_pool().release_unused()  # a worker that waits holds none of it


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Ascending order of rows of unsigned numbers, least significant digit (16 bits) first; numpy sorts such digits by radix."""
    order = None
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def runs(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in ascending order, and how many (or the sum of ``n``) each has."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at) if len(at) else n[:0]
    return [c[at] for c in columns], counts


def _dealt(longest: int, width: int, parts: int):
    """The counted keys of one chunk, a row for each length and range."""
    schema = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        out = []
        for data in chunk.column("codes").to_pylist():
            codes = _numbers(data, 4)
            ids = np.zeros(int(codes.max()) + 1, np.uint32)
            ids[words.column("code").to_numpy() + 1] = words.column("id").to_numpy()
            ids = ids[codes]
            whole = ids > 0
            for size in range(2, longest + 1):
                whole = whole[:-1] & (ids[size - 1 :] > 0)
                at = np.flatnonzero(whole)
                if not len(at):
                    break
                columns, n = runs([ids[at + k] for k in range(size)])
                mixed = columns[0].astype(U64)
                for c in columns[1:]:
                    mixed = join_hash(mixed, c.astype(U64))
                part = ((mixed >> U64(32)) * U64(parts)) >> U64(32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    i = order[cuts[p] : cuts[p + 1]]
                    out.append((int(p), size, b"".join(_planes(c[i], width) for c in columns), _planes(n[i], 4)))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)

    return run


def _added(width: int, least: int):
    """(ids, f) of keys of a range that occur often enough; rows come sorted by range and length."""

    def counted(size, keys, n):
        columns = [np.concatenate([_numbers(k[len(k) // size * j : len(k) // size * (j + 1)], width) for k in keys]) for j in range(size)]
        columns, total = runs(columns, np.concatenate([_numbers(x, 4) for x in n]).astype(np.int64))
        keep = total >= least
        flat = np.column_stack([c[keep] for c in columns]).ravel().astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([ids, pa.array(total[keep])], names=["ids", "f"])

    def run(batches):
        now, keys, n = None, [], []
        for b in batches:
            for part, size, k, c in zip(*(b.column(x).to_pylist() for x in ("part", "size", "keys", "n")), strict=True):
                if (part, size) != now:
                    if keys:
                        yield counted(now[1], keys, n)
                    now, keys, n = (part, size), [], []
                keys.append(k)
                n.append(c)
        if keys:
            yield counted(now[1], keys, n)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, lang, word, f) of frequent words, (ids, f) of frequent phrases of 2 to ``longest`` words, and (lang, n) with all word occurrences."""
    spark = docs.sparkSession
    rows = picked(docs, lang=lang_col, text=text_col).select(F.col("lang").cast("string").alias("lang"), "text")
    chunks = written(rows.mapInArrow(_chunks, _CHUNK_ROW), "phrase-chunks")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("code", "e")).select("chunk", "code", "e.lang", "e.word", "e.n")
    totals = written(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    often = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = written(running_sums(often, [F.col("lang"), F.col("word")], id=F.lit(1)).withColumn("id", F.col("id").cast("int")), "phrase-words")
    largest, total = words.agg(F.max("id")).first()[0] or 0, totals.agg(F.sum("n")).first()[0] or 0
    width, parts = max(1, math.ceil(int(largest).bit_length() / 8)), max(n_parts(spark), math.ceil(total * (longest - 1) / KEYS))
    ids = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "code", "id")
    dealt = chunks.select("chunk", "codes").groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(_dealt(longest, width, parts), "part int, size int, keys binary, n binary")
    grams = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "size").mapInArrow(_added(width, least), "ids array<int>, f long")
    return words, written(grams, "phrase-counts"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    ``share``: a phrase goes if a longer one has at least that many hundredths of its count.
    """
    words, grams, totals = phrase_counts(docs, least, longest, lang_col, text_col)
    size = F.size("ids")
    known = grams.unionByName(words.select(F.array("id").alias("ids"), "f"))
    longer = grams.where(size > 2).select("f", F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"))
    longer = longer.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = grams.join(longer, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))).select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    exact = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"(({exact['a']} * {exact['a']}) * CAST(1000000 AS DECIMAL(7, 0))) div ({exact['l']} * {exact['r']})").cast("long"))
    best = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # longest words at most
    scored = best.join(spelt, "ids").select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # limited in each task first
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, ws[i : i + m - 1] AS g, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m))
  GROUP BY lang, g
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(g) = 1 GROUP BY lang
), c AS (
  SELECT lang, g, f AS a FROM g WHERE f >= 10 AND len(g) > 1
), cut AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, s, max(a) AS f FROM (SELECT lang, a, unnest([g[1 : 2], g[2 : 3]]) AS s FROM c WHERE len(g) = 3) GROUP BY lang, s
), kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.s = b.g WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
