"""A persisted inverted index: compact postings in blocks, bucketed by token; searches read postings, never texts.

A text is a row of its own in one of the blocks of at most ``block_rows`` texts that are read together.  The postings of a token in a block are one record: how many
they are, the largest term frequency and the shortest text among them, and two byte strings, the places of its texts in the block (two bytes each) and its frequencies
there (one byte each, four if one of them needs more).  A block's ids and lengths are kept once, in the block's record without a token.  Records are dealt by bucket
and block, so a common token is spread over many tasks, sorted by token, and written in one folder a bucket, so a search opens the buckets of its words alone.

A search deals the records of all asked words by block, holds those of some blocks at a time and lets the queries, equal sets of words once, stream past them.  So
no posting is copied for a query: a task adds up scores where the postings are and gives each query's best texts of its blocks.
``blocks`` tells which blocks a query's best texts can be in: a block's bound is the sum of what its largest frequency at its shortest length would score.

Defined cases: null texts and ones without words are among the texts and match nothing, and null ones have no length to average, as for the scan; equal ids are texts of their own; repeated words of a query count once, queries without words find
nothing; equal scores go by id; an empty index finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import text as X
from quillon.functions.vectors import best_rows, rounded
from quillon.holding import held

BUCKETS, BLOCK_ROWS = 64, 2048  # in small blocks most records hold one posting, and their heads outweigh them
HELD_BLOCKS = 8  # blocks of a search that a task holds, on average
MOST_ROWS = 1 << 16  # places in a block have two bytes
SLACK = 1e-9  # of a bound, for sums in another order


def _bucket(token: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(token), buckets).cast("int")


def _records(block_rows: int, id_type: pa.DataType):
    """Posting records of the texts of a task, ``block_rows`` at a time, and one without a token that counts them."""
    schema = pa.schema([("token", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("max_tf", pa.int32()), ("min_dl", pa.int32()), ("docs", pa.int64()), ("texts", pa.int64()), ("length", pa.int64()), ("places", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(id_type)), ("dls", pa.list_(pa.int32()))])

    def packed(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    def run(batches):
        for b in batches:
            for at in range(0, len(b), block_rows):
                ids, lists, row = (b.column(c).slice(at, block_rows) for c in ("id", "t", "row"))
                block, flat = row[0].as_py(), lists.flatten().dictionary_encode()
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                told = [["", block, 0, None, None, len(lists), len(lists) - lists.null_count, int(size.sum()), None, None]]
                whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, pa.array(size.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t.type) for c, t in zip(zip(*told, strict=True), schema, strict=False)), *whole], schema=schema)
                if not len(flat):
                    continue
                # one key a (token, text): sorted, the texts of a token stand together
                keys, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
                token, doc = np.divmod(keys, len(size))
                cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
                n, most = np.diff(cuts), np.maximum.reduceat(tf, cuts[:-1])
                wide = np.repeat(most > 255, n)
                bytes_ = tf.astype("<u4").view(np.uint8).reshape(-1, 4)[np.stack([np.ones_like(wide), wide, wide, wide], axis=1)]
                none, empty = pa.array(np.zeros(len(n), np.int64)), (pa.nulls(len(n), schema.field(c).type) for c in ("ids", "dls"))
                columns = [
                    flat.dictionary.take(pa.array(token[cuts[:-1]])), pa.array(np.full(len(n), block)), pa.array(n), pa.array(most.astype(np.int32)), pa.array(np.minimum.reduceat(size[doc], cuts[:-1]).astype(np.int32)),
                    none, none, none, packed(doc.astype("<u2"), 2 * cuts), packed(bytes_, np.append(0, np.cumsum(np.where(most > 255, 4, 1) * n))), *empty,
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of ``docs`` to a folder that holds none; its statistics are written last and make it one.

    Texts are read and cut into words once, and their records made where they are read; one shuffle brings the records of a bucket together, in as many tasks as there are partitions a bucket.
    """
    if block_rows > MOST_ROWS:
        raise ValueError(f"a block has at most {MOST_ROWS} texts")
    spark = docs.sparkSession
    kind, id_type = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), X.all_tokens(F.col(text_col)).alias("t"), F.monotonically_increasing_id().alias("row"))
    records = rows.mapInArrow(_records(block_rows, id_type), f"token string, block long, n long, max_tf int, min_dl int, docs long, texts long, length long, places binary, tfs binary, ids array<{kind}>, dls array<int>")
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = records.withColumn("bucket", _bucket(F.col("token"), F.lit(buckets)))
    deal = F.pmod(F.xxhash64("block"), F.lit(max(1, parts // buckets)))
    ordered = records.repartition(parts, F.col("bucket"), deal).sortWithinPartitions("bucket", "token", "block")
    ordered.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stats = spark.read.schema(records.schema).parquet(f"{path}/postings").where("token = ''")
    stats = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("docs", "n"), ("texts", "texts"), ("length", "length")))).withColumn("buckets", F.lit(buckets))
    stats.coalesce(1).write.parquet(f"{path}/stats")  # one row


class LexicalIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.stats = spark.read.parquet(f"{path}/stats")
        schema = "token string, block long, n long, max_tf int, min_dl int, docs long, texts long, length long, places binary, tfs binary, ids array<long>, dls array<int>, bucket int"
        empty = self.stats.first().n == 0
        self.postings = spark.createDataFrame([], schema) if empty else spark.read.parquet(f"{path}/postings")
        self.heads = self.postings.select("bucket", "token", "block", "n", "max_tf", "min_dl")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, q) of (query_id, words), and (q, token, bucket, n_words, idf, avgdl) of the words of each distinct set of words that some text holds."""
        sets = queries.select("query_id", F.array_sort(F.array_distinct(F.filter("words", lambda w: w != ""))).alias("w")).where(F.size("w") > 0)
        each = held(sets.select("w").distinct().withColumn("q", F.monotonically_increasing_id()))
        words = each.select("q", F.size("w").alias("n_words"), F.explode("w").alias("token")).crossJoin(F.broadcast(self.stats)).withColumn("bucket", _bucket(F.col("token"), F.col("buckets")))  # one row
        df = self.heads.join(words.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
        n, d = F.col("n").cast("double"), F.col("df").cast("double")
        idf = F.greatest(F.lit(1e-6), F.log((n - d + 0.5) / (d + 0.5)))
        asked = words.join(df, "token").select("q", "token", "bucket", "n_words", idf.alias("idf"), (F.col("length") / F.col("texts")).alias("avgdl"))
        return sets.join(each, "w").select("query_id", "q"), held(asked)

    def _met(self, asked: DataFrame, answer, schema: str) -> DataFrame:
        """What ``answer`` gives for the texts of some blocks and each set of words, for all blocks."""
        told = self.postings.where("token = ''").agg(F.count(F.lit(1)).alias("n")).first().n  # blocks
        n = max(1, -(-told // HELD_BLOCKS))
        found = self.postings.join(asked.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi").unionByName(self.postings.where("token = ''").select("bucket", "token", *(c for c in self.postings.columns if c not in ("bucket", "token"))))
        words, none = "array<struct<token:string,idf:double>>", lambda kind, name: F.lit(None).cast(kind).alias(name)
        kinds = dict(self.postings.dtypes)
        records = found.select(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("part"), F.when(F.col("token") == "", 0).otherwise(1).alias("kind"), "token", "block", "max_tf", "places", "tfs", "ids", "dls", none("long", "q"), none("int", "n_words"), none("double", "avgdl"), none(words, "words"))
        sets = asked.groupBy("q", "n_words", "avgdl").agg(F.collect_list(F.struct("token", "idf")).alias("words"))  # a query's words
        sets = sets.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(2).alias("kind"), *(none(kinds[c], c) for c in ("token", "block", "max_tf", "places", "tfs", "ids", "dls")), "q", "n_words", "avgdl", "words")
        return records.unionByName(sets).repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(_meet(answer), schema)

    def _best(self, asked: DataFrame, k: int, k1: float, b: float, places: int | None) -> DataFrame:
        """(q, row, id, score, rank): the k best texts that hold all words of a set."""
        kind = self.postings.schema["ids"].dataType.elementType
        top = self._met(asked, _best_of(k, k1, b, places, to_arrow_type(kind)), f"q long, row long, id {kind.simpleString()}, score double")
        nth = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
        return top.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)

    def blocks(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, places: int | None = None) -> DataFrame:
        """(query_id, block, bound, live): every block that holds all words of a query, and whether it can hold one of the k best texts."""
        of, asked = self._asked(queries)
        bound = F.sum(_part(F.col("max_tf"), F.col("min_dl"), k1, b)) * (1 + SLACK) + SLACK
        both = self.heads.drop("n").join(asked, ["bucket", "token"]).groupBy("q", "block", "n_words").agg(bound.alias("bound"), F.count(F.lit(1)).alias("held")).where("held = n_words")
        both = both.withColumn("bound", F.col("bound") if places is None else F.round("bound", places) + 10.0**-places)
        least = self._best(asked, k, k1, b, places).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))
        live = ~F.coalesce((F.col("have") >= k) & (F.col("bound") < F.col("least")), F.lit(False))
        return both.join(least, "q", "left").withColumn("live", live).join(of, "q").select("query_id", "block", "bound", "live")

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, places: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k texts of best BM25 score that hold all words of (query_id, words), words as ``all_tokens`` gives them."""
        of, asked = self._asked(queries)
        return self._best(asked, k, k1, b, places).join(of, "q").select("query_id", "id", "score", "rank")

    def matching(self, queries: DataFrame, every: bool = True) -> DataFrame:
        """(query_id, id) of the texts that hold all (or any) words of a query."""
        of, asked = self._asked(queries)
        kind = self.postings.schema["ids"].dataType.elementType
        return self._met(asked, _matches_of(every, to_arrow_type(kind)), f"q long, id {kind.simpleString()}").join(of, "q").select("query_id", "id")

    def counts(self, queries: DataFrame, every: bool = True) -> DataFrame:
        """(query_id, texts): how many texts hold all (or any) words of a query, of those that some text does; counted where the postings are."""
        of, asked = self._asked(queries)
        got = self._met(asked, _counts_of(every), "q long, texts long").groupBy("q").agg(F.sum("texts").alias("texts"))
        return got.join(of, "q").select("query_id", "texts")


class _Texts:
    """The texts of some blocks, in the order of their ids, and the postings of tokens in them."""

    def __init__(self, sides: pa.Table, records: pa.Table):
        self.blocks = sides["block"].to_numpy()
        ids, sizes = sides["ids"].combine_chunks().flatten(), pc.list_value_length(sides["dls"]).to_numpy()
        self.first = dict(zip(self.blocks.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        row = np.repeat(self.blocks - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        order = pc.sort_indices(pa.table({"id": ids, "row": row}), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.ids, self.row, self.dl = ids.take(pa.array(order)), row[order], sides["dls"].combine_chunks().flatten().to_numpy()[order].astype(np.float64)
        self.records, self.of, self.known = records, {}, {}
        for i, token in enumerate(records["token"].to_pylist()):
            self.of.setdefault(token, []).append(i)

    def postings(self, token: str):
        """(positions, frequencies) of a token's texts."""
        if token not in self.known:
            some = self.records.take(pa.array(self.of.get(token, []), pa.int64()))
            at, tf = [np.empty(0, np.int64)], [np.empty(0, np.float64)]
            for block, most, places, tfs in zip(*(some[c].to_pylist() for c in ("block", "max_tf", "places", "tfs")), strict=True):
                at.append(self.at[self.first[block] + np.frombuffer(places, "<u2").astype(np.int64)])
                tf.append(np.frombuffer(tfs, "<u4" if most > 255 else np.uint8).astype(np.float64))
            self.known[token] = np.concatenate(at).astype(np.int32), np.concatenate(tf).astype(np.float32)
        return self.known[token]

    def holding(self, words: list, n_words: int, every: bool) -> np.ndarray:
        """Positions of the texts that hold all, or any, of the words."""
        lists = [self.postings(w["token"])[0] for w in words]
        if every and (len(words) < n_words or not all(map(len, lists))):
            return np.empty(0, np.int64)
        held = np.zeros(len(self.row), np.int32)
        for at in lists:
            held[at] += 1
        return np.flatnonzero(held == n_words if every else held)


def _meet(answer):
    def run(batches):
        sides, records, texts = [], [], None
        kept = {0: (sides, ["block", "ids", "dls"]), 1: (records, ["token", "block", "max_tf", "places", "tfs"])}
        part = None
        for b in batches:
            marks = b.column("part").to_numpy().astype(np.int64) * 3 + b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(b)] if len(b) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                piece, mark = b.slice(a, z - a), marks[a]
                if mark // 3 != part:
                    part, texts = mark // 3, None
                    sides.clear()
                    records.clear()
                if mark % 3 < 2:  # a block's texts come first, then postings, then queries
                    into, names = kept[mark % 3]
                    into.append(piece.select(names))
                    continue
                if not records:
                    continue
                if texts is None:
                    texts = _Texts(pa.Table.from_batches(sides).combine_chunks(), pa.Table.from_batches(records).combine_chunks())
                yield from answer(texts, piece)

    return run


def _best_of(k: int, k1: float, b: float, places: int | None, id_type: pa.DataType):
    def answer(texts: _Texts, asked: pa.RecordBatch):
        out = []
        for q, n_words, avgdl, words in zip(*(asked.column(c).to_pylist() for c in ("q", "n_words", "avgdl", "words")), strict=True):
            at = texts.holding(words, n_words, True)
            if not len(at):
                continue
            total = np.zeros(len(texts.row))
            for w in sorted(words, key=lambda w: w["token"]):
                where, tf = texts.postings(w["token"])
                total[where] += w["idf"] * tf.astype(np.float64) * (k1 + 1) / (tf + k1 * (1 - b + b * texts.dl[where] / avgdl))
            score = total[at] if places is None else rounded(total[at], places)
            best = best_rows(score[:, None], k)[:, 0]  # of equal ones those of least id
            out.append((np.full(best.sum(), q), at[best], score[best]))
        if out:
            q, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(texts.row[at]), texts.ids.take(pa.array(at)).cast(id_type), pa.array(score)], names=["q", "row", "id", "score"])

    return answer


def _matches_of(every: bool, id_type: pa.DataType):
    def answer(texts: _Texts, asked: pa.RecordBatch):
        for q, n_words, words in zip(*(asked.column(c).to_pylist() for c in ("q", "n_words", "words")), strict=True):
            at = texts.holding(words, n_words, every)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q), pa.int64()), texts.ids.take(pa.array(at)).cast(id_type)], names=["q", "id"])

    return answer


def _counts_of(every: bool):
    def answer(texts: _Texts, asked: pa.RecordBatch):
        rows = zip(*(asked.column(c).to_pylist() for c in ("q", "n_words", "words")), strict=True)
        n = [(q, len(texts.holding(words, n_words, every))) for q, n_words, words in rows]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, m in n if m], pa.int64()), pa.array([m for _, m in n if m], pa.int64())], names=["q", "texts"])

    return answer


def _part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
