r"""Conversation prefix trie, built level by level.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.  Equal conversations are told apart from others
by length and 128 hash bits first and stand for one class from then on (its least conv_id and its size), so copies meet in one row.  Per level the
live classes are grouped by (parent node, next turn); the least conv_id of the group names the node at that depth.  A class that is alone in its
group leaves: the rest of its turns is a chain without branches, known at once.  A level is one turn; as long as no group splits or ends, the
stride doubles, so long common runs cost few steps, and a stride that meets a split is done again turn by turn.
Turns are equal by two 64-bit hashes of their SHA-256 and their place.

Then levels are joined in reverse: each node sums leaves and savings of its children.  A chain's nodes are spread over its turns at the end.

Each level is a table written to the shared folder.  Rows are numbered by range partition, so a conversation with a third of all turns is no single
task; groups are aggregated before they are shuffled and meet their rows by a join that adaptive execution splits where one turn is hot.
The list of conversations that end at a node is hashed as a stream: sorted pieces are made by range, then one task appends the pieces of a node.

Defined cases: turns are ordered by (turn, null first; role; text); null role or text counts as empty.  Rows with a null conv_id are
no conversation.  Repeated rows are turns of their own.  Very long texts count whole.  A conversation without turns is a member of the root alone.  An
empty table has no root and gives no rows.  ``conv_id`` is an integer; ``c - c % 5`` takes the remainder as SQL does (of the sign of c).
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import picked, table, written
from quillon.operators.ordering import running_sums

NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos from 0, digest of role and text, bytes of the text), one row a turn."""
    rows = picked(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    rows = rows.withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce("text", F.lit("")), "conv_id": F.col("conv_id").cast("long")})
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    at = written(running_sums(rows, order, nth=F.lit(1)).select("conv_id", "nth", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "trie-turns")
    first = at.groupBy("conv_id").agg(F.min("nth").alias("first"))
    return at.join(first, "conv_id").select("conv_id", (F.col("nth") - F.col("first")).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns after each conversation c has taken over the first h turns of c - c % group, h = crc32(c) % most, for its own first h.

    (conv_id) of all, turnless ones too, and (conv_id, pos, digest, bytes).
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    kept = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = written(convs.join(kept, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-convs")
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    taken = convs.where("given > 0").select("conv_id", "base", "given").join(heads, "base").where("pos < given").select("conv_id", "pos", "digest", "bytes")
    own = turns.join(convs.select("conv_id", "h", "given"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "bytes")
    return convs.select("conv_id"), taken.unionByName(own)


def _joined(batches):
    """(node, first, ids): runs of ids of one node in a batch, comma-joined; rows come sorted."""
    for b in batches:
        nodes, ids = b.column("node").to_pylist(), b.column("conv_id").to_pylist()
        at, out = 0, []
        for k in range(1, len(nodes) + 1):
            if k == len(nodes) or nodes[k] != nodes[at]:
                out.append((nodes[at], ids[at], ",".join(map(str, ids[at:k]))))
                at = k
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])


def _hashed(batches):
    """(node, ends_sha256) of pieces in order; one open hash at a time."""
    node = state = None
    for b in batches:
        out = []
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        cols = list(zip(*out, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string()), strict=True)], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def list_hashes(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of each node's ascending, comma-joined ids."""
    pieces = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node long, ends_sha256 string")


def _classes(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, n, len, total) of each distinct conversation, and (node, conv_id) of all conversations by class."""
    of = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("total"))
    zero = F.lit(0).cast("long")
    of = written(convs.join(of, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("len", "a", "b", "total"))), "trie-whole")
    classes = of.groupBy("len", "a", "b").agg(F.min("conv_id").alias("class"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    classes = written(classes, "trie-classes")
    several = classes.where("n > 1").select("len", "a", "b", F.col("class").alias("node"))
    members = of.join(several, ["len", "a", "b"]).select("node", "conv_id").unionByName(classes.where("n = 1").select(F.col("class").alias("node"), F.col("class").alias("conv_id")))
    return classes.select("class", "n", "len", "total"), members


def _step(live: DataFrame, rows: DataFrame, depth: int, stride: int) -> DataFrame:
    """Live classes grouped by (node, their next ``stride`` turns): a row a class with its new node and that node's numbers."""
    ahead = rows.where((F.col("pos") >= depth) & (F.col("pos") < depth + stride)).withColumnRenamed("conv_id", "class")
    if stride > 1:
        ahead = ahead.groupBy("class").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("run"))
    else:
        ahead = ahead.select("class", "a", "b", "bytes", F.lit(1).cast("long").alias("run"))
    nexts = live.join(ahead, "class")
    key = ["node", "a", "b", "run"]
    groups = nexts.groupBy(*key).agg(F.min("class").alias("child"), F.sum("n").alias("n_convs"), F.count_if(F.col("len") > depth + stride).alias("going"))
    both = nexts.join(groups, key)
    return both.select("class", "n", "len", "total", (F.col("done") + F.col("bytes")).alias("done"), F.col("node").alias("parent"), F.col("child").alias("node"), "n_convs", "going", "bytes", "run")


def _levels(classes: DataFrame, rows: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """(depth before, depth after, table) of each step, from the root's."""
    root, n = classes.agg(F.min("class"), F.sum("n")).first()
    if root is None:
        return []
    zero = F.lit(0).cast("long")
    going = classes.agg(F.count_if(F.col("len") > 0)).first()[0]
    start = classes.select("class", "n", "len", "total", zero.alias("done"), F.lit(None).cast("long").alias("parent"), F.lit(root).alias("node"), F.lit(n).alias("n_convs"), F.lit(going).alias("going"), zero.alias("bytes"), zero.alias("run"))
    steps, depth, stride = [(0, 0, start)], 0, 1
    n_live, parents = (going, 1) if going > 1 else (0, 0)
    while n_live:
        live = steps[-1][2].where((F.col("going") > 1) & (F.col("len") > depth)).select("class", "n", "len", "total", "done", "node")
        step = written(_step(live, rows, depth, stride), f"trie-level{depth}")
        alone = F.col("class") == F.col("node")
        stays = (F.col("going") > 1) & (F.col("len") > depth + stride)
        nodes, short, n_live, parents_next = step.agg(F.count_if(alone), F.count_if(F.col("run") < stride), F.count_if(stays), F.count_if(alone & (F.col("going") > 1))).first()
        if stride > 1 and (nodes > parents or short):
            n_live, stride = 1, 1  # a group splits or ends on the way: turn by turn
            continue
        steps.append((depth, depth + stride, step))
        depth += stride
        stride = 2 * stride if nodes == parents == parents_next else 1
        parents = parents_next
    return steps


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    ``convs`` has the ids (conv_id) of all conversations, ``turns`` their rows (conv_id, pos from 0, digest, bytes).
    """
    hashed = (F.xxhash64(F.lit(k), "pos", "digest").alias(c) for k, c in enumerate("ab"))
    rows = written(turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "bytes", *hashed), "trie-rows")
    classes, members = _classes(convs, rows)
    steps = _levels(classes, rows)
    if not steps:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    saved = F.col("n") - 1
    rolled, tails, ends, below = [], [], [], None
    for came, depth, step in reversed(steps):
        last = step.where((F.col("going") == 1) & (F.col("len") > depth))
        tails.append(last.select(F.col("class").alias("conv_id"), F.lit(depth).cast("long").alias("since"), F.col("len").alias("to"), F.col("node").alias("top"), F.col("n").alias("n_convs")))
        ends.append(step.where(F.col("len") == depth).select(F.col("class").alias("end"), F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth")))
        ends.append(last.select(F.col("class").alias("end"), F.col("class").alias("conv_id"), F.col("len").alias("depth")))
        child = last.select("node", F.lit(1).cast("long").alias("leaves"), (saved * (F.col("total") - F.col("done"))).alias("saved"))
        if below is not None:
            child = child.unionByName(below.select(F.col("parent").alias("node"), F.col("n_leaves").alias("leaves"), (F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
        sums = child.groupBy("node").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        first = step.where(F.col("class") == F.col("node")).select("node", "parent", "n_convs", "bytes")
        node = first.join(sums, "node", "left").select("node", "parent", "n_convs", "bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("below", F.lit(0)).alias("below"))
        below = written(node, f"trie-up{depth}")
        rolled.append((came, depth, below))
    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else []))  # noqa: E731  # a shallow tree
    known = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    single = [
        t.select(F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
        for came, d, t in rolled
        if d - came < 2
    ]
    zero = F.lit(0).cast("long")
    runs = union(tails).select("*", zero.alias("bottom"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("below"))
    for came, d, t in rolled:
        if d - came > 1:
            runs = runs.unionByName(t.select(F.col("node").alias("conv_id"), F.lit(came).cast("long").alias("since"), F.lit(d).cast("long").alias("to"), F.col("parent").alias("top"), "n_convs", F.col("n_children").alias("bottom"), "n_leaves", "below"))
    at = rows.join(runs, "conv_id").where("pos >= since AND pos < to")
    chain = at.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("since"), F.col("top")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("pos") + 1 == F.col("to"), F.col("bottom")).otherwise(1).alias("n_children"), "n_leaves", "below", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), "since", "to",
    )
    plain = chain.where("n_convs = 1").select(*known[:-1], F.col("below").alias("saved_tokens"))
    # below a turn of a chain: what its later turns save, by sums numbered by range as a chain may be very long
    more = written(running_sums(chain.where("n_convs > 1"), [F.col("conv_id"), F.col("since"), F.desc("depth")], upto=F.col("own")), "trie-chains")
    start = more.where(F.col("depth") == F.col("to")).select("conv_id", "since", (F.col("upto") - F.col("own")).alias("before"))
    summed = more.join(start, ["conv_id", "since"]).select(*known[:-1], (F.col("below") + F.col("upto") - F.col("before")).alias("saved_tokens"))
    hashes = list_hashes(members).withColumnRenamed("node", "end")
    ended = union(ends).join(hashes, "end").select("conv_id", "depth", "ends_sha256")
    nodes = union([*single, plain, summed])
    return nodes.join(ended, ["conv_id", "depth"], "left").select(*known, F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = rebuilt(turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie(convs, turns)


#: CRC-32 bit by bit, as DuckDB has no function of that name.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda x, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(x, b)), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT t.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)) AS pos, said FROM t JOIN c ON c.conv_id = t.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos >= c.h
  UNION ALL SELECT c.conv_id, t.pos, said FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
), s AS (
  SELECT c.conv_id, list(r.said ORDER BY r.pos) FILTER (WHERE r.conv_id IS NOT NULL) AS seq, count(r.conv_id) AS n FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, n, depth, coalesce(seq[1 : depth], []) AS node FROM (SELECT *, unnest(range(0, n + 1)) AS depth FROM s)
), nd AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, node
), up AS (
  SELECT ch.*, pa.conv_id AS parent_conv_id FROM nd ch LEFT JOIN nd pa ON pa.depth = ch.depth - 1 AND pa.node = ch.node[1 : ch.depth - 1]
), k AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT up.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN up.depth > 0 THEN (n_convs - 1) * strlen(node[up.depth].text) ELSE 0 END AS saved FROM up LEFT JOIN k ON k.depth = up.depth AND k.conv_id = up.conv_id
), below AS (
  SELECT d AS depth, node[1 : d] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY d, node[1 : d]
)
SELECT o.conv_id, o.depth, o.parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens, o.ends_sha256 FROM own o JOIN below b ON b.depth = o.depth AND b.node = o.node
"""
