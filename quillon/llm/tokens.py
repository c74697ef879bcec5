r"""Token counts by heap-and-linked-list byte-pair merging.

A text is turned into symbols (one a character, as many as its UTF-8 bytes for a
character outside the vocabulary), linked in a list; a heap holds the adjacent
pairs whose concatenation is a piece.  The pair of lowest rank, leftmost first, is
popped and merged until none is left.  The count is initial symbols minus merges;
no identifiers are made.

The piece model adds one space in front, treats U+2581 as a space and merges nothing across
a character followed by a space, because no piece holds one: so a text is counted by
space-delimited chunks, whose counts are remembered (two generations of at most ``CACHE`` short chunks in a worker).
A model with pieces that break this rule is counted text by text.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
one by one, in any order and with ids of any type; very long texts are whole; an empty table gives no rows; other columns are ignored, whatever their names.  The model file is a
parameter and must exist on every executor.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import picked, table, text_bytes

CACHE = 600_000
LIMIT = 4096
SPACE = "▁"
_KNOWN: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the tokens of a byte-fallback piece model (BPE, identity normaliser, dummy prefix)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)  # its vocabulary only
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i).replace(SPACE, " "): i for i in ids}
        # rank: order of descending score, so that a smaller rank merges first
        order = sorted(ids, key=lambda i: -sp.get_score(i))
        rank_of_id = {i: r for r, i in enumerate(order)}
        self.rank = {p: rank_of_id[i] for p, i in pieces.items()}
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.by_chunk = all(" " not in p.lstrip(" ") for p in pieces)
        self.chunks: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merge(self, symbols: str) -> int:
        """Tokens of a run of characters: initial symbols minus merges."""
        rank, n = self.rank, len(symbols)
        total = sum(1 if c in rank else len(c.encode()) for c in symbols)
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue  # one of its symbols has been merged meanwhile
            part[i] = both = left + part[j]
            part[j] = None
            total -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(both + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both) + len(part[k])))
            if (h := before[i]) >= 0 and (r := rank.get(part[h] + both)) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(both)))
        return total

    def chunk(self, text: str) -> int:
        """Tokens of a chunk, cut where two characters stand side by side in no piece."""
        if (got := self._recall(text)) is not None:
            return got
        pairs, at, total = self.pairs, 0, 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in pairs:
                total += self._run(text[at:k])
                at = k
        total += self._run(text[at:])
        self._remember(text, total)
        return total

    def _run(self, text: str) -> int:
        if len(text) == 1:
            return 1 if text in self.rank else len(text.encode())
        if (got := self._recall(text)) is None:
            got = self.merge(text)
            self._remember(text, got)
        return got

    def _recall(self, text: str) -> int | None:
        if (got := self.chunks.get(text)) is None and (got := self.older.get(text)) is not None:
            self._remember(text, got)
        return got

    def _remember(self, text: str, n: int) -> None:
        if len(text) <= 64:
            if len(self.chunks) >= CACHE:
                self.older, self.chunks = self.chunks, {}
            self.chunks[text] = n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        if not self.by_chunk:
            return self.merge(text)
        if "  " in text or text[-1] == " ":
            return sum(map(self.chunk, re.findall(" *[^ ]+| +", text)))
        total = 0
        for word in text[1:].split(" "):
            got = self.chunks.get(" " + word)
            total += self.chunk(" " + word) if got is None else got
        return total


def counter(model_file: str) -> PieceCounter:
    if model_file not in _KNOWN:
        _KNOWN[model_file] = PieceCounter(model_file)
    return _KNOWN[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text."""
    rows = picked(docs, doc_id=id_col, text=text_col)

    def run(batches):
        count = counter(model_file).count
        for b in batches:
            texts = b.column("text")
            _, offsets = text_bytes(texts)
            n = np.fromiter((count(t) if t else 0 for t in (x.as_py() for x in texts)), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
