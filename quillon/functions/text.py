"""Text expressions: built-in columns where Spark has the semantics, Arrow UDFs where it has not."""

from __future__ import annotations

import json
import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def ws_collapse(text) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def ascii_fold(text) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def like_contains(text, needle: str) -> Column:
    """``LIKE '%needle%'`` with ASCII-only case folding; % and _ of the needle stay wildcards."""
    folded = needle.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)).replace("\\", "\\\\")
    return ascii_fold(text).like(f"%{folded}%")


@F.arrow_udf(T.StringType())
def nfkc_casefold(values: pa.Array) -> pa.Array:
    """NFKC, case folding, white space collapsed: Spark has no NFKC."""
    return pa.array([None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """The compatibility form of Unicode, which Spark lacks."""
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def normalised_contains(text, keyword: str) -> Column:
    folded = " ".join(unicodedata.normalize("NFKC", keyword).casefold().split())
    return nfkc_casefold(text).contains(folded)


def sha256(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def non_space_count(text) -> Column:
    return F.length(F.regexp_replace(text, WHITESPACE, ""))


def bounded(text, limit: int) -> Column:
    """The whole text, or null where it is longer: never a prefix."""
    return F.when(F.length(text) <= limit, text)


def tokens(text) -> Column:
    """Distinct search forms of the runs of letters and digits."""
    return F.array_distinct(all_tokens(text))


def _accented() -> dict[str, str]:
    """Letters that decompose to an ASCII letter and combining marks, and that letter."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            found[c] = base
    return found


_ACCENTED = _accented()
MARKS = "[\u0300-\u0331]"


def unaccented(text) -> Column:
    """Latin letters without their diacritics, as full-text search folds them; combining marks go."""
    return F.regexp_replace(F.translate(text, "".join(_ACCENTED), "".join(_ACCENTED.values())), MARKS, "")


def fold_word(word: str) -> str:
    """The search form of a word of a query: as ``all_tokens`` folds texts."""
    return "".join(_ACCENTED.get(c, c) for c in word if not "\u0300" <= c <= "\u0331").lower()


def all_tokens(text) -> Column:
    """Runs of letters and digits, lower-cased and without diacritics."""
    return F.filter(F.split(F.lower(unaccented(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stable_rank(seed: str, *parts) -> Column:
    """Sort key of a reproducible sample: SHA-256 of the seed and parts joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def hash_fraction(text) -> Column:
    """The first 32 hash bits as a fraction of [0, 1]."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def version_key(version) -> Column:
    """Sort key of a version: digit runs compare as numbers, other runs as text."""
    runs = F.regexp_extract_all(version, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d+$"), r.cast("decimal(38,0)")).alias("number"), F.when(~r.rlike(r"^\d+$"), r).alias("word")))


def retry_delay(attempt, base: float, cap: float) -> Column:
    """base * 2^(attempt-1) seconds, at most cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def source_date(text) -> Column:
    """A date written with dots, dashes, slashes or plain digits; null if none."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd")])


def canonical_date(text) -> Column:
    """The date of an exact YYYY-MM-DD text, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def format_query(question, instruction: str) -> Column:
    """The query side of an instruction-tuned embedding; documents are embedded as they are."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), question)


def canonical_json(value) -> str:
    """JSON with sorted keys, no blanks, no NaN, text as UTF-8: the form that is hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_object(**fields: Column) -> Column:
    """Canonical JSON of string-valued fields, built from expressions; null fields become null."""
    quoted = lambda c: F.coalesce(F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}":'), quoted(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def identity(prefix: str, **fields: Column) -> Column:
    """Content-derived id: prefix and SHA-256 of the canonical object."""
    return F.concat(F.lit(f"{prefix}_"), sha256(canonical_object(**fields)))


# Numbers with a unit, as facts; fixed values of the domain.
FACT_UNITS = ("만원", "천원", "원", "%", "퍼센트", "포인트", "마일", "회", "개월", "년", "일", "건", "배")
FACT = rf"(?<![0-9A-Za-z.,])(?:\d{{1,3}}(?:,\d{{3}})+|\d+(?:\.\d+)?)\s*(?:{'|'.join(FACT_UNITS)})(?![0-9A-Za-z])"


def numeric_facts(text, limit: int = 8) -> Column:
    """The first distinct numbers with units of a text, blanks removed."""
    found = F.regexp_extract_all(text, F.lit(FACT), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s", ""))), 1, limit)


#: What ends a line in Unicode; a carriage return and line feed together are one end.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_pieces(text, ends: str = "\n") -> Column:
    """The lines of a text with their ends."""
    body = f"[^{ends}]"
    if "\r" in ends:
        body = rf"(?:[ -~]+|[\u2030-\uffff]+|{body})"  # the first two save most characters the longer test
    pattern = f"{body}*+(?:\r\n|[{ends}])|{body}++"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_lines(text, ends: str = "\n") -> Column:
    """Array of (line, start, end): lines with their ends, offsets in code points; ``python_lines`` is the same with all ``LINE_ENDS``."""
    pieces = line_pieces(text, ends)
    empty = F.array().cast("array<struct<line:string,start:int,end:int>>")
    return F.aggregate(
        pieces,
        F.struct(empty.alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.array(F.struct(p.alias("line"), acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).alias("out"), (acc["at"] + F.length(p)).alias("at")),
        lambda acc: acc["out"],
    )


def without_line_end(line) -> Column:
    n = F.length(line)
    return F.when(F.endswith(line, F.lit("\r\n")), F.left(line, n - 2)).when(F.right(line, F.lit(1)).isin(*LINE_ENDS), F.left(line, n - 1)).otherwise(line)


_LINES = pa.list_(pa.struct([("line", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def python_lines(values: pa.Array) -> pa.Array:
    """Lines with offsets at every line boundary of Unicode (form feeds, U+2028 and the like too)."""
    out = []
    for v in values.to_pylist():
        rows, at = [], 0
        for line in (v or "").splitlines(keepends=True):
            rows.append({"line": line, "start": at, "end": at + len(line)})
            at += len(line)
        out.append(rows)
    return pa.array(out, _LINES)


def chunk_offsets(text: str, size: int = 1600, overlap: int = 160) -> list[tuple[int, int]]:
    """Overlapping windows that prefer to end at a line or word end past their middle; trimmed, blanks left out."""
    found, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            cut = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            if cut > at + size // 2:
                end = cut
        piece = text[at:end]
        left, right = at + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))
        if left < right:
            found.append((left, right))
        if end >= n:
            break
        at = max(at + 1, end - overlap)
    return found


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def chunks(values: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"start": s, "end": e} for s, e in chunk_offsets(v or "")] for v in values.to_pylist()], kind)


def percent_4dp(part, whole) -> Column:
    """part of whole in percent, rounded half up at 4 decimals; null if there is nothing."""
    return F.when(whole > 0, F.round(part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") / whole.cast("decimal(20,0)"), 4).cast("double"))


def stays_close(a, b) -> Column:
    """Equality of scores: relative 1e-9 or absolute 1e-7."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-7), F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)))


def log2(x: float) -> float:
    return math.log2(x)
