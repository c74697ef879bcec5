r"""Personal data with offset-preserving deobfuscation.

Base spans come from the texts as they are: e-mail addresses, dotted-quad
addresses, card numbers (12-19 digits, Luhn) and phone numbers (9-15 digits).  Then a
chain of transducers normalises the text while keeping, for every character made,
the source interval it came from: homoglyphs and full-width forms to ASCII, invisible characters to
nothing, runs of spelled digits to digits, and disguises of "@" and "." ("[at]", "(dot)", "{punkt}", the bare
words where both occur in one address, and bare dots between digits or beside the labels of an address) to
the signs.  The same detectors run on the normalised text, and their spans are mapped back to source characters.
A spelled digit may also be an ordinary word beside a number and spoil it ("un", "one"), so a text is read once for
each way in ``_WAYS`` to take its spelled digits, and spans of all readings count, of one kind the widest.
Base spans always stay; a mapped span is added unless a base span of its own kind holds it whole, so
one that reaches further than the piece the base detectors see is kept beside it.

Detectors never backtrack over a run twice, so long runs and very long texts cost linear time; no part of an address has a bound.

Defined cases: null text counts as empty (no spans, digest of no bytes); matches that fail
the number checks are dropped without a second try; of spans that start at one place the kinds come in their order; repeated rows are judged
one by one; empty tables give no rows; other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm.common import numbered, picked, position, table

KINDS = ("email", "ip", "card", "phone")
LONG_RUN = 4
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGITS = frozenset("0123456789")

# Look-alike letters of other scripts and the ASCII letter each stands for.
_LOOKS = dict(zip("аеіјоѕԁһӏорсухАВЕІЈКМНОРСТХУαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeijosdhlopcyxABEIJKMHOPCTXYaeiknoptuxABEZHIKMNOPTYX", strict=True))
_LOOKS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"。": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "−": "-", "﹣": "-"}
_LOOKS |= {chr(0x0660 + k): str(k) for k in range(10)} | {chr(0x06F0 + k): str(k) for k in range(10)}
_HIDDEN = dict.fromkeys("​‌‍⁠﻿­", "")
_LOOKS |= _HIDDEN
_LOOK_RUN = re.compile("[" + re.escape("".join(_LOOKS)) + "]")
# Spelled digits of the four languages of the test tables, and English "oh".
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ONE = "|".join(sorted(_SPELLED, key=len, reverse=True))
# What else a letter of these words matches without regard to case: long s, dotless and dotted i.
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})
_WORD_DOT = "dot|punkt|punto|point"
# A spelled digit with only signs of a number or an address between it and another digit: any other is in no number.
_GAP = rf"(?:[\x20().\[\]{{}}<>-]|{_WORD_DOT})*+"
_SPELLED_HINT = re.compile(rf"(?i)(?<!\w)(?:{_ONE})(?!\w){_GAP}(?:[0-9]|(?<!\w)(?:{_ONE})(?!\w))|[0-9+]{_GAP}(?<!\w)(?:{_ONE})(?!\w)")


def _runs(words: str, least: int) -> re.Pattern:
    return re.compile(rf"(?i)(?<!\w)(?:{words})(?!\w)(?:[\x20-](?:{words})(?!\w)){{{least - 1},}}+")


_NO_ARTICLE = "|".join(w for w in _ONE.split("|") if w != "un")
# Ways to take spelled digits: any run, only long ones, and both without the French article; the last is none at all.
_WAYS = [_runs(words, least) for words in (_ONE, _NO_ARTICLE) for least in (1, LONG_RUN)]
_SPELLED_ONE = re.compile(rf"(?i){_ONE}")
_AT = r"\x20?[\[({<]\x20?(?:at|arroba|arobase|ät)\x20?[\])}>]\x20?"
_DOT = r"\x20?[\[({<]\x20?(?:dot|punkt|punto|point)\x20?[\])}>]\x20?"
_SIGN_HINT = re.compile(r"(?i)[\[({<]\x20?(?:at|arroba|arobase|ät|dot|punkt|punto|point)\x20?[\])}>]|\x20(?:dot|punkt|punto|point)\x20")
_BRACKET_AT, _BRACKET_DOT = re.compile(f"(?i){_AT}"), re.compile(f"(?i){_DOT}")
_BARE = re.compile(r"(?i)(?<![\w.%+-])[A-Z0-9._%+-]++(\x20(?:at|arroba)\x20)[A-Z0-9-]++(?:\x20(?:dot|punkt|punto|point)\x20[A-Z0-9-]{2,}+)+(?![\w-])")
_BARE_DOT = re.compile(r"(?i)\x20(?:dot|punkt|punto|point)\x20")
_TO_AT, _LABELS, _LABEL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\Z"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*"), re.compile(r"[A-Za-z0-9-]{2}")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local@domain, found from each "@"."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at, floor = text.find("@", at + 1), at + 1


def detect(text: str) -> list[tuple[int, int, str]]:
    """Base spans (start, kind index, end) of a text, sorted by start, then kind."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class Mapped:
    """A text made from another by replacements, with the way back to source characters."""

    def __init__(self, text: str):
        self.text, self.maps = text, []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the disjoint, ascending (start, end, new) of the current text."""
        out, at, made = [], 0, 0
        new_starts, new_ends, olds = [0], [0], [(0, 0, False)]
        for s, e, new in edits:
            out += [self.text[at:s], new]
            made += s - at
            new_starts.append(made)
            new_ends.append(made + len(new))
            olds.append((s, e, True))
            made += len(new)
            at = e
        out.append(self.text[at:])
        if edits:
            self.text = "".join(out)
            self.maps.append((new_starts, new_ends, olds))

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source interval of the current text's [start, end)."""
        for new_starts, new_ends, olds in reversed(self.maps):
            start = self._one(start, new_starts, new_ends, olds, False)
            end = self._one(end - 1, new_starts, new_ends, olds, True)
        return start, end

    @staticmethod
    def _one(at: int, new_starts, new_ends, olds, last: bool) -> int:
        k = bisect_right(new_starts, at) - 1
        while k > 0 and new_starts[k] == new_ends[k] and new_starts[k] > at:
            k -= 1
        if at < new_ends[k]:  # within what an edit made
            return olds[k][1] if last else olds[k][0]
        return olds[k][1] + at - new_ends[k] + last


def _spelled(text: str) -> list[list[tuple[int, int, str]]]:
    """The edits of each way to take the spelled digits of a text; the last has none."""
    ways = []
    if _SPELLED_HINT.search(text):
        for run in _WAYS:
            edits = [(x.start(), x.end(), "".join(_SPELLED[w[0].translate(_FOLD).lower()] for w in _SPELLED_ONE.finditer(x[0]))) for x in run.finditer(text)]
            if edits and edits not in ways:
                ways.append(edits)
    return [*ways, []]


def _bare_dots(text: str) -> list[tuple[int, int, str]]:
    """Bare dot words between digits, or between labels of an address that has its "@"."""
    found = [d.span() for d in _BARE_DOT.finditer(text)]
    good, at, domain = set(), 0, False
    for s, e in found:
        digits = text[s - 1 : s] in _DIGITS and text[e : e + 1] in _DIGITS
        domain = bool(_LABEL.match(text, e) and (domain and _LABELS.fullmatch(text, at, s) or _TO_AT.search(text, at, s)))
        at = e
        if digits or domain:
            good.add((s, e))
    at = -1  # start of the next dot of a local part
    for s, e in reversed(found):
        if text[s - 1 : s] in _LOCAL and (m := _LOCAL_RUN.match(text, e)) and (m.end() == at or text[m.end() : m.end() + 1] == "@"):
            good.add((s, e))
            at = s
    return [(s, e, ".") for s, e in found if (s, e) in good]


def _signed(m: Mapped) -> None:
    """Disguises of "@" and "." become the signs."""
    if not _SIGN_HINT.search(m.text):
        return
    signs = [(x.start(), x.end(), "@") for x in _BRACKET_AT.finditer(m.text)] + [(x.start(), x.end(), ".") for x in _BRACKET_DOT.finditer(m.text)]
    for x in _BARE.finditer(m.text):
        signs.append((x.start(1), x.end(1), "@"))
        signs += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(m.text, x.end(1), x.end())]
    signs.sort()
    kept, at = [], 0
    for s in signs:
        if s[0] >= at:
            kept.append(s)
            at = s[1]
    m.apply(kept)
    m.apply(_bare_dots(m.text))


def readings(text: str) -> list[Mapped]:
    """The text through all transducers, once for each way to take its spelled digits, where they change it."""
    looks = [] if text.isascii() else [(x.start(), x.end(), _LOOKS[x[0]]) for x in _LOOK_RUN.finditer(text)]
    plain = Mapped(text)
    plain.apply(looks)
    out = []
    for edits in _spelled(plain.text):
        m = Mapped(plain.text)
        m.maps = list(plain.maps)
        m.apply(edits)
        _signed(m)
        if m.maps:
            out.append(m)
    return out


def find(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of a text as (start, kind index, end), each sorted."""
    if not text:
        return [], []
    base = detect(text)
    mapped = [(*m.back(s, e), kind) for m in readings(text) for s, kind, e in detect(m.text)]
    return base, sorted({*base, *beyond(base, mapped)}) if mapped else base


def beyond(base: list[tuple[int, int, int]], mapped: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The mapped (start, end, kind) that no base span and no wider mapped one of their kind holds whole, as (start, kind, end)."""
    out, reach = [], [0] * len(KINDS)
    for s, e, kind, known in sorted([*((s, e, k, True) for s, k, e in base), *((*x, False) for x in mapped)], key=lambda x: (x[0], -x[1], not x[3])):
        if e > reach[kind]:
            reach[kind] = e
            if not known:
                out.append((s, kind, e))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row; counts are of base spans."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for t in b.column("text"):
                base, every = find(t.as_py())
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str | None) -> str | None:
    """Every found span replaced by its kind in brackets; overlapping spans become one.

    What is left is searched again, as a number that was cut short may now stand alone.
    """
    while spans := find(text)[1]:
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        out.append(text[at:])
        text = "".join(out)
    return text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; null texts stay null, other columns are kept."""
    index = position(docs, text_col)
    rows = numbered(docs)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[index] = pa.array([redact_text(t.as_py()) for t in cols[index]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields)).toDF(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
