"""Prefix trie, phrase mining and toxicity against brute force, on the smallest tables and on small cases."""

import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon import llm
from quillon.llm import collocations, prefix_trie, toxicity

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


# conversations


def brute_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        kids[k[:-1]] += bool(k)
    for k, m in members.items():
        own_saved = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def by_depth(found):
    return sorted(map(tuple, found), key=lambda r: (r[1], r[0]))


@needs_tables
def test_op11(spark):
    want = brute_trie(rows(spark, "conversations", "conv_id", "turn", "role", "text"))
    assert by_depth(llm.QUERIES["op11_prefix_trie"](spark, SF).collect()) == want and any(r[3] > 1 and r[1] > 1 for r in want)


TURNS = "conv_id int, turn long, role string, text string, bytes string, digest int, n long, Role_ string"


def trie_of(spark, turns, parts=5):
    df = spark.createDataFrame([(*t, "x", 1, 2, "y") for t in turns], TURNS).repartition(parts)
    return by_depth(prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df))).collect())


def test_trie_cases(spark):
    """Nulls, ties, repeated rows, copies, turnless and missing bases, long texts."""
    rng = random.Random(3)
    turns = [(None, 1, "user", "a"), (3, None, None, None), (3, 1, "user", None), (3, 1, "user", None), (3, 1, "bot", "é" * 50_000), (8, 0, "user", "x"), (1007, 0, "u", "v")]
    for c in range(10, 60):  # short alphabets, so prefixes meet and part at any depth
        turns += [(c, t, rng.choice("ab"), rng.choice("xyé")) for t in range(rng.randint(1, 5))]
    turns += [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(12)]
    want = brute_trie(turns)
    assert any(r[1] == 0 and r[7] != prefix_trie.NONE for r in want)  # a turnless conversation ends at the root
    assert trie_of(spark, turns) == want == trie_of(spark, turns, 1)


def test_trie_long_runs(spark):
    """Long common runs that end, part late or are copies: the stride doubles and is taken back."""
    turns = []
    for c, n, last in ((15, 40, "p"), (20, 40, "q"), (25, 40, "q"), (30, 23, "p"), (35, 40, "p")):
        turns += [(c, t, "user", "same" if t < n - 1 else last) for t in range(n)]
    assert trie_of(spark, turns) == brute_trie(turns)


def test_trie_empty(spark):
    assert trie_of(spark, []) == [] == trie_of(spark, [(None, 1, "user", "a")])
    assert trie_of(spark, [(-3, 1, "user", "a")])[0][:4] == (-3, 0, None, 1)


# phrases


def brute_phrases(docs, least, longest, share=50, top=2000):
    counts = defaultdict(Counter)
    for lang, text in docs:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        many = {k: v for k, v in f.items() if v >= least and len(k) > 1}
        found = []
        for k, a in many.items():
            if any(len(o) > len(k) and 100 * b >= share * a and any(o[i : i + len(k)] == k for i in range(len(o) - len(k) + 1)) for o, b in many.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@needs_tables
def test_op12(spark):
    assert sorted(map(tuple, llm.QUERIES["op12_collocations"](spark, SF).collect())) == brute_phrases(rows(spark, "documents", "lang", "text"), 10, 3)


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(3, 3, 50, 2000), (2, 4, 80, 7), (2, 2, 50, 50)])
def test_phrase_cases(spark, least, longest, share, top):
    """Nulls, empty, long and repeated texts, odd separators and signs, ties, other columns of clashing names."""
    rng = random.Random(least)
    words = ["the", "The", "of", "Éa", "\x01x", "b\x02", "b", "a b", "日本", "x" * 40]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(n))
    docs = [(None, None), ("en", None), ("en", ""), ("en", " .,\n "), ("und", "the of the"), (None, "the of the"), (None, "the of the"), ("de", say(4000))]
    docs += [(rng.choice(["en", "en", "de", None]), say(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(a, b, 1, "w", [1], 2) for a, b in docs], "lang string, text string, n int, word string, ids array<int>, chunk int").repartition(6)
    assert sorted(map(tuple, collocations.collocations(df, least, longest, share, top).collect())) == brute_phrases(docs, least, longest, share, top)


def test_phrases_empty(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == [] == collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect()


def test_chunk_memory():
    """A chunk is coded in some 16 bytes for a byte of its text; tables of numbers for every byte took 28."""
    text = " ".join(f"w{i * i % 5003}{'.' if i % 9 == 0 else ''}" for i in range(100_000))
    langs, texts = pa.array(["en"]), pa.array([text])
    collocations.encoded(langs, texts)
    tracemalloc.start()
    codes, _, _, n = collocations.encoded(langs, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * len(text)
    assert n.sum() == 100_000 and (codes == 0).sum() == 100_000 // 9  # a cut at the very end parts nothing


def test_wide_scores(spark):
    """Products beyond 64 bits stay exact, and so do packed keys of any width."""
    got = spark.sql("SELECT ((CAST(9876543210123 AS DECIMAL(19, 0)) * CAST(9876543210123 AS DECIMAL(19, 0))) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST(9876543210124 AS DECIMAL(19, 0)) * CAST(9876543210125 AS DECIMAL(19, 0))) AS s").first().s
    assert got == 10**6 * 9876543210123**2 // (9876543210124 * 9876543210125)
    x = np.array([0, 1, 255, 256, 65_535, 65_536, 16_777_215], np.uint32)
    assert (collocations._numbers(collocations._planes(x, 3), 3) == x).all()
    wide = np.random.default_rng(0).integers(0, 1 << 32, (2, 5000), dtype=np.uint64).astype(np.uint32)
    assert (collocations.radix_order(list(wide)) == np.lexsort((wide[1], wide[0]))).all()


# toxicity


def toxic_corpus(n=400):
    rng = random.Random(11)
    plain = ["river", "stone", "Éclair", "winter", "garden", "letter", "bridge", "candle"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing", "."]) for _ in range(rng.randint(5, 200))]
        if i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["veju", "Lowei"]) + rng.choice(plain)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    return docs, labels


def test_toxicity_learns_stems(spark):
    docs, labels = toxic_corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores_of(d, toxicity.train(d, y)).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(docs) and all((got[i] >= 0.5) == bool(labels[i][1]) for i in held)
    assert {r.doc_id: r.score for r in toxicity.scores_of(d, toxicity.train(d, y)).collect()} == got  # reruns agree
    flipped = spark.createDataFrame([(i, 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v) for i, v in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.scores_of(d, toxicity.train(d, flipped)).collect()} == got  # held-out labels teach nothing


def test_toxicity_cases(spark):
    """Nulls, empty and very long texts, conflicting and repeated labels, repeated rows, one class, no labels, clashing names, ids of text."""
    docs, labels = toxic_corpus()
    long_text = " ".join(t for _, t in docs if "veju" not in t and "Lowei" not in t) * 3
    more = [("n", None), ("e", ""), ("l", long_text), ("t", long_text + " vejuriver"), ("1", docs[1][1]), (None, docs[0][1])]
    schema = "doc_id string, text string, y int, place long, h string"
    d = spark.createDataFrame([(str(i), t, 1, 2, "x") for i, t in docs] + [(i, t, 1, 2, "x") for i, t in more], schema).repartition(3)
    y = spark.createDataFrame([(str(i), v) for i, v in labels] + [("1", 0), ("2", 1), ("3", None), (None, 1), ("4", 7)], "doc_id string, toxic int")
    model = toxicity.train(d, y)
    got = defaultdict(list)
    for r in toxicity.scores_of(d, model).collect():
        got[r.doc_id].append(r.score)
    assert sum(map(len, got.values())) == len(docs) + len(more) and all(0 <= s <= 1 for v in got.values() for s in v)
    assert got["n"] == got["e"] and got["n"][0] < 0.5 and got["l"][0] < 0.5 and got["1"][0] == got["1"][1] and got[None][0] == got["0"][0] >= 0.5
    none = spark.createDataFrame([], "doc_id string, toxic int")
    assert {r.predicted for r in toxicity.scores_of(d, toxicity.train(d, none)).selectExpr("int(score >= 0.5) AS predicted").collect()} == {0}
    assert {r.predicted for r in toxicity.scores_of(d, toxicity.train(d, y.where("toxic = 1"))).selectExpr("int(score >= 0.5) AS predicted").collect()} == {1}
    assert toxicity.scores_of(d.limit(0), model).collect() == []


def test_grams_are_those_of_characters():
    texts = ["", "Ab,  cÉ!", "日本語です", "a", "x" * 30]
    g = toxicity.Grams(pa.array(texts))
    folded = [" " + re.sub(" +", " ", re.sub("[^0-9a-z\x80-\U0010ffff]", " ", t.lower())).strip() + " " if re.search("[0-9a-zA-Z\x80-\U0010ffff]", t) else " " for t in texts]
    assert list(np.diff(g.first)) == [len(f) for f in folded]
    for size, h, whole in g.hashes():
        seen = defaultdict(set)
        at = 0
        for f in folded:
            for i in range(len(f) - size + 1):
                assert whole[at + i]
                seen[f[i : i + size]].add(int(h[at + i]))
            at += len(f)
        assert all(len(v) == 1 for v in seen.values()) and whole.sum() == sum(max(0, len(f) - size + 1) for f in folded)


@needs_tables
def test_op13(spark):
    docs, labels = rows(spark, "documents", "doc_id", "text"), dict(rows(spark, "labels", "doc_id", "toxic"))
    got = llm.QUERIES["op13_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    told = [r for r in got if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in told) >= 0.97 * len(told)
