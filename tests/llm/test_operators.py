"""Each operator against brute force on small texts with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, jaccard, mixing, nearest, pii, quality, repeats, tokens, url_rules, warc
from quillon.llm.common import with_hot_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, sid string, label int, n_words int"
WORDS = ["the", "of", "Éa", "and", "to", "in", "x1", "Über", "ñ", "was"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ".", "a", "b", "c"]) for _ in range(n))
    base, passage = say(120), say(45)
    out = [None, "", "  \n\t", "one", "one", "ONE", "a b c d", base, base, base.upper(), base + " tail", say(3) + " " + base, passage + "\n" + say(60), say(50) + " " + passage + " " + say(30), passage]
    for _ in range(25):  # near copies of one text
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice("pqrs") + str(rng.randrange(99))
        out.append(" ".join(w))
    return out + [say(rng.randint(1, 90)) for _ in range(25)] + [say(6000), "z" * 300_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4], len(t or ""), "c", "c", 1, 2) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1", 1, None, None, None, None), (None, texts[12], None, None, None, None, None, None, None), (3, "another text of one id", "en", "s2", 1, "c", "c", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(t):
    w = words(lower(t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """Sets of (doc_id, text) rows, and for each row the number of its class, by testing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                group[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def brute_jaccard(rows):
    sets, group = brute_classes(rows)
    least = defaultdict(list)
    for g, (d, _) in zip(group, rows):
        least[g].append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[group[i]] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard(docs, empty):
    rows = rows_of(docs)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute_jaccard(rows)
    assert jaccard.near_duplicates(empty).count() == 0
    named = docs.selectExpr("concat('d', doc_id) AS `doc.id`", "text AS TEXT", "1 AS doc_id", "2 AS __sid", "3 AS sid", "lang AS `a.b`")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(named, "doc.id", "TEXT").collect()), key=str)
    assert got == brute_jaccard([(r[0], r[1]) for r in named.collect()])
    sets, group = brute_classes(rows)
    for df, id_col, text_col in ((docs, "doc_id", "text"), (named, "doc.id", "TEXT")):
        kept = jaccard.keep_one(df, id_col, text_col)
        assert kept.columns == df.columns
        assert kept.count() == sum(not s for s in sets) + len({g for g, s in zip(group, sets) if s})


def test_sets_of_one_id_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "ID_BITS", 4)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute_jaccard(rows_of(docs))


def test_hot_shingles_and_hubs(spark, monkeypatch):
    rng = random.Random(19)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # near copies of one text, some of which link only with another copy
        w = list(base if i % 5 else base[:30] + [f"v{k}" for k in range(30)])
        for k in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            w[k] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w[: rng.choice([60, 60, 55, 20])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_jaccard(rows)
    for posts, pairs in ((3, 2), (20, 10**9), (10**9, 5)):
        monkeypatch.setattr(jaccard, "HOT_POSTS", posts)
        monkeypatch.setattr(jaccard, "HOT_PAIRS", pairs)
        assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == want


def test_product_of_a_block():
    rng = np.random.default_rng(8)
    some = lambda n: np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
    hubs = [some(40), some(3), np.empty(0, np.uint64)]
    members, of = [], []
    for k in range(300):
        h = k % 3
        keep = rng.random(len(hubs[h])) < rng.choice([0.5, 0.85, 1.0])
        members.append(rng.permutation(np.concatenate([hubs[h][keep], some(rng.integers(0, 9))])))
        of.append(h)
    lone = rng.integers(0, 3, 300)
    sizes = np.array([len(m) for m in members]) + lone
    ok = jaccard.product(np.repeat(np.arange(3), [len(h) for h in hubs]), np.concatenate(hubs), np.array([len(h) for h in hubs]), np.array(of), np.repeat(np.arange(300), [len(m) for m in members]), np.concatenate(members), sizes)
    want = [100 * (i := len(np.intersect1d(hubs[h], m))) >= 80 * (len(hubs[h]) + n - i) for h, m, n in zip(of, members, sizes)]
    assert ok.tolist() == want and any(want) and not all(want)


def test_many_near_copies_link_without_all_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for k in rng.sample(range(150), 3):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == 1


def brute_repeats(rows, order, window=20):
    """(doc_id, words, removed, digest, kept text) of (doc_id, text) rows, all windows by their words."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (order(d), i)), (order(d), i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(d), i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_substring_dedup(docs, empty):
    expected = brute_repeats(rows_of(docs), lambda d: 1 << 62 if d is None else d)
    got = [tuple(r) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == expected
    assert any(e[2] for e in expected)
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, window=7)
    named = docs.selectExpr("concat('d', doc_id) AS `doc.id`", "text AS TEXT", "1 AS doc_id", "2 AS block", "3 AS `a.b`")
    got = [tuple(r) for r in repeats.remove_repeats(named, id_col="doc.id", text_col="TEXT").collect()]
    assert sorted(got, key=str) == brute_repeats([(r[0], r[1]) for r in named.collect()], lambda d: (d is None, d or ""))


def test_hot_passages_are_spread(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_DOCS", 3)
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n))
    hot, other = say(57), say(33)
    rows = [(i, f"{say(rng.randint(0, 25))} {hot if i % 3 else other} {say(rng.randint(0, 25))} {hot if i % 7 == 0 else ''}") for i in range(240)]
    rows += [(5, rows[4][1]), (5, rows[4][1]), (None, hot), (None, hot), (-3, other)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows, lambda d: 1 << 62 if d is None else d)
    for limit in (1, 10, 10**9):
        monkeypatch.setattr(repeats, "HOT", limit)
        assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str) == want
        assert sorted((tuple(r) for r in repeats.remove_repeats(df, window=6).collect()), key=str) == brute_repeats(rows, lambda d: 1 << 62 if d is None else d, 6)


def test_token_counts(docs, empty):
    sentencepiece, public_tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted((tuple(r) for r in tokens.count_tokens(docs, model).collect()), key=str)
    expected = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows_of(docs)]
    assert got == sorted(expected, key=str)
    assert tokens.count_tokens(empty, model).count() == 0
    rng, count = random.Random(1), tokens.counter(model).count
    for _ in range(500):
        t = "".join(rng.choice("  ▁ab\n\t<s></s>01.,éüñ中文①😀_-\x00ﬁ") for _ in range(rng.randint(0, 40)))
        assert count(t) == len(sp.encode(t)), t


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "<p>é\r\n\r\nx</p>"), (2, "http://b/", "<p>é\r\n\r\nx</p>"), (9, None, None), (7, "http://c/\r\n", ""), (11, "u", "WARC/1.1\r\n\r\n"), (12, "u", "one"), (12, "u", "one"), (None, "u", "one"), (3, "u", "line\nline\r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    warc.write_archives(warc.records_of(pages), str(tmp_path / "w"), records_per_file=2)
    tell = lambda rows: sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload) for r in rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(first.get(digest(h), i), i)
    expected = []
    for i, _, h in rows:
        old = first.get(digest(h))
        again = old is not None and (i is None or i > old)
        expected.append((str(i).replace("None", "null"), len((h or "").encode()), digest(h), "revisit" if again else "response", str(old) if again else "None", "" if again else (h or "")))
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert got.where("record_type = 'revisit' AND payload_bytes IS NOT NULL").count() == 0
    resolved = warc.resolve_revisits(got)
    assert tell(resolved.collect()) == sorted(expected)
    warc.write_archives(resolved, str(tmp_path / "again"))  # fresh headers say the same
    assert tell(warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "again"))).collect()) == sorted(expected)
    warc.write_archives(warc.records_of(pages.limit(0)), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    large = spark.createDataFrame([(1, "u", "é\r\nWARC/1.1\n" * 200_000), (2, "u", "x" * 9_000_000), (3, "u", "é\r\nWARC/1.1\n" * 200_000)], "key long, url string, body string").withColumn("a.b", F.lit(1))
    warc.write_archives(warc.records_of(large, id_col="key", html_col="body").coalesce(1), str(tmp_path / "l"))
    back = {r.page_id: r for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "l"))).collect()}
    assert back["1"].payload == "é\r\nWARC/1.1\n" * 200_000 and back["2"].payload == "x" * 9_000_000 and (back["3"].refers_to, back["3"].payload_bytes) == ("1", back["1"].payload_bytes)
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))


def test_warc_archives_of_others(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"<p>\n</p>").digest()).decode()

    def record(kind, page, payload, more=""):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload if kind in ("response", "revisit") else payload
        return f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: http://{page}/\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    (tmp_path / "w").mkdir()
    one = record("warcinfo", "i", b"software: x") + record("response", "20", b"<p>\n</p>") + record("request", "q", b"GET / HTTP/1.1\r\n\r\n")
    two = record("response", "3", b"<p>\n</p>", f"WARC-Payload-Digest: sha1:{digest}\r\n") + record("revisit", "4", b"", f"WARC-Payload-Digest: sha1:{digest}\r\nWARC-Refers-To: <urn:page:20>\r\n") + record("revisit", "5", b"", "WARC-Payload-Digest: sha1:AAAA\r\nWARC-Refers-To: <urn:page:99>\r\n")
    (tmp_path / "w" / "one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (one[:50], one[50:])))
    (tmp_path / "w" / "two.warc").write_bytes(two)
    resolved = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w")))
    want = [("20", "revisit", digest, "3", "", 8), ("3", "response", digest, None, "<p>\n</p>", 8), ("4", "revisit", digest, "3", "", 8), ("5", "revisit", "AAAA", "99", "", None)]
    assert sorted((r.page_id, r.record_type, r.payload_digest, r.refers_to, r.payload, r.payload_bytes) for r in resolved.collect()) == want
    warc.write_archives(resolved, str(tmp_path / "again"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "again"))).count() == 4
    kept = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w")), min_payload=9).where("record_type = 'response'")
    assert kept.count() == 2
    with pytest.raises(ValueError, match="not the one of its digest"):
        [warc._record(h, b, True) for h, b in warc.parse_archive(two.replace(b"</p>", b"</b>"))]


def test_quality_held_out(spark, empty):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").limit(4000), spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.scores_of(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= 0.7) == (r.quality == 1) for r in got]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.scores_of(empty, model).count() == 0
    assert spark.range(20).select(quality.held_out(F.col("id")).alias("h"), "id").where(F.col("h")).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(20))
    none = quality.train(docs, labels.limit(0))
    assert none.score(np.zeros((2, quality.N_FEATURES))).tolist() == [0.5, 0.5]
    some = quality.train(docs, labels, most=400)  # a bounded sample serves as well
    got = quality.scores_of(docs, some).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in got) / len(got) > 0.95


def plain_features(text):
    """The statistics of a text, counted one by one."""
    raw, w = (text or "").encode(), [x.encode() for x in words(text)]
    upper, marks, digits = set(range(65, 91)), set(b".,;:'\"()-?"), set(b"0123456789")
    space = {32, *range(9, 14)}
    lower_ = set(range(97, 123)) | set(range(128, 256))
    symbol = set(range(256)) - upper - lower_ - digits - marks - space
    out = [math.log((sum(b in c for b in raw) + 0.02 * k) / (len(raw) + k)) for c, k in ((upper, 80), (marks, 40), (symbol, 40), ({10}, 40))]
    n = len(w)
    pairs = list(zip(w, w[1:]))
    out += [math.log((sum(map(len, w)) + 30) / (n + 5)), (max((w.count(x) for x in set(w)), default=0) + 1) / (n + 20), math.log((len(set(w)) + 20) / (n + 20)), math.log((len(pairs) - len(set(pairs)) + 0.4) / (n + 20))]
    return [*out, (sum(x[-1] in symbol for x in w) + 0.02) / (n + 4), (sum(len(x) == 1 and x[0] in symbol for x in w) + 0.02) / (n + 4)]


def test_quality_against_plain_formulas(spark):
    rng = random.Random(11)
    say = lambda: "".join(rng.choice("aB1.é #|\n  xyz,") for _ in range(rng.randint(0, 200)))
    rows = [(i, None if i % 40 == 0 else say() * (1 + i % 2 * 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = {i: np.array(plain_features(t)) for i, t in rows}
    taught = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    both = np.array([x[i] for i in taught])
    mean, scale = both.mean(0), both.std(0)
    dens = {}
    for c in (0, 1):
        z = (np.array([x[i] for i in taught if i % 2 == c]) - mean) / scale
        cov = np.cov(z.T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.trace(cov) / len(cov) * np.eye(len(cov))
        mu, inv, logdet = z.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        for i, _ in rows:
            d = (x[i] - mean) / scale - mu
            dens[i, c] = -0.5 * (d @ inv @ d + logdet)
    rate = sum(i % 2 for i in taught) / len(taught)
    for r in quality.scores_of(docs, model).collect():
        margin = (dens[r.doc_id, 1] - dens[r.doc_id, 0] + math.log(rate / (1 - rate))) / quality.TEMPERATURE
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, margin)))), abs=1e-6)


def test_quality_edge_cases(docs, spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.labelled(labels).collect()] == [(8, 1)] * (zlib.crc32(b"8") % 4 != 2)
    model = quality.train(docs, labels)
    got = quality.scores_of(docs, model)
    assert got.count() == docs.count() and got.where("score IS NULL OR isnan(score)").count() == 0
    named = docs.withColumnsRenamed({"lang": "__score", "size": "a.b", "sid": "TEXT"})
    kept = quality.accepted(named, model, 0.0)
    assert kept.columns == named.columns and kept.count() == docs.count() and quality.accepted(named, model, 1.1).count() == 0


def test_pii_base_and_disguise(docs, empty):
    kinds = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def brute(t):
        out = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in pattern.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and len(d) > 0 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("a1 @.+-(59") for _ in range(rng.randint(0, 40)))
        base, every = pii.find(t)
        assert base == brute(t) and set(base) <= set(every), t
    text = "é write bob [at] mail (dot) example.org or аnn@exаmple.com, call +four nine one two three four five six seven eight"
    base, every = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[s:e]) for s, k, e in every] == [("email", "bob [at] mail (dot) example.org"), ("email", "аnn@exаmple.com"), ("phone", "+four nine one two three four five six seven eight")]
    assert "@" not in pii.redact_text("x a@b.cd y") and pii.redact_text(None) is None
    got = pii.find_pii(docs)
    assert got.count() == docs.count() and got.where("doc_id IS NOT NULL AND base_sha256 IS NULL").count() == 0
    assert pii.find_pii(empty).count() == 0
    assert pii.redact(docs).columns == docs.columns
    for _ in range(2000):  # nothing is left, and the search ends
        t = "".join(rng.choice("a1 @.+-(59") for _ in range(rng.randint(0, 60)))
        assert pii.find(pii.redact_text(t)) == ([], [])
    assert pii.detect("1" * 100_000) == [] and pii.detect("a" * 100_000) == []


def test_pii_case_variants():
    for letter in sorted(set("".join(pii._SPELLED))):  # whatever a word matches is a digit
        alike = re.compile("(?i)" + letter)
        for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
            if alike.fullmatch(c):
                assert c.translate(pii._FOLD).lower() == letter
    for text, kind in [("+fıve sıx seven eıght one nIne one two three", "phone"), ("four one one one 1111 1111 1111 1111 call ſix", "card"), ("+ſeven ſix FÜNF ZÉRO one two three four five", "phone")]:
        assert kind in {pii.KINDS[k] for _, k, _ in pii.find(text)[1]} or kind == "card", text
    assert pii.find("call ſix seven eight nine") == ([], [])


def test_pii_addresses_have_no_bound():
    for text in ["x" * 900 + " at " + "y" * 70 + " dot com", "a at b" + " dot cc" * 9, "a at " + "b" * 500 + " dot cc"]:
        assert (0, 0, len(text)) in pii.find(text)[1]
    for part in ["a at b dot cc ", "a at b dot cc dot ", " dot cc", "a.b at c dot ddé "]:
        pii.find(part * 50_000)  # in linear time


def test_pii_disguise_beside_a_base_fragment():
    for text, kind in [("jоhn@example.com", "email"), ("john@example.cоm", "email"), ("john\u200b.doe@example.com", "email"), ("+49 170 123456７", "phone"), ("192.168.0.1７", "ip")]:
        base, every = pii.find(f"x: {text}, y")
        assert base and set(base) < set(every), text  # the fragment stays
        assert (3, pii.KINDS.index(kind), 3 + len(text)) in every, text
        assert pii.redact_text(f"x: {text}, y") == f"x: [{kind.upper()}], y"
    assert pii.find("é a@b.cd а")[1] == pii.find("é a@b.cd а")[0]  # what lies in a base span of its kind adds nothing
    text = "jоhn@example.com " * 5000
    assert len(pii.find(text)[1]) == 10_000 and pii.redact_text(text) == "[EMAIL] " * 5000


def test_pii_spelled_runs_and_bare_dots():
    whole = {
        "ip": ["one two seven (dot) zero (dot) zero (dot) one", "192 dot 168 dot 0 dot 1", "192 dot one six eight dot 0 [dot] one", "un neuf deux point un six huit point zéro point un"],
        "email": ["name@example dot com", "name@mail.example dot co dot uk", "john dot doe@example dot com", "john dot doe at example dot com", "a dot b dot c [at] d dot ef"],
        "card": ["4111 one one one one 1111 1111", "four one 11 1111 1111 111 one", "quatre " + " ".join(["un"] * 15)],
        "phone": ["+49 one seven zero 123456", "+49 170 12345 six seven", "+trois trois un deux trois quatre cinq six sept huit neuf"],
    }
    for kind, texts in whole.items():
        for text in texts:
            said = f"é: {text}, end"
            assert (3, pii.KINDS.index(kind), 3 + len(text)) in pii.find(said)[1], text
            assert pii.redact_text(said) == f"é: [{kind.upper()}], end", text
    assert pii.redact_text("a@b dot com and c@d dot org") == "[EMAIL] and [EMAIL]"
    for text in ["un four one one one 1111 1111 1111", "four one one one 1111 1111 1111 un jour", "one ４111 1111 1111 1111", "four one one one 1111 1111 1111 two onerous"]:  # a word beside it spoils no number
        assert "card" in {pii.KINDS[k] for _, k, _ in pii.find(text)[1]}, text
    for text in ["one or two, the point is 3 point 5", "un jour, sept ans et huit mois", "on one day in 1990 two dot com firms", "one dot two", "one hundred twenty-two", "x dot y dot z"]:
        assert pii.find(text) == ([], []), text
    rng = random.Random(6)
    parts = ["1", "27", "+", " ", " ", "-", "@", "one", "un", "zéro", "sept", " dot ", " (dot) ", " [at] ", " at ", "ab", "а", "７", "\u200b", "a@b.cd", "[EMAIL]"]
    for _ in range(5000):  # nothing is left, and the search ends
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        base, every = pii.find(text)
        assert set(base) <= set(every) and all(0 <= s < e <= len(text) for s, _, e in every)
        assert pii.find(pii.redact_text(text)) == ([], []), text
    for part in ["one ", "one dot ", "1 dot ", "+", "un-", "dot ", "a@", "@ dot ", " dot  ", "(", "one("]:
        assert pii.find(part * 50_000)[0] == [], part  # in linear time


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(180)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (60, rows[3][1]), (2004, []), (2020, [1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(6)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.top_k(df, df.where("vec_id % 20 = 0"), 20).collect())
    quant = {}
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, (i, v) in enumerate(fine):
        if i % 20:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:20]
        quant.setdefault(i, []).extend(best)
    for i, best in quant.items():
        best = sorted(best)[:20]
        expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert [g for g in got if g[0] != 60] == sorted(e for e in expected if e[0] != 60)
    every = {}  # a query id of two rows has the best of both
    for i, v in fine:
        if i == 60:
            for j, w in fine:
                if j != 60:
                    every.setdefault(60, []).append((-sum(a * b for a, b in zip(v, w)), j))
    assert [g for g in got if g[0] == 60] == [(60, k + 1, j, -s) for k, (s, j) in enumerate(sorted(every[60])[:20])]
    assert nearest.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_top(rows, k=20):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), j) for j, w in rows if j != q)[:k]
            out += [(q, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_exact_topk_negative_ties_and_large_numbers(spark):
    rng = np.random.default_rng(12)
    tied = [(0, [-2000 / 64, 0.0])] + [(i, [2000 / 64, -5 / 64]) for i in range(1, 100)] + [(i, [2000 / 64, 5 / 64]) for i in range(100, 200)]
    apart = [(i, [float(x) for x in rng.choice([-30.0, 30.0], 2) + rng.normal(size=2).round(1)]) for i in range(300)]
    opposite = [(i, [float(x) for x in (-50.0 if i % 20 == 0 else 50.0) + rng.normal(size=3).round(1)]) for i in range(400)]
    large = [(i, [float(x) for x in rng.integers(-3, 4, 3) * 2.0**40 + rng.integers(0, 2, 3)]) for i in range(120)]
    mixed = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 150)]) for i in range(120)] + [(200, [2.0**25 + 1 / 64, 0.0, 0.0]), (201, [2.0**25 + 2 / 64, 0.0, 0.0])]
    for rows in (tied, apart, opposite, large, mixed):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.top_k(df, df.where("vec_id % 20 = 0")).collect())
        assert got == brute_top(rows)
    huge = spark.createDataFrame([(0, [1e308]), (20, [1.0]), (21, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.top_k(huge, huge).collect()] and 0 not in {r.vec_id for r in nearest.top_k(huge, huge).collect()}


def test_exact_topk_one_id_of_many_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(40, [float(x) for x in rng.normal(size=2)]) for _ in range(200)] + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(39)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS `a.b`", "2 AS Embeddings")
    got = [tuple(r) for r in nearest.top_k(df, df.where("vec_id = 40")).collect()]
    best = sorted({(-max(sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)) for q, v in rows if q == 40), j) for j, w in rows if j != 40})
    assert len(got) == 20 and {g[0] for g in got} == {40} and got[0][2:] == (best[0][1], -best[0][0])


def test_cover_tree_prunes_and_agrees(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 300
    c = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)))
    q = np.floor(centres[rng.integers(0, 20, 200)] + rng.normal(size=(200, 8)))
    tree = nearest.Tree(c)
    assert tree.root[3] is not None
    keys = -np.sort(-nearest.search(q, nearest.Tree(q), c, tree, np.full(200, -np.inf), 5), axis=1)
    scores = q @ c.T
    assert (keys >> nearest.BITS == -np.sort(-scores, axis=1)[:, :5]).all()


def test_decontamination(docs, empty, spark):
    bench = spark.createDataFrame([(1, "The of AND to in was x1 the of and to in"), (2, None), (3, "one"), (None, "another text"), (2, "..."), (10, "zz yy")], "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    find = lambda t: pattern.findall(lower(t or ""))
    windows = defaultdict(set)
    for r in bench.collect():
        w = find(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if r.item_id is None else str(r.item_id))
    expected = []
    for d, t in rows_of(docs):
        w, hit, items = find(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    items |= windows[key]
                    hit |= set(range(i, i + size))
        expected.append((d, len(w), len(hit), sorted(items)))
    marked = decontaminate.mark(docs, bench)
    got = [(r.doc_id, r.words, int((x[1::2] - x[::2]).sum()), r["items"]) for r in marked.collect() for x in [np.frombuffer(bytes(r.spans), np.int64)]]
    assert sorted(got, key=str) == sorted(expected, key=str) and any(e[2] for e in expected)
    named = docs.withColumnsRenamed({"lang": "a.b", "sid": "TEXT", "size": "words"}).withColumn("key", F.monotonically_increasing_id())
    named = spark.createDataFrame(named.collect(), named.schema)
    clean = decontaminate.cleaned(named, bench)
    assert clean.columns == named.columns
    by_key = {r.key: r.text for r in clean.collect()}
    spans = {r.doc_id: (named.where(F.col("key") == r.doc_id).first().text, np.frombuffer(bytes(r.spans), np.int64).reshape(-1, 2)) for r in decontaminate.mark(named, bench, id_col="key").where("size(items) > 0").collect()}
    for key, (text, cut) in spans.items():
        at, out, found = 0, [], list(re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        for a, e in cut:
            out.append(text[at : found[a].start()])
            at = found[e - 1].end()
        assert by_key.pop(key) == "".join(out) + text[at:]
    assert spans and sorted(map(str, by_key.values())) == sorted(str(r.text) for r in named.collect() if r.key not in spans)
    again = decontaminate.mark(clean.where("doc_id = 3"), bench).collect()
    assert all(not r["items"] for r in again)
    assert decontaminate.mark(empty, bench).count() == 0 and decontaminate.mark(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_benchmark_in_blocks(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["the of and", "to in was", "one"])], "item_id long, text string")
    tell = lambda: sorted(str(r) for r in decontaminate.mark(docs, bench).select("doc_id", "spans", "items").collect())
    whole = tell()
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b: [[(str(i), t)] for i, t in enumerate(["the of and", "to in was", "one"])])
    assert tell() == whole


def test_shards_of_any_size_agree():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    items = [(str(i % 7), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for i in range(12)]
    windows = {}
    for name, t in items:
        w = t.split()
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    for size in (1, 7, 60):
        shard = decontaminate.Shard(lambda: iter([decontaminate.Block(items[:5]), decontaminate.Block(items[5:])]))
        got = []
        for at in range(0, 60, size):
            shard.add(None, pa.array(texts[at : at + size]))
            if size == 7 or at + size >= 60:
                for _, counts, hit, first, found in shard.found():
                    got += [(hit[first[d] : first[d + 1]].tolist(), found[d]) for d in range(len(counts))]
        for t, (hit, found) in zip(texts, got, strict=True):
            w = t.split()
            want, names = [False] * len(w), set()
            for i in range(len(w)):
                for key, owners in windows.items():
                    if tuple(w[i : i + len(key)]) == key:
                        want[i : i + len(key)] = [True] * len(key)
                        names |= owners
            assert (hit, found) == (want, names)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?q#f", "http://www.example.org/en/12#x", "http://example.org/en/2", "http://notexample.org/es/", "http://a.org", "http://a.org?x/y", "http://b.com/fr/", "http://com/de/", "http://b.com/es/", "x://c.example.org/es//a://b", "http://org/", "http://a.b.org:80/", "http://x\x01org/", "http://é.com/fr/é"]
    hosts = ["org", "example.org", "x.example.org", "com", "a.com", "net"]
    rng = random.Random(8)
    urls += [f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(30)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 310, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = lower(host)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    expected = sorted(((i % 310, *judge(u)) for i, u in enumerate(urls)), key=str)
    assert sorted((tuple(r) for r in url_rules.apply_rules(pages, url_rules.RULES).collect()), key=str) == expected
    frame = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    assert sorted((tuple(r) for r in url_rules.apply_rules(pages, frame).collect()), key=str) == expected
    assert url_rules.apply_rules(pages.limit(0), frame).count() == 0
    none = url_rules.apply_rules(pages, frame.limit(0), default="block")
    assert none.count() == len(urls) and none.where("rule IS NOT NULL OR verdict <> 'block'").count() == 0


def test_url_rules_ties_nesting_and_many_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "x.com", "y.x.com", "ab.com", "a.", "", "é.org", "org", "x\x01org", "x\x02org", "b.c.org"]
    some = lambda n: "".join(rng.choice("/ab1é") for _ in range(rng.randint(0, n)))
    rules = [("com", "/ab", "block"), ("x.com", "/", "allow"), ("x.com", "/", "block"), ("com", "/a", None), (None, "/", "block"), ("org", None, "block"), ("", "", "block"), ("b.c.org", "/" + "a" * 5000, "block")]
    rules += [(rng.choice(hosts), some(4), rng.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}/{some(6)}" for _ in range(1500)] + ["http://x.com/ab"] * 700 + ["http://b.c.org/" + "a" * 6000, None]
    pages = spark.createDataFrame([(None if i % 50 == 0 else str(i % 90), u, "x", 1, 2) for i, u in enumerate(urls)], "id string, link string, `page.id` string, row int, KEY int").repartition(6)

    def judge(u):
        host = path = ""
        if u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = lower(host)
        fits = [(-len(h) - len(p), h + p, v or "allow") for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdicts = {}
        for size, name, v in fits:
            verdicts.setdefault((size, name), []).append(v)
        best = min(verdicts, default=None)
        return (host, path, best[1], min(verdicts[best])) if best else (host, path, None, "allow")

    got = url_rules.apply_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string").repartition(4), id_col="id", url_col="link").collect()
    want = [(None if i % 50 == 0 else str(i % 90), *judge(u)) for i, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert judge("http://x.com/ab")[2:] == ("com/ab", "block")  # as long as x.com/, and the smaller name


def reshared(sizes, weights, total, cap=2.0):
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = (total - sum(out)) / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            return out
        for i in over:
            out[i] = cap * sizes[i]
        open_ -= set(over)
    return out


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sorted((str(r.id), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t in rows_of(docs))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    assert target == pytest.approx(dict(zip(order, reshared([sizes[s] for s in order], weights, 1.5 * sum(sizes.values())))))
    assert all(r.source_size == sizes[r.source] for r in got)
    for s in order:
        largest = max(r["size"] for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + largest / 2  # copies are whole
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    text_ids = docs.selectExpr("concat('d', doc_id) AS `doc.id`", "text AS `__key`", "source AS `__size`", "1 AS KEY", "2 AS n", "3 AS row")
    again = mixing.mix(text_ids, id_col="doc.id", text_col="__key", source_col="__size")
    assert sorted((str(r.source), r["size"], r.target) for r in again.collect()) == sorted((str(r.source), r["size"], r.target) for r in got)


def test_mixing_rates_solve_the_dual(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60) for _ in range(1)) + " x" * rng.randint(0, 300), rng.choice("abcdefg")) for i in range(1500)] + [(5000 + i, "", "empty") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.rated(mixing.written(mixing.sized(docs), "t")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for source, rs in by.items():
        size, rate = np.array([r["size"] for r in rs], float), np.array([r.rate for r in rs])
        target, total = rs[0].target, size.sum()
        assert abs((rate * size).sum() - target) <= 1e-5 * max(1, target) and rate.min(initial=0) >= 0 and rate.max(initial=0) <= 2
        if 0 < target < 2 * total * (1 - 1e-9):  # by halving: the dual has one root
            scale, low, high = max(1.0, total / len(rs)), -200.0, 200.0
            for _ in range(200):
                lam = (low + high) / 2
                low, high = (lam, high) if (2 / (1 + np.exp(-np.clip(lam * size / scale, -700, 700))) * size).sum() < target else (low, lam)
            assert rate == pytest.approx(2 / (1 + np.exp(-np.clip(lam * size / scale, -700, 700))), abs=1e-5)
    few = mixing.mix(docs, weights=(1, 0), share=5.0).collect()  # more than all sources hold: twice of each that has a weight
    order = sorted({r.source for r in few})
    assert all(r.copies == (0 if order.index(r.source) % 2 else 2) for r in few if r["size"])


def test_mixing_takes_repeated_rows_one_by_one(spark):
    rows = [(1, "a b c", "s", k) for k in range(60)] + [(i, "d " * i, "t", 0) for i in range(2, 40)] + [(None, "a b c", None, 1)] * 7 + [(None, "", "s", 1)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got, told = mixing.mixed(docs).collect(), mixing.mix(docs).where("copies > 0").collect()
    tell = lambda rs, i: sorted((str(r[i]), str(r.source), r["size"], r.copies, r.taken) for r in rs)
    assert tell(got, "doc_id") == tell(told, "id") and len(got) < len(rows)
    assert mixing.mixed(docs).columns == ["doc_id", "text", "source", *mixing.ADDED]


def test_pipeline_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert {"size", "source_size", "target", "copies", "taken"} <= set(at.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_mixing_stage_drops_what_the_mix_leaves(docs):
    want = sorted((str(r.id), r.copies, r.taken) for r in mixing.mix(docs).collect() if r.copies)
    got = corpus_pipeline.mixing_stage(docs.sparkSession, docs, "")
    assert 0 < len(want) < docs.count() and sorted((str(r.doc_id), r.copies, r.taken) for r in got.collect()) == want


def test_ids_of_any_type_and_clashing_names(docs, spark):
    named = docs.selectExpr("concat('d', doc_id) AS `doc.id`", "text AS TEXT", "source AS Source", "1 AS n", "2 AS sid", "3 AS print", "4 AS c0", "5 AS `a.b`", "6 AS __few", "7 AS row")
    ids = sorted(str(r[0]) for r in named.select("`doc.id`").collect())
    tell = lambda df, column: sorted(str(r[0]) for r in df.select(column).collect())
    bench = spark.createDataFrame([("x", "the of and")], "Name string, TEXT string")
    model = quality.train(docs, spark.createDataFrame([(7, 1), (8, 0), (10, 1), (11, 0), (13, 1), (14, 0)], "doc_id long, quality int"))
    assert tell(quality.scores_of(named, model, "doc.id", "TEXT"), "doc_id") == ids
    assert tell(pii.find_pii(named, "doc.id", "TEXT"), "doc_id") == ids
    assert tell(decontaminate.mark(named, bench.withColumnsRenamed({"Name": "item_id", "TEXT": "text"}), "doc.id", "TEXT"), "doc_id") == ids
    assert tell(mixing.mix(named, id_col="doc.id", text_col="TEXT", source_col="Source"), "id") == ids
    for out in (pii.redact(named, "TEXT"), quality.accepted(named, model, 0.0, "TEXT"), decontaminate.cleaned(named, bench.withColumnsRenamed({"Name": "item_id", "TEXT": "text"}), "TEXT")):
        assert out.columns == named.columns and out.count() == len(ids)
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert tell(tokens.count_tokens(named, public_tokenizers.path("piece_bpe_32k.model"), id_col="doc.id", text_col="TEXT"), "doc_id") == ids


def test_hot_keys_meet_their_values(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(900)] + [(1000, None), (1001, "alone")]
    df = spark.createDataFrame(rows, "id long, key string")
    counts = defaultdict(int)
    for _, k in rows:
        counts[k] += 1
    table = spark.createDataFrame([(k, n, f"v{k}", n) for k, n in counts.items() if k not in (None, "alone")], "key string, n long, value string, size long")
    got = with_hot_keys(df, table, "key", ["value", "size"], ["id"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, k, f"v{k}" if k not in (None, "alone") else None, counts[k] if k not in (None, "alone") else None)) for i, k in rows)
    assert with_hot_keys(df.limit(0), table, "key", ["value"], ["id"]).count() == 0 and with_hot_keys(df, table.limit(0), "key", ["value"], ["id"]).where("value IS NULL").count() == len(rows)
