"""Every registered query of these operators, and the pipeline, over the smallest tables against brute force."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_operators import brute_classes, brute_jaccard, brute_repeats, lower, plain_features, reshared, words

import corpus_pipeline
from quillon import llm
from quillon.llm import decontaminate, pii, quality, url_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows(spark, "documents", "doc_id", "text")


def ran(spark, name):
    return [tuple(r) for r in llm.QUERIES[name](spark, SF).collect()]


def test_op1(spark, documents):
    assert sorted(ran(spark, "op1_ngram_jaccard"), key=str) == brute_jaccard(documents)


def test_op2(spark, documents):
    assert sorted(ran(spark, "op2_substring_dedup"), key=str) == [r[:4] for r in brute_repeats(documents, lambda d: d)]


def test_op3(spark, documents):
    sentencepiece, public_tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in documents]
    assert sorted(ran(spark, "op3_token_counts")) == sorted(want)


def test_op4(spark):
    pages = rows(spark, "pages", "page_id", "html")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, h in pages:
        first[digest(h)] = min(first.get(digest(h), i), i)
    want = [(i, len((h or "").encode()), digest(h), "response" if first[digest(h)] == i else "revisit", None if first[digest(h)] == i else first[digest(h)]) for i, h in pages]
    assert sorted(ran(spark, "op4_warc")) == sorted(want)


def scores_of(documents, labels):
    """Scores by the plain formulas, from labels outside the held-out fold."""
    x = {d: np.array(plain_features(t)) for d, t in documents}
    seen = defaultdict(set)
    for d, y in labels:
        if d in x and y in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2:
            seen[d].add(y)
    taught = {d: y.pop() for d, y in seen.items() if len(y) == 1}
    both = np.array([x[d] for d in taught])
    mean, scale = both.mean(0), both.std(0)
    parts = []
    for c in (0, 1):
        z = (np.array([x[d] for d, y in taught.items() if y == c]) - mean) / scale
        cov = np.cov(z.T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.trace(cov) / len(cov) * np.eye(len(cov))
        parts.append((z.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
    rate, out = sum(taught.values()) / len(taught), {}
    for d, v in x.items():
        dens = [-0.5 * ((z := (v - mean) / scale - mu) @ inv @ z + logdet) for mu, inv, logdet in parts]
        margin = (dens[1] - dens[0] + math.log(rate / (1 - rate))) / quality.TEMPERATURE
        out[d] = 1 / (1 + math.exp(-max(-30, min(30, margin))))
    return out


def test_op5(spark, documents):
    want = scores_of(documents, rows(spark, "labels", "doc_id", "quality"))
    got = ran(spark, "op5_quality")
    assert len(got) == len(documents)
    for d, held, score, predicted in got:
        assert held == (zlib.crc32(str(d).encode()) % 4 == 2) and score == pytest.approx(want[d], abs=1e-6) and predicted == (score >= 0.7)


def test_op6(spark, documents):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = {r[0]: r[1:] for r in ran(spark, "op6_pii")}
    assert len(got) == len(documents)
    for d, t in documents:
        found = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                    found.append((m.start(), k, m.end()))
        base = [f"{list(kinds)[k]}:{s}:{e}" for s, k, e in sorted(found)]
        counts = tuple(sum(x.startswith(f"{kind}:") for x in base) for kind in kinds)
        assert got[d][:5] == (*counts, hashlib.sha256(",".join(base).encode()).hexdigest())
        assert set(base) <= set(got[d][5].split(",")) | {""}


def test_op7(spark):
    v = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows(spark, "embeddings", "vec_id", "embedding")]
    ids, m = np.array([i for i, _ in v]), np.array([e for _, e in v], np.int64)
    want = []
    for q, e in v:
        if q % 20 == 0:
            best = sorted((-int(s), int(j)) for s, j in zip(m @ np.array(e), ids) if j != q)[:20]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(ran(spark, "op7_exact_topk")) == sorted(want)


def hits_of(documents, benchmark):
    """(words, hit flags, items) of each document."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    find = lambda t: pattern.findall(lower(t or ""))
    windows = defaultdict(set)
    for i, t in benchmark:
        w = find(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes, out = {len(k) for k in windows}, {}
    for d, t in documents:
        w = find(t)
        hit, items = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit[k : k + n] = [True] * n
                    items |= windows[key]
        out[d] = (w, hit, sorted(items))
    return out


def test_op8(spark, documents):
    want = [(d, len(w), sum(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), any(hit)) for d, (w, hit, items) in hits_of(documents, rows(spark, "benchmark", "item_id", "text")).items()]
    assert sorted(ran(spark, "op8_decontaminate")) == sorted(want) and any(w[5] for w in want)


def test_op9(spark):
    want = []
    for i, u in rows(spark, "pages", "page_id", "url"):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, *(max(fits)[1:] if fits else (None, "allow"))))
    assert sorted(ran(spark, "op9_url_rules")) == sorted(want)


def near_targets(rows_, taken_of, size_of, source_of, target_of):
    by = defaultdict(list)
    for r in rows_:
        by[source_of(r)].append(r)
    for rs in by.values():
        target, largest = target_of(rs[0]), max(map(size_of, rs))
        assert abs(sum(map(taken_of, rs)) - target) <= 0.01 * target + largest / 2
    return by


def test_op10(spark):
    docs = {d: (s, len(words(t))) for d, s, t in rows(spark, "documents", "doc_id", "source", "text")}
    sizes = defaultdict(int)
    for s, n in docs.values():
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, reshared([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    got = ran(spark, "op10_mix")
    assert sorted(r[:2] for r in got) == sorted((d, n) for d, (_, n) in docs.items())
    for d, size, source_size, goal, taken in got:
        assert source_size == sizes[docs[d][0]] and goal == pytest.approx(target[docs[d][0]]) and taken in (0, size, 2 * size)
    near_targets(got, lambda r: r[4], lambda r: r[1], lambda r: docs[r[0]][0], lambda r: r[3])
    assert sorted(ran(spark, "op10_mix")) == sorted(got)


def test_pipeline(spark, documents):
    source = dict(rows(spark, "documents", "doc_id", "source"))
    scores = scores_of(documents, rows(spark, "labels", "doc_id", "quality"))
    good = [(d, t) for d, t in documents if scores[d] >= corpus_pipeline.REJECT_BELOW]
    sets, group = brute_classes(good)
    least = {}
    for g, (d, _) in zip(group, good):
        least[g] = min(least.get(g, d), d)
    one = [(d, t) for s, g, (d, t) in zip(sets, group, good) if not s or least[g] == d]
    texts = {}
    marked = hits_of(one, rows(spark, "benchmark", "item_id", "text"))
    for d, t in one:
        found, hit = list(re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")), marked[d][1]
        out, at, k = [], 0, 0
        while k < len(found):
            if hit[k]:
                end = k
                while end < len(found) and hit[end]:
                    end += 1
                out.append(t[at : found[k].start()])
                at, k = found[end - 1].end(), end
            else:
                k += 1
        texts[d] = t if t is None else pii.redact_text("".join(out) + t[at:])
    sizes = defaultdict(int)
    for d, t in texts.items():
        sizes[source[d]] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, reshared([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) <= len(one) < len(documents) and len({r.doc_id for r in got}) == len(got)
    for r in got:
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text) and r["size"] == len(words(r.text)) and r.copies in (1, 2) and r.taken == r.copies * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    near_targets(got, lambda r: r.taken, lambda r: r["size"], lambda r: r.source, lambda r: r.target)
    assert not decontaminate.mark(spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("hits > 0").count()
