"""Disposition rows bound by hashes, names found by automata, and the sweep of spans."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog, dispositions, validation

UNSUPPORTED = "issuer string, product_code string, name string, disposition string, source_id string, source_version string, source_url string, protected_magic string, protected_sha256 string, protected_size_bytes long, source_payload_json string"
FAILED = "issuer string, product_code string, name string, document_id string, title string, pdf_sha256 string, pdf_size_bytes long, page_count int, reason_code string, reason string, attempts int"


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unsupported(code, change=None, **source):
    said = {**dict.fromkeys(dispositions.SOURCE_FIELDS, "x"), "metadata": {"b": [1, {"é": None}], "a": 0.5}, "issuer": "kb", "product_code": code, "product_name": "카드 é", "source_version": "v", "source_url": "https://a/b", **source}
    text = canonical(said)
    row = ["kb", code, "카드 é", "unsupported_drm", "source_" + hashlib.sha256(text.encode()).hexdigest(), "v", "https://a/b", "FASOO_DRMONE", "a" * 64, 5, text]
    for k, v in (change or {}).items():
        row[k] = v
    return tuple(row)


def test_unsupported_rows(spark):
    good = [unsupported(f"p{i}") for i in range(3)]
    spaced = unsupported("s")[10].replace(":", ": ", 1)
    bad = {
        "i": (unsupported("i", {0: "zz"}, issuer="zz"), "issuer"), "n": (unsupported("n", {2: ""}, product_name=""), "name"), "d": (unsupported("d", {3: "other"}), "disposition"), "u": (unsupported("u", {6: None}), "source_url,bound"), "m": (unsupported("m", {7: "PDF"}), "protected_magic"), "h": (unsupported("h", {8: "A" * 64}), "protected_sha256"),
        "z": (unsupported("z", {9: 0}), "protected_size_bytes"), "c": (unsupported("c", product_code="other"), "bound"), "e": (unsupported("e", extra="1"), "payload"), "t": (unsupported("t", category=3), "payload"), "w": (unsupported("w", {4: "source_" + "0" * 64}), "source_id"),
        "s": (unsupported("s", {10: spaced, 4: "source_" + hashlib.sha256(spaced.encode()).hexdigest()}), "payload"), "a": (unsupported("a"), "active"), "j": (unsupported("j", {10: '{"a":1,"a":1}'}), "source_id,payload,bound"),
    }
    twice = [unsupported("p9"), unsupported("p9")]
    rows = spark.createDataFrame(good + twice + [r for r, _ in bad.values()], UNSUPPORTED)
    issuers, active = spark.createDataFrame([("kb",)], "issuer string"), spark.createDataFrame([("kb", "a")], "issuer string, product_code string")
    got = {r.product_code: ",".join(r.reasons) for r in dispositions.wrong_unsupported(rows, issuers, active).collect()}
    assert got == {**{k: v for k, (_, v) in bad.items()}, "p9": "repeated"}
    assert dispositions.wrong_unsupported(rows.limit(0), issuers, active).collect() == []


def test_failed_rows(spark):
    row = lambda code, **k: tuple({**dict(zip(FAILED.replace(" string", "").replace(" long", "").replace(" int", "").split(", "), ("kb", code, "n", "doc_" + hashlib.sha256(code.encode()).hexdigest(), "t", "b" * 64, 1, 1, "no_text", "why", 1))), **k}.values())
    bad = {"1": ({"attempts": 0}, "attempts"), "2": ({"reason": "a\nb"}, "reason"), "3": ({"reason_code": "Bad"}, "reason_code"), "4": ({"page_count": None}, "page_count"), "5": ({"document_id": "doc_1"}, "document_id"), "6": ({}, "active"), "7": ({}, "active")}
    rows = spark.createDataFrame([row("ok")] + [row(k, **v) for k, (v, _) in bad.items()], FAILED)
    documents = spark.createDataFrame([("doc_" + hashlib.sha256(b"7").hexdigest(),)], "document_id string")
    got = dispositions.wrong_failed(rows, spark.createDataFrame([("kb",)], "issuer string"), spark.createDataFrame([("kb", "6")], "issuer string, product_code string"), documents)
    assert {r.product_code: ",".join(r.reasons) for r in got.collect()} == {k: v for k, (_, v) in bad.items()}


def test_seals(spark):
    rows = [unsupported("p3"), unsupported("p1", {7: "SCDSA002"}), unsupported("p2")]
    df = spark.createDataFrame(rows, UNSUPPORTED).repartition(3)
    payload = lambda r: {"disposition": r[3], "protected_magic": r[7], "protected_sha256": r[8], "protected_size_bytes": r[9], "source": json.loads(r[10]), "source_id": r[4]}
    seal_of = lambda docs: hashlib.sha256(canonical({"documents": docs, "schema_version": "v"}).encode()).hexdigest()
    sealed = seal_of(sorted(map(payload, rows), key=lambda p: canonical(p).encode()))
    early = seal_of([payload(r) for r in sorted(rows, key=lambda r: r[1])])
    got = dispositions.seal(df, dispositions.unsupported_payload(), "v").first()
    assert (got.n, got.sha256) == (3, sealed)
    wrong = lambda n, digest, **k: {r.reason for r in dispositions.wrong_seal(df, dispositions.unsupported_payload(), "v", n, digest, **k).collect()}
    assert wrong(3, sealed) == set() and wrong(3, early) == {"hash"} and wrong(3, early, order=["issuer", "product_code"]) == set()
    assert wrong(4, "0" * 64, most=2) == {"count", "hash", "too many"}
    assert dispositions.seal(df.limit(0), dispositions.unsupported_payload(), "v").first().sha256 == seal_of([])
    failed = spark.createDataFrame([("kb", "c", "n", "doc_1", 'q"é', "b" * 64, 1, 2, "r", "why", 3)], FAILED)
    want = {"attempts": 3, "document_id": "doc_1", "issuer": "kb", "page_count": 2, "pdf_sha256": "b" * 64, "pdf_size_bytes": 1, "product_code": "c", "product_name": "n", "reason": "why", "reason_code": "r", "title": 'q"é'}
    assert failed.select(dispositions.failed_payload().alias("p")).first().p == canonical(want)


@pytest.mark.parametrize("shard", [200_000, 3])
def test_names_by_automata(spark, monkeypatch, shard):
    """Names with one long common head, nested, repeated and of one letter; null and empty queries; many shards."""
    monkeypatch.setattr(catalog, "SHARD", shard)
    rng = random.Random(shard)
    names = [(f"L{i}", "deep card " + rng.choice(["one", "two", "gold plus", "gold", "é", "일"])) for i in range(12)] + [("X", "g"), ("Y", ""), ("Z", None), ("W", "gold")]
    queries = [(i, rng.choice(["Deep  CARD gold plus now", "deep card", "deep card two and deep card one", "gold and deep card gold", "nothing", "g", "", None])) for i in range(30)]
    got = {r.query_id: (r.resolution, r.lineages) for r in catalog.resolve_names(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(names, "lineage string, name string")).collect()}
    fold = lambda s: " ".join((s or "").casefold().split())
    for i, q in queries:
        text, hits = fold(q), {fold(n) for _, n in names if fold(n) and fold(n) in fold(q)}
        kept = set()
        for n in hits:
            rest = text
            for m in sorted((m for m in hits if n in m and m != n), key=len, reverse=True):
                rest = rest.replace(m, "\0")
            if n in rest:
                kept.add(n)
        want = sorted(x for x, n in names if fold(n) in kept)
        assert got[i] == ("unresolved" if not want else "resolved" if len(want) == 1 else "ambiguous", want), q


def test_spans_are_swept(spark):
    rng = random.Random(4)
    pieces = lambda n: [(rng.randrange(3), rng.choice([1, 1, 1, 2]), a, a + rng.randrange(12)) for a in (rng.randrange(60) for _ in range(n))]
    blocks, spans = pieces(200), pieces(60)
    schema = "document int, page int, start int, end int"
    got = sorted(tuple(r) for r in validation.uncovered_blocks(spark.createDataFrame(blocks, schema), spark.createDataFrame(spans, schema)).collect())
    assert got == sorted(b for b in blocks if not any(s[:2] == b[:2] and s[2] <= b[2] and s[3] >= b[3] for s in spans))
    plan = validation.uncovered_blocks(spark.createDataFrame(blocks, schema), spark.createDataFrame(spans, schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_passages_are_ranked(spark):
    rows = spark.createDataFrame([("kb", "c", "n", i, f"ring {i % 9}") for i in range(50)] + [("kb", "d", "n", 1, None)], "issuer string, product_code string, name string, position int, text string")
    assert [tuple(r) for r in catalog.merchant_hits(rows, "RING", 3).select("product_code", "passages").collect()] == [("c", ["ring 0", "ring 1", "ring 2"])]
    assert catalog.merchant_hits(rows.where(F.lit(False)), "RING").collect() == []
