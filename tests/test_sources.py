"""Snapshots, file formats, search over a pinned generation, and streaming forms."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.plans import search
from quillon.sources import files, ranges, snapshot
from quillon.sources.commits import CommitConflict, CommitLog
from quillon.streaming import ledger


def unit(score):
    """A vector whose product with [1, 0] is the score."""
    return [score, float(np.sqrt(1 - score * score))]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gen"))
    revisions = spark.createDataFrame([("L1", "r1", "superseded", "2020-01-01", None, "kb", "Deep"), ("L1", "r2", "current", "2021-01-01", "r1", "kb", "Deep"), ("L2", "r3", "current", "2021-06-01", None, "bc", "Blue")], "lineage string, revision string, temporal_status string, effective_date string, supersedes string, issuer string, name string")
    revisions = revisions.withColumn("effective_date", F.to_date("effective_date")).withColumn("launch_date", F.col("effective_date")).withColumn("launch_status", F.lit("confirmed"))
    data = [("r1", "n0", "CONTRACT", 0.9), ("r1", "n1", "DETAIL", 0.8), ("r2", "n0", "CONTRACT", 0.1), ("r2", "n1", "DETAIL", 0.3), ("r2", "n2", "DETAIL", 0.2), ("r3", "n0", "CONTRACT", 0.2), ("r3", "n1", "TITLE", 0.6)]
    matrix = spark.createDataFrame([(i, r, n, v, unit(s), f"{n} coffee") for i, (r, n, v, s) in enumerate(data)], "row_index long, revision string, node string, view_type string, embedding array<float>, display_text string")
    snapshot.publish(spark, path, {"revisions": revisions, "matrix": matrix}, {"matrix": ["row_index"]})
    return path


def test_search(spark, root):
    snap = snapshot.load(spark, root)
    got = search.search_contracts(snap, search.ContractSearch("coffee", (1.0, 0.0)))
    assert [(r.revision, round(r.score, 3), r["rank"]) for r in got["contracts"].orderBy("rank").collect()] == [("r3", 0.6, 1), ("r2", 0.3, 2)]
    assert got["nodes"].count() == 5 and got["lexical"].count() == 0 and got["coverage"].first().revisions == 2
    ask = lambda **k: [r.revision for r in search.search_contracts(snap, search.ContractSearch(k.pop("query", "coffee"), (1.0, 0.0), **k))["contracts"].orderBy("rank").collect()]
    assert ask(include_history=True) == ["r1", "r3", "r2"] and ask(as_of="2020-06-01") == ["r1"] and ask(issuer="국민카드") == ["r2"]
    assert ask(query="deep coffee") == ["r2"] and ask(limit=1) == ["r3"] and ask(launched_from="2021-05-01", launched_to="2021-12-31") == ["r3"]
    with pytest.raises(snapshot.GenerationMismatch):
        search.search_contracts(snap, search.ContractSearch("x", (1.0, 0.0), generation="other"))
    for bad in ({"limit": 0}, {"as_of": "2020-01-01", "include_history": True}, {"launched_from": "2020-01-01"}):
        with pytest.raises(ValueError):
            search.ContractSearch("x", (1.0,), **bad)
    done = spark.createDataFrame([("r2",)], "revision string")
    assert [r.revision for r in search.audit(snap, search.ContractSearch("x", (1.0, 0.0)), done).collect()] == ["r3"]


def test_poll_keeps_what_works(spark, root, tmp_path):
    held = snapshot.load(spark, root)
    assert snapshot.poll(spark, root, held) is held
    newer = snapshot.publish(spark, root, {"revisions": held["revisions"], "matrix": held["matrix"]})
    assert snapshot.poll(spark, root, held).generation == newer
    held = snapshot.poll(spark, root, held)
    CommitLog(spark, root).commit("broken")
    assert snapshot.poll(spark, root, held) is held
    assert snapshot.poll(spark, root, None).generation == held.generation  # the newest that can be read


def test_commits_have_one_order(spark, tmp_path):
    """Publishers at once, equal file times and clocks that go back give one order; readers never go back."""
    root = str(tmp_path)
    log = CommitLog(spark, root)
    assert log.last() is None and log.history() == []
    with pytest.raises(FileNotFoundError):
        snapshot.poll(spark, root, None)
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: CommitLog(spark, root).commit(f"g{i}"), range(24)))
    assert sorted(c.number for c in made) == list(range(24)) and len({c.generation for c in made}) == 24
    for k, c in enumerate(made):  # file times say nothing: all equal, then turned round
        os.utime(tmp_path / "commits" / f"{c.number:020d}.json", (1000, 1000))
    want = max(made)
    assert log.last() == want == log.last(0) == log.last(23) and log.history()[0] == want and log.read(99) is None
    for c in made:
        os.utime(tmp_path / "commits" / f"{c.number:020d}.json", (2000 - c.number, 2000 - c.number))
    assert log.last() == want and [c.number for c in log.history(5)] == [5, 4, 3, 2, 1, 0]
    with pytest.raises(CommitConflict):
        log.commit("late", parent=22)
    assert log.commit("next", parent=23).parent == 23
    assert not list((tmp_path / "commits").glob("_*"))  # no files left behind


def test_seal_tells_changed_tables(spark, tmp_path):
    root, rows_ = str(tmp_path), spark.range(50).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    g = snapshot.publish(spark, root, {"t": rows_})
    held = snapshot.load(spark, root, whole=True)
    assert held.number == 0 and held["t"].count() == 50
    spark.range(1, 51).withColumn("m", F.create_map(F.lit("k"), F.col("id"))).write.mode("overwrite").parquet(f"{root}/gen={g}/t")
    assert snapshot.load(spark, root).generation == g  # as many rows, same columns
    with pytest.raises(snapshot.SealBroken):
        snapshot.load(spark, root, whole=True)
    spark.range(3).write.mode("overwrite").parquet(f"{root}/gen={g}/t")
    with pytest.raises(snapshot.SealBroken):
        snapshot.poll(spark, root, None)


def test_hybrid(spark):
    rows = spark.createDataFrame([(1, "coffee discount", unit(0.1)), (2, "fuel", unit(0.9)), (3, "coffee", unit(0.5))], "id long, text string, embedding array<float>")
    got = search.search_evidence(rows, "coffee", (1.0, 0.0), 3).orderBy("rank").collect()
    assert [r.id for r in got][0] == 3 and len(got) == 3


def test_helpers():
    assert snapshot.byte_range("bytes=0-4", 10) == (0, 4) and snapshot.byte_range("bytes=-3", 10) == (7, 9) and snapshot.byte_range("bytes=5-", 10) == (5, 9)
    for bad in ("bytes=10-", "bytes=0-1,3-4", "rows=0-1", "bytes=5-4"):
        with pytest.raises(ValueError):
            snapshot.byte_range(bad, 10)
    assert snapshot.object_path("ab" * 32).startswith("sha256/ab/")
    with pytest.raises(ValueError):
        snapshot.object_path("xyz")


def test_ranges_of_objects(spark, tmp_path):
    body = bytes(range(256))
    digest = hashlib.sha256(body).hexdigest()
    place = tmp_path / snapshot.object_path(digest)
    place.parent.mkdir(parents=True)
    place.write_bytes(body)
    ask = lambda header: files.read_range(spark, str(tmp_path), digest, header).first()
    assert bytes(ask(None).content) == body and bytes(ask("bytes=10-19").content) == body[10:20] and bytes(ask("bytes=-3").content) == body[-3:]
    assert (ask("bytes=250-").start, ask("bytes=250-").end, ask("bytes=250-").size) == (250, 255, 256)
    with pytest.raises(ValueError):
        files.read_range(spark, str(tmp_path), digest, "bytes=300-")


def test_listings_by_rules(spark):
    rules = files.ListingRules(link=r"(/card/\S+\.(?:pdf|zip))$", code=r"goDetail\('([^']+)'", day=r"_(\d{8})\.", headers=("name", "file"), base="https://x")
    row = lambda code, name, file: f"<tr><td><a onclick=\"goDetail('{code}', '1')\">{name}</a></td><td><a href='{file}'>PDF</a></td></tr>"
    head = "<table><tr><th>name</th><th>file</th></tr>"
    page = lambda *rows: head + "".join(rows) + "</table>"
    df = lambda *htmls: spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    got = files.read_rows(df(page(row("01", "Deep  Card", "/card/a_20240102.pdf"), row("02", "B &amp; C", "/card/b_20230405.zip"), "<tr><td>no file</td></tr>"), None), rules)
    assert sorted((r.id, r.product_code, r.product_name, str(r.effective_date), r.source_url, r.file_name) for r in got.collect()) == [(0, "01", "Deep Card", "2024-01-02", "https://x/card/a_20240102.pdf", "a_20240102.pdf"), (0, "02", "B & C", "2023-04-05", "https://x/card/b_20230405.zip", "b_20230405.zip")]
    for bad, why in ((page(row("1", "n", "/card/a.pdf")), "no date"), (page(*[row("1", "n", "/card/a_20240101.pdf")] * 2), "twice"), ("<table><tr><th>other</th></tr></table>", "headers")):
        with pytest.raises(Exception, match=why):
            files.read_rows(df(bad), rules).collect()


def test_paged_json_listings(spark):
    body = lambda rows, more, n=None, ok="success": '{"result": "%s", "data": {"list": [%s], "count": %d, "more": "%s"}}' % (ok, ",".join(rows), len(rows) if n is None else n, more)
    row = lambda code, name: '{"code": "%s", "name": " %s "}' % (code, name)
    df = lambda *pages: spark.createDataFrame([("s", i + 1, p) for i, p in enumerate(pages)], "source string, page int, body string")
    read = lambda *pages: files.read_json_pages(df(*pages), "$.data.list", {"code": "$.code", "name": "$.name"}, "$.data.count", "$.data.more", ("$.result", "success"), {"code": "-"})
    got = read(body([row("1", "a"), row("-", "none")], "Y"), body([row("2", "b")], "N"))
    assert sorted((r.page, r.position, r.code, r.name) for r in got.collect()) == [(1, 0, "1", "a"), (2, 0, "2", "b")]
    for pages, why in (((body([row("1", "a")], "Y"),), "a page is missing"), ((body([], "N"), body([], "N")), "beyond the end"), ((body([row("1", "a")], "N", 3),), "another count"), ((body([], "N", ok="error"),), "no success"), (("{}",), "no records"), (("{",), "no records"), ((body([row("1", " ")], "N"),), "no name")):
        with pytest.raises(Exception, match=why):
            read(*pages).collect()


def test_resources(spark):
    from quillon.operators.catalog import Cursor
    from quillon.plans import resources

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rev = spark.createDataFrame([("L1", "r1", "current", "kb", "001", "Deep Blue", "2021-01-01", "d1", sha("1")), ("L2", "r2", "current", "bc", "002", "ＤＥＥＰ Sea", None, "d2", sha("2")), ("L3", "r3", "superseded", "bc", "002", "Old", "2020-01-01", "d3", sha("3")), ("L4", "r4", "current", "kb", "003", "Light", "2022-01-01", "d4", sha("4")), ("L5", "r5", "current", "kb", "003", "Light two", "2022-01-01", "d5", sha("5"))], "lineage string, revision string, temporal_status string, issuer string, product_code string, name string, day string, document_id string, pdf_sha256 string").withColumn("launch_date", F.to_date("day")).drop("day")
    pages = spark.createDataFrame([("r1", 1, "one", sha("one")), ("r1", 2, "two", sha("two"))], "revision string, page int, text string, text_sha256 string")
    issuers = spark.createDataFrame([("kb", "KB", 2), ("bc", "BC", 1), ("lotte", "Lotte", 3)], "issuer string, display_name string, sort_order int")
    none = spark.createDataFrame([("bc", "009")], "issuer string, product_code string")
    snap = snapshot.Snapshot("g", {"revisions": rev, "pages": pages, "issuers": issuers, "unsupported": none, "failed": none.limit(0), "evidence": spark.createDataFrame([("e1", "t")], "evidence_id string, text string")})
    assert [r.issuer for r in resources.issuers(snap).collect()] == ["bc", "kb", "lotte"]
    assert {(r.issuer, r.product_code, r.status) for r in resources.products(snap).collect()} == {("kb", "001", "available"), ("bc", "002", "available"), ("kb", "003", None), ("bc", "009", "unsupported_drm")}
    one = resources.product(snap, "국민카드", "001").first()
    assert (one.status, one.revision) == ("available", "r1") and resources.product(snap, "bc", "009").first().revision is None and resources.product(snap, "kb", "777").count() == 0
    assert resources.document(snap, "d1").first().pdf_path == snapshot.object_path(sha("1")) == resources.pdf_path(snap, "d1")
    assert resources.page(snap, "d1", 2).first().text == "two" and resources.page(snap, "d1", 3).count() == 0 and resources.evidence(snap, "e1").count() == 1
    with pytest.raises(ValueError):
        resources.pdf_path(snap, "nope")
    cursors = Cursor(b"k")
    find = lambda **k: resources.find_products(snap, resources.FindProducts(**k), cursors)
    got = find(keyword=" deep")
    assert [(r["rank"], r.revision) for r in got["items"].collect()] == [(1, "r2"), (2, "r1")] and (got["total"], got["next_cursor"]) == (2, None)
    first = find(mode="catalog", sort="launch_date", limit=3)
    rest = find(mode="catalog", sort="launch_date", limit=3, cursor=first["next_cursor"])
    assert [r.revision for r in first["items"].collect()] + [r.revision for r in rest["items"].collect()] == ["r4", "r5", "r1", "r2"] and rest["next_cursor"] is None
    assert {(r.issuer, r.products, r.loaded) for r in find(mode="coverage", issuers=("kb", "bc"))["coverage"].collect()} == {("kb", 2, True), ("bc", 2, True)}
    for bad in ({}, {"mode": "catalog", "keyword": "x"}, {"mode": "coverage", "limit": 3}, {"mode": "other"}, {"keyword": "x", "sort": "size"}, {"keyword": "x", "limit": 101}):
        with pytest.raises(ValueError):
            resources.FindProducts(**bad)
    with pytest.raises(ValueError):
        find(mode="catalog", sort="name", limit=3, cursor=first["next_cursor"])


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(good), "a int, b string").collect()] == [(1, "x"), (2, None)]
    for line in ('{"a": 1, "a": 2}', '{"a": NaN}', "{"):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(line + "\n")
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(bad), "a int").collect()
    for content in ('{"a": 1}\n{"a": 2}', '{"a": 1}\n\n{"a": 2}\n', "\n", '\ufeff{"a": 1}\n', '{"a": 1}\r\n', "[1]\n", "3\n"):
        bad.write_text(content)
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(bad), "a int").collect()
    many = tmp_path / "many"
    many.mkdir()
    for k in range(5):
        (many / f"{k}.jsonl").write_text(f'{{"a":{k},"b":"é"}}\n' * (k + 1))
    assert files.read_jsonl(spark, str(many), "a int, b string", canonical=True).count() == 15
    (many / "5.jsonl").write_text('{"a":5}')
    with pytest.raises(Exception, match="5.jsonl"):
        files.read_jsonl(spark, str(many), "a int").collect()
    (many / "5.jsonl").write_text('{"a": 5}\n')
    assert files.read_jsonl(spark, str(many), "a int").count() == 16
    with pytest.raises(Exception, match="canonical"):
        files.read_jsonl(spark, str(many), "a int", canonical=True).collect()


def test_matrix_files(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_index long, embedding array<float>")
    blocks = files.encode_f32(df, 4).orderBy("block").collect()
    assert b"".join(bytes(b.content) for b in blocks) == x.tobytes()
    (tmp_path / "v.f32").write_bytes(x.tobytes())
    assert [tuple(r) for r in files.read_f32(spark, str(tmp_path / "v.f32"), 3).orderBy("row_index").select("row_index", "embedding").collect()] == [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    with pytest.raises(Exception, match="no matrix"):
        files.read_f32(spark, str(tmp_path / "v.f32"), 7).collect()
    seg = x.tobytes()[20:40]
    inventory = spark.createDataFrame([(9, "v.f32", 20, hashlib.sha256(seg).hexdigest())], "query_id int, file string, offset int, sha256 string")
    assert [r.score for r in files.read_score_matrix(spark, str(tmp_path / "v.f32"), inventory, 5).orderBy("row_index").collect()] == [5.0, 6.0, 7.0, 8.0, 9.0]
    for wrong in (inventory.withColumn("sha256", F.lit("x")), inventory.withColumn("offset", F.lit(400)), inventory.withColumn("offset", F.lit(4))):
        with pytest.raises(Exception, match="inventory"):
            files.read_score_matrix(spark, str(tmp_path / "v.f32"), wrong, 5).collect()
    with pytest.raises(ValueError, match="inventory"):
        files.read_score_matrix(spark, str(tmp_path / "v.f32"), inventory, 7)
    wide = np.random.default_rng(1).normal(size=(70_001, 16)).astype("<f4")  # several records and splits
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.f32").write_bytes(wide.tobytes())
    (tmp_path / "m" / "b.f32").write_bytes(x.reshape(-1)[:16].tobytes())
    (tmp_path / "m" / "c.f32").write_bytes(b"")
    got = files.read_f32(spark, str(tmp_path / "m"), 16)
    assert sorted((r.file.rsplit("/", 1)[-1], r.n, r.last) for r in got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last")).collect()) == [("a.f32", 70_001, 70_000), ("b.f32", 1, 0)]
    assert all(np.array_equal(np.array(r.embedding, np.float32), wide[r.row_index]) for r in got.where("file LIKE '%a.f32' AND row_index % 9973 = 0").collect())
    hashes = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in files.inventory(spark, str(tmp_path / "m")).collect()}
    assert hashes["a.f32"] == (wide.nbytes, hashlib.sha256(wide.tobytes()).hexdigest())
    blob = spark.createDataFrame([(bytearray(x[0].tobytes()),), (None,)], "b binary")
    assert [r[0] for r in blob.select(files.unpack_blob("b")).collect()] == [[0.0, 1.0, 2.0], None]


def test_many_matrix_files_are_one_scan(spark, tmp_path):
    """A prime number of rows, empty and hidden files, and more files than partitions."""
    x = np.random.default_rng(2).normal(size=(10_007, 3)).astype("<f4")
    cuts = [0, *sorted(np.random.default_rng(3).integers(0, len(x), 399).tolist()), len(x)]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"{k:05d}.f32").write_bytes(x[a:z].tobytes())
    (tmp_path / "_hidden").write_bytes(b"12345")
    got = files.read_f32(spark, str(tmp_path), 3)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan and got.rdd.getNumPartitions() == 1
    rows_ = sorted((r.file, r.row_index, tuple(r.embedding)) for r in got.collect())
    assert [r[2] for r in rows_] == [tuple(float(v) for v in r) for r in x]
    small = ranges.source(spark, ranges.Matrix, dim=3, rangebytes=4096).load(str(tmp_path))
    assert small.rdd.getNumPartitions() > 10 and small.count() == len(x)
    assert ranges.packed([("a", 10), ("b", 0), ("c", 25)], 4, 8)[:2] == [[("a", 0, 8)], [("a", 8, 2)]]
    assert sum(n for g in ranges.packed([("a", 10), ("c", 25)], 4, 8) for _, _, n in g) == 35


def test_sealed_matrix(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(1009, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_index long, embedding array<float>").repartition(7)
    path = str(tmp_path / "v")
    seal = ranges.write_matrix(df, path, 8)
    parts = [(tmp_path / "v" / p["file"]).read_bytes() for p in seal["parts"]]
    assert b"".join(parts) == x.tobytes() and seal["rows"] == 1009 and [p["sha256"] for p in seal["parts"]] == [hashlib.sha256(b).hexdigest() for b in parts]
    assert not (tmp_path / "v" / "_temporary" / "x").exists() and not any((tmp_path / "v").glob("_temporary/*"))
    for verify in (False, True):
        assert [tuple(r.embedding) for r in files.read_matrix(spark, path, 8, verify).orderBy("row_index").collect()] == [tuple(float(v) for v in r) for r in x]
    with pytest.raises(Exception, match="sealed"):
        ranges.write_matrix(df, path, 8)
    with pytest.raises(ValueError, match="no sealed matrix"):
        files.read_matrix(spark, path, 4)
    first = tmp_path / "v" / seal["parts"][0]["file"]
    data = bytearray(first.read_bytes())
    data[5] ^= 1
    first.write_bytes(bytes(data))
    assert files.read_matrix(spark, path, 8).count() == 1009  # sizes are right
    with pytest.raises(Exception, match="seal"):
        files.read_matrix(spark, path, 8, verify=True).count()
    first.write_bytes(bytes(data[:32]))
    with pytest.raises(Exception, match="seal"):
        files.read_matrix(spark, path, 8).count()
    wrong = {"missing": df.where("row_index <> 500"), "follow": df.unionByName(df.where("row_index = 3")), "width": df.withColumn("embedding", F.when(F.col("row_index") == 9, F.slice("embedding", 1, 7)).otherwise(F.col("embedding"))),
             "length 1": df.withColumn("embedding", F.transform("embedding", lambda v: v * F.lit(1.01).cast("float"))), "null": df.withColumn("embedding", F.when(F.col("row_index") != 9, F.col("embedding")))}
    for k, (_, bad) in enumerate(wrong.items()):
        with pytest.raises(Exception):
            ranges.write_matrix(bad, str(tmp_path / f"w{k}"), 8)
        assert ranges.read_seal(str(tmp_path / f"w{k}")) is None and not list((tmp_path / f"w{k}").glob("**/*.f32"))
    assert ranges.write_matrix(df.limit(0), str(tmp_path / "none"), 8)["rows"] == 0 and files.read_matrix(spark, str(tmp_path / "none"), 8, True).count() == 0


def test_objects_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.3 GB: hashed as a stream, and ranges of it read without the rest."""
    size, mark = (2300 << 20) + 7, b"mark"
    place = tmp_path / snapshot.object_path("ab" * 32)
    place.parent.mkdir(parents=True)
    with open(place, "wb") as f:
        f.truncate(size)
        f.seek(size - 4)
        f.write(mark)
    got = files.read_range(spark, str(tmp_path), "ab" * 32, "bytes=-10").collect()
    assert [(r.size, r.start, r.end, r.offset, bytes(r.content)) for r in got] == [(size, size - 10, size - 1, size - 10, b"\0" * 6 + mark)]
    middle = files.read_range(spark, str(tmp_path), "ab" * 32, f"bytes=5-{100 << 20}", piece=8 << 20)
    assert middle.rdd.getNumPartitions() > 2 and middle.agg(F.sum(F.octet_length("content")), F.min("offset")).first() == ((100 << 20) - 4, 5)
    digest = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        digest.update(bytes(1 << 20))
    digest.update(b"\0" * (size % (1 << 20) - 4) + mark)
    assert [(r.length, r.sha256) for r in files.inventory(spark, str(tmp_path)).collect()] == [(size, digest.hexdigest())]


def test_pages_and_listing(spark):
    docs = spark.createDataFrame([(1, "## Page 2\nalpha\n## Page 3\nbeta\n", 2, 3)], "document int, text string, first int, last int")
    assert sorted(tuple(r) for r in files.split_pages(docs).collect()) == [(1, 2, "alpha"), (1, 3, "beta")]
    for text, last in (("## Page 2\nx\n", 3), ("## Page 2\n\n## Page 3\nx", 3)):
        with pytest.raises(Exception, match="expected run"):
            files.split_pages(spark.createDataFrame([(1, text, 2, last)], "document int, text string, first int, last int")).collect()
    html = spark.createDataFrame([(1, "<h1>T &amp; U</h1><ul><li><a href='/x'>a  b</a></li></ul>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in files.read_listing(html).orderBy("id").collect()] == [(1, "T & U", ["a b"], ["/x"]), (2, None, [], [])]
    with pytest.raises(Exception, match="heading"):
        files.read_listing(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")).collect()


def test_listing_titles_cut_within_a_reference(spark):
    html = spark.createDataFrame([(1, "<h1>a&amp;b&amp</h1>"), (2, "<h1>a&quot;&am</h1><li><a href='/x?a=1&copy=2'>b&lt</a></li>")], "page_id long, html string")
    assert [tuple(r) for r in files.read_listing(html).orderBy("id").collect()] == [(1, "a&b&amp", [], []), (2, 'a"&am', ["b&lt"], ["/x?a=1&copy=2"])]
    assert [r.title for r in files.read_listing(html, reference="amp").orderBy("id").collect()] == ["a&b&amp", "a&quot;&am"]


def test_streaming_ledger(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-02 09:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(src))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(src))
    q = ledger.observations(stream, "k", "t").writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("seen").collect()) == [("a", 2), ("b", 1)]
    seen = []
    pointer = tmp_path / "p"
    spark.createDataFrame([("g1",)], "generation string").write.parquet(str(pointer))
    ledger.on_new_generation(spark.readStream.schema("generation string").parquet(str(pointer)), seen.append, str(tmp_path / "c2")).awaitTermination(120)
    assert seen == ["g1"]
