from factlake import schemas
from factlake.operators import documents as D
from facts_data import facts


def test_identity(spark):
    paths = ["/a/Acme_Q4-report.pdf", "/a/.pdf", "/a/b.c.pdf", "/a/ plain ", "/x/y_.PDF"]
    df = D.doc_identity(spark.createDataFrame([(p,) for p in paths], "path string"))
    import hashlib

    got = {r.path: (r.doc_id, r.company) for r in df.collect()}
    names = ["Acme Q4 report", ".pdf", "b.c", "plain", "y"]
    assert got == {p: (hashlib.sha1(p.encode()).hexdigest(), n) for p, n in zip(paths, names)}


def test_pages(spark):
    docs = spark.createDataFrame([("d", ["a \n", "b"]), ("e", ["only"]), ("f", [])], "doc_id string, pages array<string>")
    pages = D.page_text(docs)
    assert sorted((r.doc_id, r.page_num, r.text) for r in pages.collect()) == [("d", 1, "a"), ("d", 2, "b"), ("e", 1, "only")]
    kept = D.drop_last_page(pages)
    assert [(r.doc_id, r.page_num) for r in kept.collect()] == [("d", 1)]
    assert [(r.doc_id, r.page_count) for r in D.page_counts(kept).collect()] == [("d", 1)]


def test_last_page_with_gaps_and_copies(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 7), ("d", 7), ("d", 3), ("e", None)], "doc_id string, page_num int")
    assert sorted(r.page_num for r in D.drop_last_page(pages).collect()) == [1, 3]


def _documents(spark, *rows):
    return spark.createDataFrame([(i, c, None, None, None, "/p", n) for i, c, n in rows], schemas.DOCUMENTS)


def test_upsert(spark):
    stored = _documents(spark, ("1", "old", 1), ("2", "kept", 2))
    batch = spark.createDataFrame(
        [("1", "a", None, None, None, "/p", 5, 1), ("1", "b", None, None, None, "/p", 6, 2), ("3", "new", None, None, None, "/p", 7, 1)],
        schemas.T.StructType(list(schemas.DOCUMENTS.fields)).add("batch_order", "integer"),
    )
    once = D.documents_upsert(stored, batch)
    expected = [("1", "b", 6), ("2", "kept", 2), ("3", "new", 7)]
    assert sorted((r.doc_id, r.company, r.page_count) for r in once.collect()) == expected
    twice = D.documents_upsert(once, batch)
    assert sorted((r.doc_id, r.company, r.page_count) for r in twice.collect()) == expected


def test_replace_is_idempotent_and_empties(spark):
    stored = facts(spark, {"doc_id": "1", "value": 1.0}, {"doc_id": "2", "value": 2.0}, {"doc_id": "3", "value": 3.0})
    batch = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    new = facts(spark, {"doc_id": "1", "value": 9.0}, {"doc_id": "1", "value": 8.0})
    once = D.facts_replace_by_doc(stored, batch, new)
    expected = [("1", 8.0), ("1", 9.0), ("3", 3.0)]
    assert sorted((r.doc_id, r.value) for r in once.collect()) == expected
    twice = D.facts_replace_by_doc(once, batch, new)
    assert sorted((r.doc_id, r.value) for r in twice.collect()) == expected


def test_cache(spark):
    requests = spark.createDataFrame(
        [("/a/x.pdf", False), ("/b/x.pdf", None), ("/a/y.pdf", True), ("/a/z.pdf", False)], "path string, force boolean"
    )
    cache = spark.createDataFrame([("x", "old-x"), ("y", "old-y")], "cache_key string, payload string")
    fresh = spark.createDataFrame([(p, "new") for p in ("/a/y.pdf", "/a/z.pdf")], "path string, payload string")
    got = {r.path: (r.payload, r.from_cache) for r in D.cache_merge(requests, cache, fresh).collect()}
    assert got == {
        "/a/x.pdf": ("old-x", True), "/b/x.pdf": ("old-x", True), "/a/y.pdf": ("new", False), "/a/z.pdf": ("new", False),
    }
    assert sorted(r.path for r in D.cache_misses(requests, cache).collect()) == ["/a/y.pdf", "/a/z.pdf"]


def test_validation(spark):
    rows = [
        ("d", "c", "year", None, "m", None, "1.5", "cr", "2", None, "0.5"),
        ("d", "c", "year", None, "m", None, "x", "cr", "2", None, "0.5"),
        ("d", None, "year", None, "m", None, "1", "cr", "2", None, "0.5"),
        ("d", "c", "year", None, "m", None, "1", "cr", "2", None, "-0.1"),
        ("d", "c", "year", None, "m", None, "1", "cr", "2", None, "1.1"),
        ("d", "c", "year", None, "m", None, "nan", "cr", "2", None, "1"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in schemas.FACT_COLUMNS))
    checked = D.validate_facts(df)
    assert D.accepted(checked).count() == 2
    assert sorted(r.reject_reason for r in D.rejected(checked).collect()) == [
        "company is missing", "confidence is outside 0 to 1", "confidence is outside 0 to 1", "value is missing",
    ]


def test_skip_existing(spark):
    inputs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    stored = spark.createDataFrame([("2",), ("2",)], "doc_id string")
    assert [r.doc_id for r in D.skip_existing(inputs, stored).collect()] == ["1"]
