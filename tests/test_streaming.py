import json

from factlake.schemas import EXTRACTIONS
from factlake.streaming import ingest as I


def raw(**fields):
    return json.dumps({"document_meta": {"company": "Acme"}, "page_1": {"s": fields}})


def put(spark, folder, name, *rows):
    spark.createDataFrame(list(rows), EXTRACTIONS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path):
    query = I.incremental_ingest(
        spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/checkpoint", files_per_batch=1
    )
    query.awaitTermination()
    facts = sorted((r.source_span, r.value) for r in I.current_facts(spark, f"{tmp_path}/out").collect())
    documents = {r.source_path for r in I.current_documents(spark, f"{tmp_path}/out").collect()}
    return facts, documents


def test_new_changed_and_emptied_documents(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", ("/1.pdf", raw(x=1)), ("/2.pdf", raw(y=2)), ("/bad.pdf", "none"))
    assert run(spark, tmp_path) == ([("page_1.s.x", 1.0), ("page_1.s.y", 2.0)], {"/1.pdf", "/2.pdf"})
    assert run(spark, tmp_path)[0] == [("page_1.s.x", 1.0), ("page_1.s.y", 2.0)]
    put(spark, f"{tmp_path}/in", "b", ("/1.pdf", raw(x=5, z=6)), ("/3.pdf", raw(w=3)))
    facts, documents = run(spark, tmp_path)
    assert facts == [("page_1.s.w", 3.0), ("page_1.s.x", 5.0), ("page_1.s.y", 2.0), ("page_1.s.z", 6.0)]
    assert documents == {"/1.pdf", "/2.pdf", "/3.pdf"}
    put(spark, f"{tmp_path}/in", "c", ("/2.pdf", raw()))
    facts, documents = run(spark, tmp_path)
    assert facts == [("page_1.s.w", 3.0), ("page_1.s.x", 5.0), ("page_1.s.z", 6.0)]
    assert documents == {"/1.pdf", "/2.pdf", "/3.pdf"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("/1.pdf", raw(x=1)), ("/1.pdf", raw(x=1)), ("/2.pdf", raw(y=2))], EXTRACTIONS)
    for _ in range(2):
        I.write_batch(batch, 7, f"{tmp_path}/out")
        assert sorted(r.value for r in I.current_facts(spark, f"{tmp_path}/out").collect()) == [1.0, 2.0]


def test_pages(spark, tmp_path):
    def put_pages(name, *rows):
        spark.createDataFrame(list(rows), "path string, pages array<string>").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run_pages():
        I.incremental_ingest(
            spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/checkpoint",
            schema=spark.createDataFrame([], "path string, pages array<string>").schema,
            write=lambda batch, n, target: I.write_page_batch(batch, n, target, ignore_last_page=True),
        ).awaitTermination()
        pages = sorted((r.company, r.page_num, r.text) for r in I.current_pages(spark, f"{tmp_path}/out").collect())
        counts = {r.company: r.page_count for r in I.current_documents(spark, f"{tmp_path}/out").collect()}
        return pages, counts

    put_pages("a", ("/in/Acme_Q1.pdf", ["one  ", "two", "last"]), ("/in/b.pdf", ["only"]))
    assert run_pages() == ([("Acme Q1", 1, "one"), ("Acme Q1", 2, "two")], {"Acme Q1": 2, "b": 0})
    put_pages("b", ("/in/Acme_Q1.pdf", ["new", "last"]), ("/in/b.pdf", ["x", "y"]))
    assert run_pages() == ([("Acme Q1", 1, "new"), ("b", 1, "x")], {"Acme Q1": 1, "b": 1})


def test_rejects_and_the_version_before(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", ("/1.pdf", raw(x=1)), ("/bad.pdf", "none"), ("/2.pdf", raw(y=2)))
    run(spark, tmp_path)
    put(spark, f"{tmp_path}/in", "b", ("/1.pdf", "{ broken"), ("/bad.pdf", raw(z=3)))
    facts, documents = run(spark, tmp_path)
    # the version that cannot be read replaces nothing
    assert facts == [("page_1.s.x", 1.0), ("page_1.s.y", 2.0), ("page_1.s.z", 3.0)]
    assert documents == {"/1.pdf", "/2.pdf", "/bad.pdf"}
    rejects = {(r.path, r.raw, r.open) for r in I.rejected_extractions(spark, f"{tmp_path}/out").collect()}
    assert rejects == {("/bad.pdf", "none", False), ("/1.pdf", "{ broken", True)}
    assert all(r.reason == I.NO_OBJECT for r in I.rejected_extractions(spark, f"{tmp_path}/out").collect())


def test_compaction(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/out"

    def batch(n, *rows):
        I.write_batch(spark.createDataFrame(list(rows), EXTRACTIONS), n, out)

    def now():
        return sorted((r.source_span, r.value) for r in I.current_facts(spark, out).collect())

    batch(0, ("/1.pdf", raw(x=1)), ("/2.pdf", raw(y=2)))
    batch(1, ("/1.pdf", raw(x=10)), ("/3.pdf", raw(w=4)))
    want = [("page_1.s.w", 4.0), ("page_1.s.x", 10.0), ("page_1.s.y", 2.0)]
    assert now() == want
    before = I.current_facts(spark, out)
    # a compaction that fails before its manifest changes nothing
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("stop")))
        try:
            I.compact(spark, out)
        except OSError:
            pass
    assert now() == want
    assert I.compact(spark, out) == 1 == I.compact(spark, out)
    assert now() == want and sorted((r.source_span, r.value) for r in before.collect()) == want
    # files of the batches are not read any more
    plan = I.current_facts(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "compacted/1/facts" in plan
    batch(2, ("/2.pdf", raw()), ("/3.pdf", "{ broken"))
    want = [("page_1.s.w", 4.0), ("page_1.s.x", 10.0)]
    assert now() == want
    assert {r.source_path: r.batch_id for r in I.current_documents(spark, out).collect()} == {"/1.pdf": 1, "/2.pdf": 2, "/3.pdf": 1}
    assert I.compact(spark, out) == 2 and now() == want
    assert {r.path: r.open for r in I.rejected_extractions(spark, out).collect()} == {"/3.pdf": True}
