"""Sides whose size Spark reads off a small file, though the query makes them large, are not broadcast."""

from factlake import schemas
from factlake.operators import documents, extraction

RAW = '{"document_meta":{"company":"A"},"page_1":{"annual_fy24a":{"sales_cr":1}}}'


def test_cache_payloads_join_nothing(spark):
    rows = spark.createDataFrame([("/a.pdf", RAW), ("/a.pdf", RAW), ("/b.pdf", '{"page_1":{}}'), ("/c.pdf", "x")], schemas.EXTRACTIONS)
    payloads = extraction.extraction_payloads(rows)
    plan = payloads._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    # every copy of a document has the facts of all of them
    got = sorted((r.cache_key, len(r.payload.facts)) for r in payloads.collect())
    assert got == [("a", 2), ("a", 2), ("b", 0)]


def test_merged_payloads_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MERGE_BYTES", 1000, raising=False)
    spark.range(100).selectExpr("concat('/d', id, '/f', id % 40, '.pdf') AS path", "repeat('x', 400) AS payload").write.parquet(f"{tmp_path}/f")
    fresh = spark.read.parquet(f"{tmp_path}/f")
    requests = fresh.selectExpr("path", "path LIKE '%7.pdf' AS force")
    cache = fresh.limit(0).selectExpr("path AS cache_key", "payload").union(spark.createDataFrame([("f1", "old"), ("f7", "old")]))
    merged = documents.cache_merge(requests, cache, fresh)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(path" in plan
    assert merged.rdd.getNumPartitions() == 40
    got = {r.path: r.payload for r in merged.collect()}
    assert len(got) == 100 and {p for p, payload in got.items() if payload == "old"} == {f"/d{i}/f1.pdf" for i in (1, 41, 81)}
