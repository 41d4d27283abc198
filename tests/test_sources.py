import json

import pytest

from factlake import schemas
from factlake.operators import documents, extraction, vectors as V
from factlake.sources import files, tables
from facts_data import facts


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_discover(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "c.txt", "sub/d.pdf", "sub/deep/e.pdf", "sub/report_f.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    root = str(tmp_path)
    assert names(files.discover_files(spark, [root])) == ["a.PDF", "b.pdf"]
    assert names(files.discover_files(spark, [root], recursive=True)) == ["a.PDF", "b.pdf", "d.pdf", "e.pdf", "report_f.pdf"]
    assert names(files.discover_files(spark, [root], glob="report_*.pdf", recursive=True)) == ["report_f.pdf"]
    assert names(files.discover_files(spark, [root, f"{root}/b.pdf", f"{root}/sub/*.pdf"])) == ["a.PDF", "b.pdf", "d.pdf", "report_f.pdf"]
    assert names(files.discover_files(spark, [root], first=1)) == ["a.PDF"]
    assert names(files.discover_files(spark, [f"{root}/none", f"{root}/sub/c*.pdf"])) == []
    row = files.discover_files(spark, [f"{root}/b.pdf"]).first()
    assert row.path == f"{root}/b.pdf" and row.length == 5


def test_cache_files(spark, tmp_path):
    fact = {"doc_id": "x", "company": "Acme", "metric_key": "Roe", "metric_variant": None, "value": 1.5, "unit": "%",
            "period_type": "year", "period_end": None, "source_page": 1, "source_span": "s", "confidence": 0.9}
    payload = {"doc_id": "x", "company": "Acme", "page_count": 2, "source_path": "/a.pdf", "facts": [fact, fact]}
    (tmp_path / "my_report_extracted.json").write_text(json.dumps(payload, indent=2))
    (tmp_path / "other.json").write_text("{}")
    cache = files.read_extraction_cache(spark, str(tmp_path))
    assert [(r.cache_key, r.payload.page_count) for r in cache.collect()] == [("my_report", 2)]
    rows = files.cached_facts(cache)
    assert rows.columns == schemas.FACT_COLUMNS and rows.count() == 2


def test_cache_files_with_odd_names(spark, tmp_path):
    stems = ["my report é", "a%20b", "1+1", "plain"]
    for i, stem in enumerate(stems):
        payload = {"doc_id": str(i), "company": "Acme", "page_count": i, "source_path": f"/in/{stem}.pdf", "facts": []}
        (tmp_path / f"{stem}_extracted.json").write_text(json.dumps(payload))
    cache = files.read_extraction_cache(spark, str(tmp_path))
    assert sorted(r.cache_key for r in cache.collect()) == sorted(stems)
    asked = spark.createDataFrame([(f"/in/{s}.pdf", s == "plain") for s in stems], "path string, force boolean")
    fresh = cache.select(V.F.concat(V.F.lit("/in/"), "cache_key", V.F.lit(".pdf")).alias("path"), "payload")
    merged = documents.cache_merge(asked, cache, fresh).collect()
    assert {r.path: r.from_cache for r in merged} == {f"/in/{s}.pdf": s != "plain" for s in stems}


def test_cache_table(spark, tmp_path):
    raws = [("/in/a.pdf", '{"document_meta":{"company":"Acme"},"page_1":{"s":{"x_pct":1,"y":true}}}'), ("/in/b.pdf", "{}"), ("/in/c.pdf", "-")]
    extractions = spark.createDataFrame(raws, schemas.EXTRACTIONS)
    payloads = extraction.extraction_payloads(extractions)
    got = {r.cache_key: (r.payload.company, r.payload.source_path, len(r.payload.facts)) for r in payloads.collect()}
    assert got == {"a": ("Acme", "/in/a.pdf", 2), "b": ("Unknown", "/in/b.pdf", 0)}
    files.write_extraction_cache(payloads, f"{tmp_path}/cache")
    cache = files.read_extraction_cache_table(spark, f"{tmp_path}/cache")
    rows = files.cached_facts(cache)
    assert sorted(map(str, rows.collect())) == sorted(map(str, extraction.extract_to_facts(extractions).collect()))
    requests = spark.createDataFrame([("/x/a.pdf", False), ("/x/c.pdf", False)], "path string, force boolean")
    assert [r.path for r in documents.cache_misses(requests, cache).collect()] == ["/x/c.pdf"]


def test_append_pages(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d", "1", "t", "c", "/p"), ("d", "x", "t", "c", "/p"), ("d", "2", None, "c", "/p")],
        ", ".join(f"{n} string" for n in schemas.RAW_PAGES.fieldNames()),
    )
    tables.append_pages(rows, f"{tmp_path}/p")
    assert [r.page_num for r in tables.stored_pages(spark, f"{tmp_path}/p").collect()] == [1]
    reasons = sorted(r.reject_reason for r in tables.rejected_pages(spark, f"{tmp_path}/p").collect())
    assert reasons == ["page_num is missing", "text is missing"]


def test_entities(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Company, INDUSTRY,Ticker\nAcme,Banks,A\n")
    assert files.read_entities(spark, str(tmp_path / "e.csv")).first().asDict()["industry"] == "Banks"
    files.read_entities(spark, str(tmp_path / "e.csv"), view="entities_of_test")
    assert spark.table("entities_of_test").count() == 1
    (tmp_path / "bad.csv").write_text("name\nAcme\n")
    with pytest.raises(ValueError, match="company, industry"):
        files.read_entities(spark, str(tmp_path / "bad.csv"))


def test_append(spark, tmp_path):
    rows = facts(spark, {"value": 1.0}, {"value": 2.0, "confidence": 2.0}, {"value": 3.0, "period_type": "year"})
    for _ in range(2):
        tables.append_facts(rows, f"{tmp_path}/f")
    stored = tables.stored_facts(spark, f"{tmp_path}/f")
    assert sorted(r.value for r in stored.collect()) == [1.0, 1.0, 3.0, 3.0]
    assert stored.columns == schemas.FACT_COLUMNS
    assert tables.rejected_facts(spark, f"{tmp_path}/f").count() == 2


def test_a_lookup_reads_few_files(spark, tmp_path):
    rows = facts(spark, *[{"metric_key": f"m{i % 20}", "company": f"c{i % 7}", "doc_id": f"d{i}", "value": float(i)} for i in range(2800)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # every task holds every metric
        tables.append_facts(rows.repartition(8), f"{tmp_path}/f")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import pyarrow.parquet as pq

    found = []
    for path in (tmp_path / "f").rglob("*.parquet"):
        held = pq.ParquetFile(path)
        names = held.schema_arrow.names
        for g in range(held.num_row_groups):
            stats = [held.metadata.row_group(g).column(names.index(c)).statistics for c in ("metric_key", "company")]
            found.append(all(s.min <= v <= s.max for s, v in zip(stats, ("m7", "c3"))))
    assert len(found) >= 8 and 1 <= sum(found) <= 3


def test_rows_per_file(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/in/a b+c%20d")
    spark.range(5).selectExpr("CAST(id AS STRING) AS other").repartition(2).write.parquet(f"{tmp_path}/in/x")
    found = files.discover_files(spark, [f"{tmp_path}/in"], suffix="parquet", recursive=True)
    got = files.rows_per_file(found, [f"{tmp_path}/in"])
    assert sum(r.rows for r in got.collect()) == 12 and got.columns == [*found.columns, "rows"]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_export(spark, tmp_path, kind):
    spec = "company string, metric_key string, page int, value double"
    one = spark.createDataFrame([("B", "m", 1, 1.0), ("A", "m", 2, 2.0)], spec)
    two = spark.createDataFrame([("A", "m", 2, 3.0), ("A", "m", 1, 4.0)], spec)
    ordered = tables.export_rows([one, two], f"{tmp_path}/out", kind)
    assert [r.value for r in ordered.collect()] == [4.0, 3.0, 2.0, 1.0]
    reader = spark.read.schema(spec).option("header", "true")
    assert sorted(r.value for r in getattr(reader, kind)(f"{tmp_path}/out").collect()) == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        tables.export_rows([one], f"{tmp_path}/x", "xls")


def test_export_tasks_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "EXPORT_ROWS", 100, raising=False)
    rows = spark.range(4000).selectExpr(
        "concat('c', id % 7) AS company", "'m' AS metric_key", "CAST(id % 3 AS INT) AS page", "CAST(id * 37 % 4000 AS DOUBLE) AS value"
    )
    tables.export_rows([rows], f"{tmp_path}/out")
    found = [
        [line.split(",") for line in file.read_text().splitlines()[1:]] for file in sorted((tmp_path / "out").glob("part-*"))
    ]
    assert max(map(len, found)) <= 300
    keys = [(r[0], r[1], int(r[2]), -float(r[3])) for part in found for r in part]
    assert len(keys) == 4000 and keys == sorted(keys)


def test_index(spark, tmp_path):
    pages = spark.createDataFrame(
        [("d", "Acme", 1, "/p", "copper prices rose sharply in the last quarter of the year"),
         ("d", "Acme", 2, "/p", "the bank reported lower provisions for bad loans this time")],
        "doc_id string, company string, page_num int, source_path string, text string",
    )
    manifest = tables.build_index(pages, f"{tmp_path}/i").first()
    assert (manifest["count"], manifest.dim, manifest.embed_model) == (2, 19, "terms") and manifest.built_at
    index = tables.read_index(spark, f"{tmp_path}/i/chunks")
    q = spark.createDataFrame([(1, "provisions for bad loans")], "question_id int, text string")
    assert V.search_terms(index, q, k=1).first().page_num == 2
    assert V.search_terms(index, q, k=1, lists=tables.read_lists(spark, f"{tmp_path}/i")).first().page_num == 2
    scaled = tables.build_index(
        pages, f"{tmp_path}/j", embed=lambda df: df.withColumn("embedding", V.F.array(V.F.lit(3.0), V.F.lit(4.0))),
        embed_model="two", is_unit=False,
    ).first()
    assert (scaled["count"], scaled.dim) == (2, 2)
    first = tables.read_index(spark, f"{tmp_path}/j/chunks").first().embedding
    assert [round(x, 6) for x in first] == [0.6, 0.8]
    with pytest.raises(ValueError, match="no text to index"):
        tables.build_index(pages.limit(0), f"{tmp_path}/k")
    with pytest.raises(FileNotFoundError):
        tables.read_index(spark, f"{tmp_path}/none")
