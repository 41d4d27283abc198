import math

import pytest

from factlake.operators import facts as O, sqlviews
from factlake.schemas import ENTITIES
from facts_data import facts


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), ENTITIES)


def industries(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "industry string")


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id string, company string, metric_key string, prefer_period string")


def test_best_is_unique_and_ordered(spark):
    df = facts(
        spark,
        {"confidence": 0.5, "value": 1.0}, {"confidence": 0.9, "source_page": 2, "value": 2.0},
        {"confidence": 0.9, "source_page": 1, "value": 3.0}, {"metric_variant": None, "value": 4.0},
        {"metric_variant": "", "value": 5.0, "confidence": 0.95}, {"company": "acme", "value": 6.0},
    )
    best = O.facts_best(df)
    assert sorted((r.company, r.value, r.rn) for r in best.collect()) == [("Acme", 3.0, 1), ("Acme", 5.0, 1), ("acme", 6.0, 1)]
    assert O.rows_flat(best).columns == ["page number", "metric", "time_period", "value", "unit"]


def test_latest_prefers_then_falls_back(spark):
    df = facts(
        spark,
        {"period_type": "year", "period_end": "2024-03-31", "value": 1.0},
        {"period_type": "year", "period_end": "2023-03-31", "value": 2.0},
        {"period_type": "quarter", "period_end": "2022-03-31", "value": 3.0},
        {"company": "Open", "period_end": None, "value": 4.0},
        {"company": "Open", "period_end": "2030-01-01", "value": 5.0},
        {"company": "Tie", "value": 6.0, "confidence": 0.7}, {"company": "Tie", "value": 7.0, "confidence": 0.8},
    )
    asked = requests(
        spark,
        ("any", "Acme", "Revenue", None), ("quarter", "Acme", "Revenue", "quarter"), ("asof", "Acme", "Revenue", "asof"),
        ("open", "Open", "Revenue", None), ("tie", "Tie", "Revenue", None), ("case", "acme", "Revenue", None),
        ("other", "Acme", "Ebitda", None),
    )
    got = {r.request_id: r.value for r in O.latest_metric(df, asked).collect()}
    assert got == {"any": 1.0, "quarter": 3.0, "asof": 1.0, "open": 4.0, "tie": 7.0}
    for r in asked.collect():
        one = O.latest_metric_of(df, r.company, r.metric_key, r.prefer_period).collect()
        assert [x.value for x in one] == ([got[r.request_id]] if r.request_id in got else [])


def test_lookup_status(spark):
    df = facts(spark, {"confidence": 0.69}, {"company": "B", "confidence": 0.70})
    asked = requests(spark, ("1", "Acme", "Revenue", None), ("2", "B", "Revenue", None), ("3", "C", "Roe", None))
    got = {r.request_id: (r.status, r.message) for r in O.metric_lookup(df, asked).collect()}
    assert got["2"] == ("ok", None)
    assert got["1"][0] == "uncertain" and got["1"][1].startswith("Low-confidence")
    assert got["3"] == ("not_available", "Metric 'Roe' not reported for 'C'.")


def test_industry_topk(spark):
    df = facts(
        spark,
        {"company": "A", "value": 1.0}, {"company": "B", "value": 3.0}, {"company": "C", "value": 2.0},
        {"company": "D", "value": math.nan}, {"company": "E", "value": 9.0, "period_type": "year"},
        {"company": "F", "value": 8.0, "metric_key": "Roe"},
    )
    known = entities(
        spark, ("a", "Banks"), ("A", "banks"), ("b", "BANKS"), ("C", "Banks"), ("C", "Metals"), ("D", "Metals"),
        ("E", "Banks"), ("F", "Banks"), (None, "Banks"),
    )
    rows = O.industry_topk(df, known, industries(spark, "banks", "Metals", "Oil"), "Revenue", k=2).collect()
    got = sorted((r.industry, r.place or 0, r.company, r.status) for r in rows)
    assert got == [
        ("Metals", 1, "D", "ok"), ("Metals", 2, "C", "ok"), ("Oil", 0, None, "not_available"),
        ("banks", 1, "B", "ok"), ("banks", 2, "C", "ok"),
    ]
    every = O.industry_topk(df, known, industries(spark, "Banks"), "Revenue", k=9, prefer_period=None).collect()
    assert [r.company for r in sorted(every, key=lambda r: r.place)] == ["E", "B", "C", "A"]


def test_filtered_topk(spark):
    df = facts(
        spark,
        {"company": "A", "value": 5.0}, {"company": "B", "value": 4.0}, {"company": "C", "value": 3.0},
        {"company": "a", "metric_key": "Cap", "value": 10.0}, {"company": "B", "metric_key": "Cap", "value": 99.0},
        {"company": "B", "metric_key": "Cap", "value": 20.0, "period_end": "2020-01-01"},
        {"company": "A", "metric_key": "Roe", "value": 1.0}, {"company": "B", "metric_key": "Roe", "value": 1.0},
    )
    known = entities(spark, ("A", "X"), ("B", "X"), ("C", "X"), ("A", "Y"))

    def names(filters, **options):
        rows = O.filtered_topk(df, known, industries(spark, "X"), "Revenue", filters, **options).collect()
        return [r.company for r in sorted(rows, key=lambda r: r.place or 0)]

    assert names({"Cap": (">=", 10)}) == ["A", "B"]
    assert names({"Cap": (">", 50)}) == ["B"]
    assert names({"Cap": ("!=", 10), "Roe": ("==", 1)}) == ["B"]
    assert names({"Cap": ("<", 1)}) == [None]
    assert names({}) == ["A", "B", "C"]
    bad = O.filtered_topk(df, known, industries(spark, "X"), "Revenue", {"Cap": ("~", 1)}).collect()
    assert [(r.status, r.message) for r in bad] == [("unknown", "Unsupported operator '~' in filters.")]


def test_listing(spark):
    df = facts(spark, *[{"company": f"C{i % 3}", "value": float(i), "period_end": None if i % 2 else "2024-01-01"} for i in range(30)])
    dump = [(r.company, r.period_end, r.value) for r in O.facts_dump(df).collect()]
    assert dump == sorted(dump, key=lambda r: (r[0], r[1] or "9999-12-31", r[2]))
    page = O.facts_page(df, limit=7, offset=11).collect()
    assert [(r.company, r.period_end, r.value) for r in page] == dump[11:18]
    for limit, offset in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            O.facts_page(df, limit, offset)


def test_deep_pages_do_not_gather_on_the_driver(spark):
    df = facts(spark, *[{"value": float(i), "source_page": i} for i in range(20)])
    spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", "5")
    try:
        assert [r.source_page for r in O.facts_page(df, limit=4, offset=10).collect()] == [10, 11, 12, 13]
    finally:
        spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", "100000")


def test_summary(spark):
    docs = spark.createDataFrame([("1", "A", "ok"), ("2", "B", "skip"), ("3", "C", "fail"), ("4", "D", "ok")], "doc_id string, company string, status string")
    summary = O.ingest_summary(docs, facts(spark, {"doc_id": "1"}, {"doc_id": "1"}, {"doc_id": "2"}))
    assert sorted((r.doc_id, r.fact_count) for r in summary.collect()) == [("1", 2), ("2", 0), ("3", 0), ("4", 0)]
    assert tuple(O.ingest_totals(summary).first()) == (2, 1, 1, 2)
    assert tuple(O.ingest_totals(summary.limit(0)).first()) == (0, 0, 0, 0)


def test_sql_views(spark):
    df = facts(spark, {"value": 5.0}, {"company": "B", "value": 7.0}, {"company": "B", "value": 1.0, "confidence": 0.1})
    sqlviews.register_views(df, entities(spark, ("acme", "X"), ("b", "x")))
    assert [r.company for r in sqlviews.top_by_metric(spark, "X", "revenue").collect()] == ["B", "Acme"]
    assert [(r.company, r.best_value) for r in sqlviews.metric_threshold(spark, "Revenue", 6.0).collect()] == [("B", 7.0)]
    assert spark.table("v_rows_flat").count() == 2
    with pytest.raises(ValueError):
        sqlviews.fact_rows_sql(spark, "SELECT company FROM facts")
