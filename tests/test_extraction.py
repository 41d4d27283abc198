import json
import math

import pytest

from factlake.functions import metrics as M
from factlake.operators import extraction as E


def frame(spark, *raws):
    return spark.createDataFrame([(f"/in/{i}.pdf", raw) for i, raw in enumerate(raws)], "path string, raw string")


def fact_values(spark, fields, section="s", page="page_1", meta=None):
    body = {page: {section: fields}} | ({"document_meta": meta} if meta else {})
    return {r.source_span.split(".", 2)[2]: r for r in E.extract_to_facts(frame(spark, json.dumps(body))).collect()}


def test_parse_forms(spark):
    raws = [
        '{"a":1}',
        '```json\n{"a":1}\n```',
        '  ```\n{"a":1}```  ',
        'Here: {"a":1} done',
        "no object",
        "[1, 2]",
        '[{"a":1}]',
        '"text"',
        '{"a":1,"a":2}',
        "",
        None,
        '{"a": {"b": 1}',
    ]
    rows = E.parse_extraction(frame(spark, *raws)).selectExpr(
        "path", "parse_status", "try_variant_get(doc, '$.a', 'int') AS a"
    )
    got = {int(r.path[4:-4]): (r.parse_status, r.a) for r in rows.collect()}
    good = {0: 1, 1: 1, 2: 1, 3: 1, 8: 2}
    for i in range(len(raws)):
        assert got[i] == (("ok", good[i]) if i in good else ("fail", None)), raws[i]


def test_values_kept_and_dropped(spark):
    found = fact_values(
        spark,
        {
            "t": True, "f": False, "int": 3, "dec": 1.25, "text": "12.5", "pad": " 12 ", "group": "1_000",
            "suffix": "1.0d", "comma": "1,2", "word": "n/a", "none": None, "list": [1], "obj": {"x": 1},
            "nan": "nan", "exp": "-1e3", "dot": ".5", "trail": "5.", "under": "_1", "hex": "0x1",
        },
    )
    values = {k: r.value for k, r in found.items()}
    assert math.isnan(values.pop("nan"))
    assert values == {
        "t": 1.0, "f": 0.0, "int": 3.0, "dec": 1.25, "text": 12.5, "pad": 12.0, "group": 1000.0,
        "exp": -1000.0, "dot": 0.5, "trail": 5.0,
    }


def test_only_objects_are_walked(spark):
    raw = json.dumps({"page_1": [1], "page_2": {"s": 5, "t": {"v": 1}}, "page_4": {"s": {"v": 1}}, "page_3": "x"})
    rows = E.extract_to_facts(frame(spark, raw)).collect()
    assert [(r.source_page, r.source_span) for r in rows] == [(2, "page_2.t.v")]


def test_fact_columns(spark):
    found = fact_values(
        spark, {"ebitda_growth_yoy_pct": 1, "margins_change_bps": 2, "net_debt": 3},
        section="narrative_highlights_q4fy24", meta={"company": " Acme ", "unit_hint": "INR Million"},
    )
    r = found["ebitda_growth_yoy_pct"]
    assert (r.company, r.metric_key, r.unit, r.metric_variant, r.period_type, r.confidence, r.period_end) == (
        "Acme", "Ebitda Growth Yoy", "%", "Q4FY24", "quarter", 0.72, None,
    )
    assert found["margins_change_bps"].unit == "mn" and found["margins_change_bps"].metric_key == "Margins Change Bps"
    assert len(r.doc_id) == 40


@pytest.mark.parametrize(
    "section, field, label, kind",
    [
        ("quarterly_q4fy24_cr", "revenue", "Q4FY24", "quarter"),
        ("ratios_fy24a", "roe_pct", "FY24A", "year"),
        ("changes", "fy25e_margin_bps", "FY25E", "estimate"),
        ("cash_fy24_cr", "fy25e_x", "FY24", "year"),
        ("general", "cmp_rs", None, "snapshot"),
        ("x_q12fy24", "y", "Q12FY24", "quarter"),
    ],
)
def test_period(spark, section, field, label, kind):
    df = spark.createDataFrame([(section, field)], "s string, f string")
    got = df.select(M.period_label(df.s, df.f).alias("l")).selectExpr("l")
    assert got.first().l == label
    assert got.select(M.period_type(got.l).alias("k")).first().k == kind


def test_units(spark):
    rows = [
        ("a_pct", "crore", "%"), ("a_x", None, "x"), ("a_rs", "mn", "Rs"), ("a_days", "", "days"), ("a_tonne", "bn", "tonne"),
        ("a", "Rs Crore", "cr"), ("a", "USD million", "mn"), ("a", "MN", "mn"), ("a", "Billion", "bn"), ("a", "lacs", "lacs"),
        ("a", "", "cr"), ("a", None, "cr"), ("a_bps", "bn", "bn"),
    ]
    df = spark.createDataFrame(rows, "f string, h string, u string")
    for r in df.select("f", "h", "u", M.normalize_unit(df.f, df.h).alias("got")).collect():
        assert r.got == r.u, r


def test_human_names(values):
    names = ["avg_6m_volume_lacs", "absolute_1y", "ebitda_growth_yoy_pct", "sotp_rs_per_share", "sales_cr", "a-b__c", "EPS_RS"]
    assert values(M.humanize_metric, names) == [
        "Avg 6M Volume Lacs", "Absolute 1Y", "Ebitda Growth Yoy", "Sotp Rs Per Share", "Sales", "A B C", "Eps",
    ]


def test_confidence(values):
    sections = ["quarterly_financials_q4", "sotp_valuation_x", "narrative_y", "general_market_data", "shareholding_z", "price"]
    assert values(M.section_confidence, sections) == [0.88, 0.88, 0.72, 0.78, 0.78, 0.75]


def test_canonical_metric(values):
    names = ["Total Sales", "Operating Profit", "Reported PAT", "Patents", "Adj EPS", "MCap (cr)", "Beta"]
    got = values(M.canonical_metric, names)
    assert [(r.metric_key, r.score) for r in got] == [
        ("revenue", 1.0), ("ebitda", 1.0), ("pat", 1.0), ("pat", 1.0), ("eps", 1.0), ("market cap", 1.0), ("Beta", 0.0),
    ]


def test_company_and_pages(spark):
    raws = [
        '{"document_meta":{"company":""},"page_1":{},"page_2":3}',
        '{"document_meta":{"company":"  "},"page_1":{},"page_4":{},"page_6":{}}',
        "{}",
    ]
    df = E.describe(E.parse_extraction(frame(spark, *raws)), hint=E.F.lit("Hint"))
    got = {r.path: (r.company, r.page_count) for r in df.collect()}
    assert got == {"/in/0.pdf": ("Hint", 1), "/in/1.pdf": ("", 2), "/in/2.pdf": ("Hint", 1)}


def test_fields_provenance_notices(spark):
    raw = json.dumps(
        {
            "document_meta": {"company": "A", "report_period": "Q1"},
            "page_1": {"s": {"a": 900.00, "b": None, "c": ["x"], "d": "t"}},
            "provenance": [{"metric": "a", "page": 2, "quote": "q" * 200}, {"metric": "b"}],
            "missing": ["m1", "m2"], "warnings": ["w"],
        }
    )
    parsed = E.parse_extraction(frame(spark, raw))
    fields = {r.field: (r.section, r.value, r.company, r.report_period) for r in E.flatten_fields(parsed).collect()}
    assert fields == {
        "a": ("page_1.s", "900.0", "A", "Q1"), "b": ("page_1.s", None, "A", "Q1"),
        "c": ("page_1.s", '["x"]', "A", "Q1"), "d": ("page_1.s", "t", "A", "Q1"),
    }
    rows = [(r.metric, r.page, r.quote) for r in E.provenance_rows(parsed).collect()]
    assert rows == [("a", "2", "q" * 140), ("b", None, None)]
    assert sorted((r.kind, r.entry) for r in E.notice_rows(parsed).collect()) == [
        ("missing", "m1"), ("missing", "m2"), ("warnings", "w"),
    ]
