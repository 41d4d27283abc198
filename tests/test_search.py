import random
import re

import pytest

from factlake.operators import search as S
from facts_data import facts


def test_names_containing_like_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abAB. %_") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["x" * 90 + "tail"]
    parts = ["".join(rng.choice("abAB. %_") for _ in range(rng.randint(0, 4))) for _ in range(40)]
    parts += ["x" * 64, "x" * 70 + "TAIL", "x" * 70 + "tain", None]
    got = S.names_containing(
        spark.createDataFrame([(n,) for n in names], "company string"),
        spark.createDataFrame([(p,) for p in parts], "part string"), "company", "part",
    )
    pairs = sorted((r.part, r.company) for r in got.collect())
    assert pairs == sorted({(p, n) for p in parts if p for n in names if p.lower() in n.lower()})


FACT_ROWS = [
    dict(
        doc_id=f"d{i}", company=c, metric_key=m, metric_variant=v, value=float(i), source_page=i % 4,
        source_span=f"page_1.sec_{s}.f", confidence=0.5 + (i % 5) / 10,
    )
    for i, (c, m, v, s) in enumerate(
        (c, m, v, s)
        for c in ("Acme Steel", "ACME Bank", "Zeta")
        for m in ("Revenue", "sales", "ROE", "Ebitda")
        for v in ("FY24A", "Q4FY24", "FY25E", "fy24", None, "FYFY23", "FY98FY99")
        for s in ("q1fy22", "plain")
    )
]
REQUESTS = [
    ("1", "acme", ["Revenue"], "FY24"), ("2", "Zeta", ["ROE", "EBITDA"], None), ("3", None, ["Revenue"], "FY25E"),
    ("4", "acme", ["Sales"], "Q1FY22"), ("5", "", ["roe"], ""), ("6", "nobody", ["roe"], None), ("7", "acme", [], None),
    ("8", "STEEL", ["P/E"], None), ("9", "acme", ["revenue"], "FY24"), ("10", "e", ["Revenue", "Sales"], "FY24A"),
    ("11", "zeta", ["roe"], "FY99"), ("12", "zeta", ["roe"], "FY23"), ("13", None, ["ebitda"], "Q4FY24"),
]


def brute(request, limit):
    _, hint, keys, period = request
    names = {n for k in keys for n in (["revenue", "sales"] if k.lower() == "revenue" else [k.lower()])}
    found = [
        f for f in FACT_ROWS
        if f["metric_key"].lower() in names
        and (not hint or hint.lower() in f["company"].lower())
        and (not period or period.lower() in (f["metric_variant"] or "").lower() or period.lower() in f["source_span"].lower())
    ]
    return [f["doc_id"] for f in sorted(found, key=lambda f: (-f["confidence"], f["source_page"], f["doc_id"]))[:limit]]


@pytest.mark.parametrize("limit", [1, 5, 50])
def test_search_like_brute_force(spark, limit):
    df = facts(spark, *FACT_ROWS)
    asked = spark.createDataFrame(REQUESTS, "request_id string, company_hint string, metric_keys array<string>, period_label string")
    ids = {f["value"]: f["doc_id"] for f in FACT_ROWS}
    expected = {r[0]: brute(r, limit) for r in REQUESTS if brute(r, limit)}
    for result in (
        S.facts_search(df, asked, limit),
        S.facts_search_labelled(df, asked, ["Revenue", "ROE", "EBITDA", "Sales", "P/E"], limit),
    ):
        got = {}
        for r in sorted(result.collect(), key=lambda r: r.place):
            got.setdefault(r.request_id, []).append(ids[r.value])
        assert got == expected
    for _, hint, keys, period in REQUESTS:
        if keys:
            one = S.facts_search_one(df, keys, hint, period, limit).collect()
            assert [ids[r.value] for r in one] == brute(("", hint, keys, period), limit)


def test_facts_that_no_search_asks_for_do_not_move(spark, monkeypatch):
    df = facts(spark, *FACT_ROWS)
    requests = [*REQUESTS, ("14", "acme", [None, "roe"], "FY24"), ("15", None, [None], None)]
    requests += [("16", "zeta", ["ebitda"], "[\\E.|Q"), ("17", None, ["p/e"], "\\Qx\\E")]
    asked = spark.createDataFrame(requests, "request_id string, company_hint string, metric_keys array<string>, period_label string")
    result = S.facts_search(df, asked, 2)
    plan = result._jdf.queryExecution().executedPlan().toString()
    # neither all facts by variant and span, nor facts that name no asked period
    assert not re.search(r"hashpartitioning\(metric#\d+, metric_variant#\d+, source_span#", plan)
    assert plan.count("RLIKE") >= 2
    monkeypatch.setattr(S, "PAIRS", 3)
    many = S.facts_search(df, asked, 2)
    assert "RLIKE" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(result.collect()) == sorted(many.collect())


def test_free_text_period(spark):
    df = facts(spark, *FACT_ROWS)
    requests = [("1", "acme", ["Revenue"], "SEC_pl"), ("2", None, ["roe"], "y2"), ("3", "zeta", ["roe"], "%")]
    asked = spark.createDataFrame(requests, "request_id string, company_hint string, metric_keys array<string>, period_label string")
    ids = {f["value"]: f["doc_id"] for f in FACT_ROWS}
    got = {}
    for r in sorted(S.facts_search(df, asked).collect(), key=lambda r: r.place):
        got.setdefault(r.request_id, []).append(ids[r.value])
    assert got == {r[0]: brute(r, 5) for r in requests if brute(r, 5)}
    with pytest.raises(Exception, match="not a fiscal label"):
        S.facts_search_labelled(df, asked, ["Revenue", "ROE"]).collect()


def test_wildcards_and_backslash(spark):
    df = facts(spark, {"company": "A_b"}, {"company": "Axb"}, {"company": "a\\b"})
    def names(hint):
        return sorted(r.company for r in S.facts_search_one(df, ["revenue"], hint).collect())
    assert names("a_b") == ["A_b", "Axb", "a\\b"]
    assert names("\\b") == ["a\\b"]
    assert names("A%B") == ["A_b", "Axb", "a\\b"]


def test_period_equals(spark):
    df = facts(spark, {"metric_variant": "Q4FY24"}, {"metric_variant": "FY24A"}, {"metric_variant": "TTM"}, {"metric_variant": "TTM2"})
    def found(label):
        return sorted(r.metric_variant for r in df.where(S.period_equals(df.metric_variant, label)).collect())
    assert found("fy24") == ["FY24A", "Q4FY24"] and found("TTM") == ["TTM"]


def test_keyword(spark):
    pages = spark.createDataFrame(
        [("d", i, f"Copper {i}" if i % 2 else "none", "Acme") for i in range(20)] + [("e", 1, "copper", "Other")],
        "doc_id string, page_num int, text string, company string",
    )
    assert [r.page_num for r in S.keyword_search(pages, "acme", "COPPER").collect()] == [1, 3, 5, 7, 9]


def test_keyword_batch_like_single_searches(spark):
    pages = spark.createDataFrame(
        [(f"d{i % 4}", i, f"{'Copper' if i % 3 else 'Zinc'} and {i}", ("Acme", "ACME two", "Beta")[i % 3]) for i in range(60)],
        "doc_id string, page_num int, text string, company string",
    )
    asked = [("1", "acme", "copper"), ("2", "BETA", "zinc"), ("3", "a", "1"), ("4", "two", "ZINC"), ("5", "none", "a"), ("6", "acme", "COPPER")]
    got = {}
    batch = S.keyword_search_batch(pages, spark.createDataFrame(asked, "request_id string, company string, keyword string"))
    for r in sorted(batch.collect(), key=lambda r: r.place):
        got.setdefault(r.request_id, []).append((r.doc_id, r.page_num))
    for request_id, company, keyword in asked:
        assert got.get(request_id, []) == [(r.doc_id, r.page_num) for r in S.keyword_search(pages, company, keyword).collect()]


def test_few_keywords_move_no_texts(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(f"d{i % 4}", i, f"{'Copper' if i % 3 else 'Zinc'} & {i}", ("Acme", "ACME two", "Beta")[i % 3]) for i in range(60)]
        + [("d", 99, None, "Acme")],
        "doc_id string, page_num int, text string, company string",
    )
    asked = [("1", "acme", "copper"), ("2", "BETA", "zinc"), ("3", "a", "1"), ("4", "two", "&"), ("5", "none", "a"),
             ("6", "acme", "COPPER"), ("7", None, "a"), ("8", "acme", None), ("9", "beta", ""), ("10", "", "copper")]
    requests = spark.createDataFrame(asked, "request_id string, company string, keyword string")
    few = S.keyword_search_batch(pages, requests)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(lower(text" not in plan
    assert not any("Exchange" in below and "lowered" in below for below in plan.splitlines())
    for name in ("KEYWORDS", "SEARCHES"):
        with monkeypatch.context() as patch:
            patch.setattr(S, name, 2)
            many = S.keyword_search_batch(pages, requests)
            assert "regexp_extract_all(lower(text" in many._jdf.queryExecution().executedPlan().toString()
            assert sorted(many.collect()) == sorted(few.collect())
    assert {r.request_id for r in few.collect()} == {"1", "3", "4", "6", "9"}
    nothing = S.keyword_search_batch(pages, requests.where("request_id IN ('7', '8')"))
    assert nothing.count() == 0
