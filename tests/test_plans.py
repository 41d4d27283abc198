"""Physical plans: what reaches the scan, what is shuffled, what is broadcast."""

import re

import pytest

from factlake import constants as K, schemas
from factlake.operators import conversations, documents, extraction, facts as O, search, vectors
from facts_data import facts


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts"))
    facts(spark, *[{"value": float(i), "company": f"C{i}"} for i in range(50)]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def whole_texts(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_shrink_before_the_shuffle(stored):
    text = plan(O.facts_best(stored))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = plan(O.latest_metric_of(stored, "C1", "Revenue"))
    assert "EqualTo(company,C1)" in text and "EqualTo(metric_key,Revenue)" in text
    assert "TakeOrderedAndProject" in text and "Window" not in text
    counted = plan(O.metric_counts(stored))
    assert "ReadSchema: struct<metric_key:string>" in counted and "partial_count" in counted
    industry = plan(
        O.industry_topk(stored, spark.createDataFrame([("a", "b")], schemas.ENTITIES), spark.createDataFrame([("b",)], "industry string"), "Revenue")
    )
    assert "EqualTo(metric_key,Revenue)" in industry and "EqualTo(period_type,quarter)" in industry


def test_extraction_does_not_shuffle(spark):
    text = plan(extraction.extract_to_facts(spark.createDataFrame([("p", "{}")], schemas.EXTRACTIONS)))
    assert "Exchange" not in text and "Python" not in text


def test_no_cross_joins(spark, stored):
    asked = spark.createDataFrame([("1", "c", ["Revenue"], "FY24")], "request_id string, company_hint string, metric_keys array<string>, period_label string")
    for df in (search.facts_search(stored, asked), search.facts_search_labelled(stored, asked, ["Revenue"])):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_bounded_sides_are_broadcast_by_hint(spark, stored):
    asked = spark.createDataFrame([("1", "c", ["Revenue"], "FY24")], "request_id string, company_hint string, metric_keys array<string>, period_label string")

    def broadcast_keys(df):
        joins = [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line]
        assert all("LeftSemi" in line for line in joins)
        return {re.sub(r"#\d+", "", re.search(r"BroadcastHashJoin \[([^]]*)\]", line).group(1)) for line in joins}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcast_keys(search.facts_search_labelled(stored, asked, ["Revenue"])) == {"metric, period", "__length"}
        assert broadcast_keys(search.facts_search(stored, asked)) == {"__length"}
        assert "BroadcastExchange" not in plan(documents.facts_replace_by_doc(stored, stored.select("doc_id"), stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_pages_do_not_meet_in_one_window(spark):
    pages = spark.createDataFrame([("d", 1, "t")], "doc_id string, page_num int, text string")
    assert "Window" not in plan(documents.drop_last_page(pages))


def test_context_is_cut_before_the_shuffle(spark):
    talk = spark.createDataFrame([(1, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    text = plan(conversations.chat_context(talk))
    assert "WindowGroupLimit" in text and f"{K.CONTEXT_CHARS}" in text


def test_vectors_move_once_and_without_payload(spark, tmp_path):
    rows = [(i, [1.0, float(i)], "text") for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, text string").write.parquet(f"{tmp_path}/v")
    index = spark.read.parquet(f"{tmp_path}/v")
    asked = index.selectExpr("vec_id AS query_id", "embedding AS query_vector")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(vectors.knn_cosine(index, asked, payload=("text",)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [line for line in text.splitlines() if "Exchange" in line and "__block" in line]
    assert len(scan) == 1
    below = text[text.index(scan[0]):text.index("FileScan", text.index(scan[0]))]
    assert "text" not in below and "Broadcast" not in text
