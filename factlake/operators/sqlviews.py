"""Ad-hoc SQL over the fact views."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from factlake import constants as K
from factlake.operators.facts import facts_best, rows_flat

REQUIRED_COLUMNS = ("company", "metric_key", "metric_variant", "value", "unit", "source_page")

TOP_BY_METRIC = """
SELECT f.company, f.metric_key, f.metric_variant, f.value, f.unit, f.source_page
FROM v_facts_best f
WHERE lower(f.metric_key) = lower(:metric)
  AND lower(f.company) IN (SELECT lower(company) FROM entities WHERE lower(industry) = lower(:industry))
ORDER BY f.value DESC, f.company, f.metric_variant NULLS LAST
LIMIT 5
"""

METRIC_THRESHOLD = """
SELECT company, max(value) AS best_value, count(*) AS fact_count
FROM v_facts_best
WHERE lower(metric_key) = lower(:metric) AND value > :threshold
GROUP BY company
"""

GROUP_AGGREGATE = """
SELECT company, metric_key, max(metric_variant) AS metric_variant, max(value) AS value,
       min(unit) AS unit, min(source_page) AS source_page, count(*) AS fact_count
FROM v_facts_best
GROUP BY company, metric_key
ORDER BY value DESC, company, metric_key
"""


def register_views(
    facts: DataFrame, entities: DataFrame | None = None, pages: DataFrame | None = None
) -> None:
    """Temporary views for SQL: facts, v_facts_best, v_rows_flat, entities, raw_pages."""
    best = facts_best(facts)
    facts.createOrReplaceTempView("facts")
    best.createOrReplaceTempView("v_facts_best")
    rows_flat(best).createOrReplaceTempView("v_rows_flat")
    if entities is not None:
        entities.createOrReplaceTempView("entities")
    if pages is not None:
        pages.createOrReplaceTempView("raw_pages")


def fact_rows_sql(
    spark: SparkSession, sql: str, args: dict[str, Any] | None = None, limit: int = K.SQL_ROWS
) -> DataFrame:
    """First rows of a query over the views, with the columns an answer needs."""
    rows = spark.sql(sql, args=args or {})
    missing = [c for c in REQUIRED_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"the query must give the columns {', '.join(missing)}")
    return rows.select(*REQUIRED_COLUMNS).limit(limit)


def top_by_metric(spark: SparkSession, industry: str, metric: str) -> DataFrame:
    return fact_rows_sql(spark, TOP_BY_METRIC, {"industry": industry, "metric": metric})


def metric_threshold(spark: SparkSession, metric: str, threshold: float) -> DataFrame:
    return spark.sql(METRIC_THRESHOLD, args={"metric": metric, "threshold": threshold})


def group_aggregate(spark: SparkSession) -> DataFrame:
    return fact_rows_sql(spark, GROUP_AGGREGATE)
