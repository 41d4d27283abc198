"""Fact queries: best rows, latest values, top lists, listings and counts."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, functions as F

from factlake import constants as K
from factlake.functions.text import matches_like
from factlake.operators.ranking import best_first, first_rows, newest_first, tie_order

LOOKUP_COLUMNS = (
    "value",
    "unit",
    "period_type",
    "period_end",
    "source_page",
    "confidence",
)


# --- best rows ----------------------------------------------------------------


def facts_best(facts: DataFrame) -> DataFrame:
    """Best fact per company, metric and variant, with its place `rn` (always 1)."""
    keys = ["company", "metric_key", F.coalesce("metric_variant", F.lit(""))]
    return first_rows(facts, keys, best_first(), rank="rn")


def rows_flat(best: DataFrame) -> DataFrame:
    """Five readable columns of the best facts."""
    return best.select(
        F.col("source_page").alias("page number"),
        F.col("metric_key").alias("metric"),
        F.col("metric_variant").alias("time_period"),
        "value",
        "unit",
    )


def best_sample(
    best: DataFrame, company: str, metric: str, variant: str, limit: int = K.SQL_ROWS
) -> DataFrame:
    """Some best facts whose company, metric and variant contain the given parts."""
    found = best.where(
        matches_like(F.col("company"), company)
        & matches_like(F.col("metric_key"), metric)
        & matches_like(F.col("metric_variant"), variant)
    )
    order = [F.asc("company"), F.asc("metric_key"), F.asc("metric_variant")]
    return (
        found.orderBy(*order)
        .limit(limit)
        .select("company", "metric_key", "metric_variant", "value", "unit")
    )


# --- latest values ------------------------------------------------------------


def latest_metric(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest fact per request; requests(request_id, company, metric_key, prefer_period).

    Facts of the preferred period type come first, else those of any type.
    Only facts of a requested company and metric are ranked, and they shrink to one
    row per company, metric and period type before they meet the requests.
    """
    asked = requests.select("company", "metric_key").distinct()
    wanted = facts.join(asked, ["company", "metric_key"], "left_semi")
    newest = first_rows(wanted, ["company", "metric_key", "period_type"], newest_first())
    matched = requests.join(newest, ["company", "metric_key"])
    preferred = F.coalesce(F.col("period_type") == F.col("prefer_period"), F.lit(False))
    chosen = first_rows(matched, ["request_id"], [F.desc(preferred), *newest_first()])
    return chosen.select("request_id", "company", "metric_key", *LOOKUP_COLUMNS)


def latest_metric_of(
    facts: DataFrame, company: str, metric_key: str, prefer_period: str | None = None
) -> DataFrame:
    """Newest fact of one company and metric; the filter reaches the scan."""
    found = facts.where((F.col("company") == company) & (F.col("metric_key") == metric_key))
    preferred = F.col("period_type") == F.lit(prefer_period)
    return (
        found.orderBy(F.desc(F.coalesce(preferred, F.lit(False))), *newest_first())
        .limit(1)
        .select("company", "metric_key", *LOOKUP_COLUMNS)
    )


def metric_lookup(
    facts: DataFrame, requests: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """latest_metric with a status: ok, uncertain or not_available."""
    latest = latest_metric(facts, requests).drop("company", "metric_key")
    answered = requests.select("request_id", "company", "metric_key").join(latest, "request_id", "left")
    missing, unsure = F.col("value").isNull(), F.col("confidence") < threshold
    return answered.withColumns(
        {
            "status": F.when(missing, "not_available").when(unsure, "uncertain").otherwise("ok"),
            "message": F.when(
                missing, F.format_string(K.MSG_NOT_REPORTED, "metric_key", "company")
            ).when(unsure, K.MSG_LOW_CONFIDENCE),
        }
    )


# --- industries ---------------------------------------------------------------


def _latest_by_company(facts: DataFrame, metric_key: str, prefer_period: str | None) -> DataFrame:
    chosen = facts.where(F.col("metric_key") == metric_key)
    if prefer_period:
        chosen = chosen.where(F.col("period_type") == prefer_period)
    return first_rows(chosen, ["company"], newest_first())


def _industry_members(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.lower("company").alias("company_key"), F.lower("industry").alias("industry_key")
    ).distinct()


def _ranked_by_industry(latest: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    members = latest.withColumn("company_key", F.lower("company")).join(
        _industry_members(entities), "company_key"
    )
    order = [F.desc("value"), F.asc("company"), *tie_order(skip=("value",))]
    top = first_rows(members, ["industry_key"], order, n=k, rank="place")
    return top.select("industry_key", "place", "company", "value", "unit", "period_end")


def _with_industry_status(industries: DataFrame, top: DataFrame, message: Column) -> DataFrame:
    """One row per place, and one row with a message for an industry without any."""
    asked = industries.select("industry", F.lower("industry").alias("industry_key"))
    empty = F.col("place").isNull()
    return (
        asked.join(top, "industry_key", "left")
        .withColumn("status", F.when(empty, "not_available").otherwise("ok"))
        .withColumn("message", F.when(empty, message))
        .drop("industry_key")
    )


def industry_topk(
    facts: DataFrame,
    entities: DataFrame,
    industries: DataFrame,
    metric_key: str,
    k: int = K.INDUSTRY_ROWS,
    prefer_period: str | None = "quarter",
) -> DataFrame:
    """Companies with the highest latest value of a metric, per asked industry.

    industries(industry); names compare without case.
    """
    latest = _latest_by_company(facts, metric_key, prefer_period)
    top = _ranked_by_industry(latest, entities, k)
    message = F.format_string(K.MSG_NO_INDUSTRY_ROWS, F.col("industry"), F.lit(metric_key))
    return _with_industry_status(industries, top, message)


_COMPARE = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "==": operator.eq,
    "!=": operator.ne,
}


def filtered_topk(
    facts: DataFrame,
    entities: DataFrame,
    industries: DataFrame,
    metric_key: str,
    filters: dict[str, tuple[str, float]],
    k: int = K.INDUSTRY_ROWS,
    prefer_period: str | None = "quarter",
) -> DataFrame:
    """industry_topk of the companies whose latest other metrics pass the filters.

    filters maps a metric to (operator, threshold). A company without the metric
    does not pass. All filter metrics are read in one pass over the facts.
    """
    unknown = [op for op, _ in filters.values() if op not in K.FILTER_OPERATORS]
    latest = _latest_by_company(facts, metric_key, prefer_period)
    if unknown:
        nothing = _ranked_by_industry(latest, entities, k).limit(0)
        failed = _with_industry_status(industries, nothing, F.lit(K.MSG_BAD_OPERATOR % unknown[0]))
        return failed.withColumn("status", F.lit("unknown"))
    if filters:
        values = first_rows(
            facts.where(F.col("metric_key").isin(*filters)).withColumn("company_key", F.lower("company")),
            ["company_key", "metric_key"],
            newest_first(),
        )
        passes = [
            F.bool_or((F.col("metric_key") == metric) & _COMPARE[op](F.col("value"), F.lit(float(bound))))
            for metric, (op, bound) in filters.items()
        ]
        condition = passes[0]
        for other in passes[1:]:
            condition = condition & other
        passing = values.groupBy("company_key").agg(condition.alias("passes")).where("passes")
        latest = (
            latest.withColumn("company_key", F.lower("company"))
            .join(passing, "company_key", "left_semi")
            .drop("company_key")
        )
    top = _ranked_by_industry(latest, entities, k)
    return _with_industry_status(industries, top, F.lit(K.MSG_NO_FILTERED_ROWS))


# --- listings and counts ------------------------------------------------------


def _listing_order() -> list[Column]:
    return [
        F.asc("company"),
        F.asc("metric_key"),
        F.asc(F.coalesce("period_end", F.lit(K.OPEN_PERIOD_END))),
        *tie_order(),
    ]


def _snippet() -> Column:
    return F.substring("source_span", 1, K.SNIPPET_CHARS).alias("snippet")


def facts_page(facts: DataFrame, limit: int = K.FACT_PAGE_SIZE, offset: int = 0) -> DataFrame:
    """One page of the fact listing."""
    if not 1 <= limit <= K.FACT_PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {K.FACT_PAGE_MAX} and offset at least 0")
    page = facts.orderBy(*_listing_order()).offset(offset).limit(limit)
    return page.select(
        "company",
        "metric_key",
        "metric_variant",
        "value",
        "unit",
        "period_type",
        "period_end",
        "source_page",
        _snippet(),
        "confidence",
    )


def facts_dump(facts: DataFrame) -> DataFrame:
    """The whole fact listing in order, with fewer columns."""
    return facts.orderBy(*_listing_order()).select(
        "company",
        "metric_key",
        "value",
        "unit",
        "period_type",
        "period_end",
        "source_page",
        _snippet(),
    )


def pages_preview(pages: DataFrame) -> DataFrame:
    """First characters of every page."""
    return pages.select("doc_id", "page_num", F.substring("text", 1, K.PREVIEW_CHARS).alias("preview"))


def metric_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("metric_key").agg(F.count("*").alias("fact_count"))


def ingest_summary(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per document; documents(doc_id, company, status) with status ok, skip or fail."""
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.join(counts, "doc_id", "left").select(
        "doc_id",
        "company",
        "status",
        F.when(F.col("status") == "ok", F.coalesce("n", F.lit(0))).otherwise(0).alias("fact_count"),
    )


def ingest_totals(summary: DataFrame) -> DataFrame:
    """One row of totals over a summary."""
    return summary.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_documents") for s in ("ok", "skip", "fail")],
        F.coalesce(F.sum("fact_count"), F.lit(0)).alias("fact_count"),
    )
