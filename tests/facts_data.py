"""Small fact tables for tests."""

from factlake.schemas import FACTS

DEFAULTS = {
    "doc_id": "d",
    "company": "Acme",
    "period_type": "quarter",
    "period_end": None,
    "metric_key": "Revenue",
    "metric_variant": "Q1FY24",
    "value": 1.0,
    "unit": "cr",
    "source_page": 1,
    "source_span": "page_1.sec.field",
    "confidence": 0.9,
}


def facts(spark, *rows):
    return spark.createDataFrame([tuple({**DEFAULTS, **row}[n] for n in FACTS.fieldNames()) for row in rows], FACTS)
