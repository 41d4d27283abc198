"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


DOCUMENTS = _struct(
    ("doc_id", T.StringType(), False),
    ("company", T.StringType(), False),
    ("ticker", T.StringType(), True),
    ("industry", T.StringType(), True),
    ("report_date", T.StringType(), True),
    ("source_path", T.StringType(), False),
    ("page_count", T.IntegerType(), False),
)

FACTS = _struct(
    ("doc_id", T.StringType(), False),
    ("company", T.StringType(), False),
    ("period_type", T.StringType(), False),
    ("period_end", T.StringType(), True),
    ("metric_key", T.StringType(), False),
    ("metric_variant", T.StringType(), True),
    ("value", T.DoubleType(), False),
    ("unit", T.StringType(), False),
    ("source_page", T.IntegerType(), False),
    ("source_span", T.StringType(), True),
    ("confidence", T.DoubleType(), False),
)

RAW_PAGES = _struct(
    ("doc_id", T.StringType(), False),
    ("page_num", T.IntegerType(), False),
    ("text", T.StringType(), False),
    ("company", T.StringType(), True),
    ("source_path", T.StringType(), True),
)

ENTITIES = _struct(
    ("company", T.StringType(), True),
    ("industry", T.StringType(), True),
)

EXTRACTIONS = _struct(
    ("path", T.StringType(), True),
    ("raw", T.StringType(), True),
)

# One fact inside a cached extraction file.
CACHED_FACT = T.StructType(
    [
        FACTS[name]
        for name in (
            "doc_id",
            "company",
            "metric_key",
            "metric_variant",
            "value",
            "unit",
            "period_type",
            "period_end",
            "source_page",
            "source_span",
            "confidence",
        )
    ]
)

EXTRACTION_CACHE = _struct(
    ("doc_id", T.StringType(), True),
    ("company", T.StringType(), True),
    ("page_count", T.IntegerType(), True),
    ("source_path", T.StringType(), True),
    ("facts", T.ArrayType(CACHED_FACT), True),
)

DISCOVERED_FILES = _struct(
    ("path", T.StringType(), False),
    ("length", T.LongType(), True),
    ("modified_at", T.TimestampType(), True),
)

CHUNKS = _struct(
    ("doc_id", T.StringType(), True),
    ("company", T.StringType(), True),
    ("page_num", T.IntegerType(), True),
    ("chunk_idx", T.IntegerType(), True),
    ("source_path", T.StringType(), True),
    ("text", T.StringType(), True),
)

FACT_COLUMNS = FACTS.fieldNames()
