"""Raw extraction text to typed facts. Projections and generators only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factlake import constants as K, schemas
from factlake.functions import metrics as M
from factlake.functions.text import float_text, strip_space
from factlake.operators.documents import doc_id, file_stem

# Text around the JSON object.
FENCE_PATTERN = r"(?si)^```(?:json)?\s*(.*?)\s*```$"
OBJECT_PATTERN = r"(?s)(\{.*\})"


def parse_extraction(extractions: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `doc` (a VARIANT object, NULL if there is none) and `parse_status`.

    An enclosing fence is removed; if the text is no JSON as it stands, the part
    from the first { to the last } is tried.
    """
    text = F.col("__body")
    fenced = F.startswith(text, F.lit("```"))
    unfenced = F.when(fenced, strip_space(F.regexp_replace(text, FENCE_PATTERN, "$1"))).otherwise(text)
    prepared = extractions.withColumn("__body", strip_space(F.col(raw))).withColumn("__body", unfenced)
    is_object = F.startswith("__body", F.lit("{"))
    whole = F.try_parse_json(F.when(is_object, F.col("__body")))
    other = F.try_parse_json(F.when(~is_object, F.col("__body")))
    inner = F.try_parse_json(F.regexp_extract("__body", OBJECT_PATTERN, 1))
    # text that is valid JSON but no object has no facts, whatever it contains
    return (
        prepared.withColumn("doc", F.coalesce(whole, F.when(other.isNull(), inner)))
        .withColumn("parse_status", F.when(F.col("doc").isNull(), "fail").otherwise("ok"))
        .drop("__body")
    )


def resolve_company(doc: Column, hint: Column | None = None) -> Column:
    """Company named in the document, else the hint, else "Unknown"."""
    named = F.try_variant_get(doc, "$.document_meta.company", "string")
    given = hint if hint is not None else F.lit(None).cast("string")
    return F.coalesce(
        strip_space(F.nullif(named, F.lit(""))), F.nullif(given, F.lit("")), F.lit(K.UNKNOWN_COMPANY)
    )


def page_count(doc: Column) -> Column:
    """Number of page objects present, at least 1."""
    present = [
        F.try_variant_get(doc, f"$.{page}", "map<string, variant>").isNotNull().cast("int")
        for page in K.COUNTED_PAGES
    ]
    return F.greatest(sum(present[1:], present[0]), F.lit(1))


def section_fields(parsed: DataFrame) -> DataFrame:
    """One row per page, section and field: page, source_page, section, field, content.

    Pages and sections that are no objects give no rows.
    """
    others = [F.col(c) for c in parsed.columns if c != "doc"]
    pages = F.array(
        *[
            F.struct(
                F.lit(page).alias("page"),
                F.lit(number).alias("source_page"),
                F.try_variant_get("doc", f"$.{page}", "map<string, variant>").alias("sections"),
            )
            for page, number in K.FACT_PAGES.items()
        ]
    )
    by_page = parsed.select(*others, F.explode(pages).alias("p"))
    by_section = by_page.select(
        *others, "p.page", "p.source_page", F.explode("p.sections").alias("section", "__section")
    )
    fields = F.try_variant_get("__section", "$", "map<string, variant>")
    return by_section.select(
        *others, "page", "source_page", "section", F.explode(fields).alias("field", "content")
    )


def flatten_facts(parsed: DataFrame) -> DataFrame:
    """Facts of parsed extractions: parsed(doc_id, company, unit_hint, doc).

    A field gives a fact if its content is a number, a boolean or text written
    as a number.
    """
    kind, written = F.col("__kind"), F.col("__text")
    value = (
        F.when(kind == "STRING", M.number_from_text(written))
        .when(kind == "BOOLEAN", F.when(written == "true", 1.0).otherwise(0.0))
        .otherwise(F.try_variant_get("content", "$", "double"))
    )
    typed = (
        section_fields(parsed)
        .withColumn("__kind", F.schema_of_variant("content"))
        .withColumn("__text", F.try_variant_get("content", "$", "string"))
        .withColumn("value", value)
        .where(F.col("value").isNotNull())
        .withColumn("metric_variant", M.period_label(F.col("section"), F.col("field")))
    )
    return typed.select(
        "doc_id",
        "company",
        M.period_type(F.col("metric_variant")).alias("period_type"),
        F.lit(None).cast("string").alias("period_end"),
        M.humanize_metric(F.col("field")).alias("metric_key"),
        "metric_variant",
        "value",
        M.normalize_unit(F.col("field"), F.col("unit_hint")).alias("unit"),
        "source_page",
        F.concat_ws(".", "page", "section", "field").alias("source_span"),
        M.section_confidence(F.col("section")).alias("confidence"),
    )


def describe(parsed: DataFrame, path: str = "path", hint: Column | None = None) -> DataFrame:
    """Add doc_id, company, unit_hint and page_count to parsed extractions."""
    return parsed.select(
        "*",
        doc_id(F.col(path)).alias("doc_id"),
        resolve_company(F.col("doc"), hint).alias("company"),
        F.try_variant_get("doc", "$.document_meta.unit_hint", "string").alias("unit_hint"),
        page_count(F.col("doc")).alias("page_count"),
    )


def extract_to_facts(extractions: DataFrame, company_hint: str | None = None) -> DataFrame:
    """extractions(path, raw) to facts; texts without a JSON object give none."""
    hint = F.col(company_hint) if company_hint else None
    described = describe(parse_extraction(extractions), hint=hint)
    return flatten_facts(described.select("doc_id", "company", "unit_hint", "doc"))


def document_rows(described: DataFrame) -> DataFrame:
    """Document rows of the described extractions that could be read."""
    return described.where(F.col("doc").isNotNull()).select(
        "doc_id",
        "company",
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("string").alias("industry"),
        F.try_variant_get("doc", "$.document_meta.report_date", "string").alias("report_date"),
        F.col("path").alias("source_path"),
        "page_count",
    )


def extraction_documents(extractions: DataFrame, company_hint: str | None = None) -> DataFrame:
    """extractions(path, raw) to documents."""
    hint = F.col(company_hint) if company_hint else None
    return document_rows(describe(parse_extraction(extractions), hint=hint))


def extraction_payloads(extractions: DataFrame, company_hint: str | None = None) -> DataFrame:
    """What the extraction cache keeps per document: cache_key and payload with its facts.

    The facts of one document come from one text, so a group is as small as that.
    """
    hint = F.col(company_hint) if company_hint else None
    described = describe(parse_extraction(extractions), hint=hint)
    facts = flatten_facts(described.select("doc_id", "company", "unit_hint", "doc"))
    cached = F.struct(*[F.col(name) for name in schemas.CACHED_FACT.fieldNames()])
    about = F.struct("company", "page_count", "source_path")
    documents = document_rows(described).select("doc_id", about.alias("document"), F.lit(None).alias("fact"))
    # one grouping in place of a join: Spark would size the sides by the input's file and broadcast them
    both = documents.unionByName(facts.select("doc_id", F.lit(None).alias("document"), cached.alias("fact")))
    grouped = both.groupBy("doc_id").agg(
        F.collect_list("document").alias("documents"), F.array_sort(F.collect_list("fact")).alias("facts")
    )
    payload = F.struct("doc_id", "d.company", "d.page_count", "d.source_path", "facts")
    return grouped.withColumn("d", F.explode("documents")).select(
        file_stem(F.col("d.source_path")).alias("cache_key"), payload.alias("payload")
    )


def field_text(content: Column) -> Column:
    """Field content as text; fractions in shortest form, arrays and objects as JSON."""
    kind = F.schema_of_variant(content)
    fraction = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return F.when(fraction, float_text(F.try_variant_get(content, "$", "double"))).otherwise(
        F.try_variant_get(content, "$", "string")
    )


def flatten_fields(parsed: DataFrame) -> DataFrame:
    """Every field with its content as text, with company and report period."""
    named = parsed.withColumns(
        {
            "company": F.try_variant_get("doc", "$.document_meta.company", "string"),
            "report_period": F.try_variant_get("doc", "$.document_meta.report_period", "string"),
        }
    )
    return section_fields(named).select(
        "path",
        F.concat_ws(".", "page", "section").alias("section"),
        "field",
        field_text(F.col("content")).alias("value"),
        "company",
        "report_period",
    )


def provenance_rows(parsed: DataFrame) -> DataFrame:
    """One row per provenance entry; quotes are cut to their first characters."""
    entry = "array<struct<metric:string, page:string, quote:string>>"
    return parsed.select(
        "path", F.explode(F.try_variant_get("doc", "$.provenance", entry)).alias("e")
    ).select(
        "path", "e.metric", "e.page", F.substring("e.quote", 1, K.QUOTE_CHARS).alias("quote")
    )


def notice_rows(parsed: DataFrame) -> DataFrame:
    """One row per entry of the `missing` and `warnings` lists."""
    lists = F.map_from_arrays(
        F.array(F.lit("missing"), F.lit("warnings")),
        F.array(
            *[
                F.coalesce(F.try_variant_get("doc", f"$.{name}", "array<string>"), F.array().cast("array<string>"))
                for name in ("missing", "warnings")
            ]
        ),
    )
    return parsed.select("path", F.explode(lists).alias("kind", "entries")).select(
        "path", "kind", F.explode("entries").alias("entry")
    )
