"""Documents and pages: identity, paging, upsert, replacement, validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from factlake import schemas
from factlake.functions.text import normalize_lines
from factlake.operators.ranking import first_rows


def doc_id(path: Column) -> Column:
    """Identifier of a document: hash of its absolute path, not of its content."""
    return F.sha1(path)


def file_stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?/*$", 1)


def doc_identity(files: DataFrame, path: str = "path") -> DataFrame:
    """Add doc_id, and company as guessed from the file name."""
    spaced = F.regexp_replace(file_stem(F.col(path)), "[_-]", " ")
    company = F.regexp_replace(spaced, r"^\s+|\s+$", "")
    return files.withColumns({"doc_id": doc_id(F.col(path)), "company": company})


def page_text(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """One row per document and 1-based page from an array of page texts."""
    exploded = documents.select(
        *[c for c in documents.columns if c != pages], F.posexplode(pages).alias("place", "text")
    )
    return (
        exploded.withColumn("page_num", F.col("place") + 1)
        .withColumn("text", normalize_lines(F.col("text")))
        .drop("place")
    )


def drop_last_page(pages: DataFrame) -> DataFrame:
    """Every page but the last of its document.

    The last page numbers are found first, on two narrow columns, and removed
    with an anti join on (doc_id, page_num): texts of one huge document spread
    over all tasks instead of meeting in one window.
    """
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("page_num"))
    return pages.where(F.col("page_num").isNotNull()).join(last, ["doc_id", "page_num"], "left_anti")


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages kept per document."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))


def skip_existing(inputs: DataFrame, documents: DataFrame) -> DataFrame:
    """Inputs whose doc_id is not stored yet."""
    return inputs.join(documents.select("doc_id"), "doc_id", "left_anti")


def documents_upsert(existing: DataFrame, batch: DataFrame, order: str = "batch_order") -> DataFrame:
    """Insert new documents and overwrite stored ones; the last of a batch wins.

    Stored rows pass through an anti join and are never sorted, so a small batch
    costs one broadcast over the stored table.
    """
    columns = existing.columns
    newest = first_rows(batch, ["doc_id"], [F.desc(order)])
    return existing.join(newest.select("doc_id"), "doc_id", "left_anti").select(columns).unionByName(
        newest.select(columns)
    )


def facts_replace_by_doc(existing: DataFrame, batch_docs: DataFrame, new_facts: DataFrame) -> DataFrame:
    """Facts after re-ingesting a batch of documents.

    All stored facts of the batch's documents go, also of those that bring no
    new fact, so the batch is given by its documents and not by its facts.
    """
    kept = existing.join(batch_docs.select("doc_id"), "doc_id", "left_anti")
    return kept.select(existing.columns).unionByName(new_facts.select(existing.columns))


def pages_replace_by_doc(existing: DataFrame, batch_docs: DataFrame, new_pages: DataFrame) -> DataFrame:
    """The same replacement for page texts."""
    return facts_replace_by_doc(existing, batch_docs, new_pages)


# Fixed value: about so many bytes of fresh payloads are sorted by one task.
MERGE_BYTES = 32 << 20


def cache_merge(requests: DataFrame, cache: DataFrame, fresh: DataFrame, payload: str = "payload") -> DataFrame:
    """The cached extraction of a file stem unless forced, else the fresh one.

    requests(path, force), cache(cache_key, payload), fresh(path, payload).

    Payloads are never broadcast, whatever size Spark reads off the files they come from. The fresh ones are
    measured first (one pass over them) and dealt to as many tasks as they need, since texts that compress
    well would otherwise meet in few.
    """
    held = fresh.agg(F.sum(F.octet_length(F.col(payload).cast("string")))).first()[0] or 0
    tasks = max(fresh.sparkSession.sparkContext.defaultParallelism, math.ceil(held / MERGE_BYTES))
    keyed = requests.withColumn("cache_key", file_stem(F.col("path")))
    stored = cache.select("cache_key", F.col(payload).alias("__stored"), F.lit(True).alias("__hit"))
    made = fresh.select("path", F.col(payload).alias("__made"))
    use_stored = F.col("__hit").isNotNull() & ~F.coalesce("force", F.lit(False))
    return (
        keyed.join(stored.hint("merge"), "cache_key", "left")
        .repartition(tasks, "path")
        .join(made.repartition(tasks, "path").hint("merge"), "path", "left")
        .withColumn("from_cache", use_stored)
        .withColumn(payload, F.when(use_stored, F.col("__stored")).otherwise(F.col("__made")))
        .drop("__stored", "__made", "__hit")
    )


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that need a fresh extraction."""
    keyed = requests.withColumn("cache_key", file_stem(F.col("path")))
    forced = F.coalesce("force", F.lit(False))
    missing = keyed.where(~forced).join(cache.select("cache_key"), "cache_key", "left_anti")
    return keyed.where(forced).unionByName(missing.select(keyed.columns))


def _validate(df: DataFrame, schema, checks: list[tuple[str, Column]]) -> DataFrame:
    """Cast to the schema and add reject_reason: the first rule a row breaks, else NULL."""
    typed = df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
        *[c for c in df.columns if c not in schema.fieldNames()],
    )
    required = [
        F.when(F.col(f.name).isNull(), f"{f.name} is missing") for f in schema.fields if not f.nullable
    ]
    ranges = [F.when(~condition, reason) for reason, condition in checks]
    return typed.withColumn("reject_reason", F.coalesce(*required, *ranges))


def validate_facts(facts: DataFrame) -> DataFrame:
    in_range = F.col("confidence").between(0.0, 1.0)
    return _validate(facts, schemas.FACTS, [("confidence is outside 0 to 1", in_range)])


def validate_pages(pages: DataFrame) -> DataFrame:
    return _validate(pages, schemas.RAW_PAGES, [])


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNotNull())
