"""Incremental ingest: new extraction files to facts, exactly once.

Every micro-batch writes its documents and facts into folders of its own
(`batch_id=N`). A batch that is run again after a failure overwrites its own
folders, and no stored file is ever rewritten. Which batch holds the current
facts of a document follows from the documents, also for a document whose new
version has no facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factlake import schemas
from factlake.operators.documents import doc_identity, drop_last_page, page_counts, page_text
from factlake.operators.extraction import describe, document_rows, flatten_facts, parse_extraction
from factlake.operators.ranking import first_rows

REJECTS = StructType().add("doc_id", "string").add("path", "string").add("reason", "string").add("raw", "string")
NO_OBJECT = "no JSON object"

# Tables that are compacted, and the order of their files.
CLUSTERED = {"facts": ["metric_key", "company", "doc_id"], "pages": ["doc_id", "page_num"]}


def write_batch(extractions: DataFrame, batch_id: int, target: str) -> None:
    """Documents, facts and rejects of one batch; the last of equal paths counts."""
    order = [F.desc("arrived_at"), F.desc("raw")] if "arrived_at" in extractions.columns else [F.desc("raw")]
    # dealt before they are sorted: a batch of few splits would be sorted whole in as few tasks
    latest = first_rows(extractions.repartition("path"), ["path"], order).select("path", "raw")
    described = describe(parse_extraction(latest)).persist()
    try:
        facts = flatten_facts(described.select("doc_id", "company", "unit_hint", "doc"))
        facts.write.mode("overwrite").parquet(f"{target}/facts/batch_id={batch_id}")
        unread = described.where(F.col("doc").isNull()).select("doc_id", "path", F.lit(NO_OBJECT).alias("reason"), "raw")
        unread.write.mode("overwrite").parquet(f"{target}/rejects/batch_id={batch_id}")
        documents = document_rows(described)
        documents.write.mode("overwrite").parquet(f"{target}/documents/batch_id={batch_id}")
    finally:
        described.unpersist()


def write_page_batch(files: DataFrame, batch_id: int, target: str, ignore_last_page: bool = False) -> None:
    """Documents and page texts of one batch: files(path, pages), pages an array of texts."""
    order = [F.desc("arrived_at")] if "arrived_at" in files.columns else [F.desc("pages")]
    named = doc_identity(first_rows(files, ["path"], order).select("path", "pages")).withColumnRenamed("path", "source_path")
    pages = page_text(named.select("doc_id", "company", "source_path", "pages"))
    kept = drop_last_page(pages) if ignore_last_page else pages
    kept.select(schemas.RAW_PAGES.fieldNames()).write.mode("overwrite").parquet(f"{target}/pages/batch_id={batch_id}")
    written = files.sparkSession.read.schema(schemas.RAW_PAGES).parquet(f"{target}/pages/batch_id={batch_id}")
    documents = named.join(page_counts(written), "doc_id", "left").select(
        "doc_id",
        "company",
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("string").alias("industry"),
        F.lit(None).cast("string").alias("report_date"),
        "source_path",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
    )
    documents.write.mode("overwrite").parquet(f"{target}/documents/batch_id={batch_id}")


def incremental_ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType = schemas.EXTRACTIONS,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 1000,
    file_pattern: str = "*.parquet",
    write: Callable[[DataFrame, int, str], None] = write_batch,
) -> StreamingQuery:
    """Ingest the files that are new since the last run, then stop.

    `prepare` turns the file rows into what `write` takes: extractions(path, raw)
    for write_batch, files(path, pages) for write_page_batch.
    """
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", file_pattern)
        .parquet(source)
    )
    arrived = prepare(rows) if prepare else rows

    def write_to_target(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id, target)

    return (
        arrived.writeStream.foreachBatch(write_to_target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _compacted(spark: SparkSession, target: str) -> int:
    """The batch up to which the newest compaction goes; -1 without one."""
    try:
        found = spark.read.schema("upto long").json(f"{target}/compactions").agg(F.max("upto")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return -1
    return -1 if found is None else found


def _stored(spark: SparkSession, target: str, name: str, schema: StructType, upto: int) -> DataFrame:
    """Rows of the compaction up to a batch and of all batches after it, with their batch_id."""
    whole = StructType(list(schema.fields)).add("batch_id", "long")
    later = spark.read.schema(whole).parquet(f"{target}/{name}").where(F.col("batch_id") > upto)
    if upto < 0:
        return later
    return spark.read.schema(whole).parquet(f"{target}/compacted/{upto}/{name}").unionByName(later)


def current_documents(spark: SparkSession, target: str) -> DataFrame:
    """Newest version of every document, with its batch_id."""
    log = _stored(spark, target, "documents", schemas.DOCUMENTS, _compacted(spark, target))
    return first_rows(log, ["doc_id"], [F.desc("batch_id")])


def _current(spark: SparkSession, target: str, name: str, schema: StructType) -> DataFrame:
    """Rows of the newest version of every document, with their batch_id.

    The rows pass by the list of replaced versions, which holds only documents
    that came more than once since the last compaction.
    """
    upto = _compacted(spark, target)
    log = _stored(spark, target, "documents", schemas.DOCUMENTS, upto).select("doc_id", "batch_id")
    newest = log.groupBy("doc_id").agg(F.max("batch_id").alias("newest"), F.count("*").alias("versions"))
    again = newest.where("versions > 1").select("doc_id", "newest")
    replaced = log.join(again, "doc_id").where("batch_id < newest").select("doc_id", "batch_id")
    rows = _stored(spark, target, name, schema, upto)
    return rows.join(replaced, ["doc_id", "batch_id"], "left_anti").select(*schema.fieldNames(), "batch_id")


def current_facts(spark: SparkSession, target: str) -> DataFrame:
    """Facts of the newest version of every document."""
    return _current(spark, target, "facts", schemas.FACTS).drop("batch_id")


def current_pages(spark: SparkSession, target: str) -> DataFrame:
    """Page texts of the newest version of every document."""
    return _current(spark, target, "pages", schemas.RAW_PAGES).drop("batch_id")


def rejected_extractions(spark: SparkSession, target: str) -> DataFrame:
    """Versions that could not be read: REJECTS, batch_id, and `open`: no later version of the document could.

    An open reject of a document with an older version that could be read leaves that one current.
    """
    rejects = spark.read.schema(StructType(list(REJECTS.fields)).add("batch_id", "long")).parquet(f"{target}/rejects")
    log = _stored(spark, target, "documents", schemas.DOCUMENTS, _compacted(spark, target))
    newest = log.groupBy("doc_id").agg(F.max("batch_id").alias("read"))
    return rejects.join(newest, "doc_id", "left").select(
        *REJECTS.fieldNames(), "batch_id", (F.coalesce("read", F.lit(-1)) < F.col("batch_id")).alias("open")
    )


def compact(spark: SparkSession, target: str, names: tuple[str, ...] = ("facts",)) -> int:
    """Write what is current after the batches so far into clustered files; returns the last of these batches.

    Batches that arrive meanwhile are not part of it and stay beside it. The manifest, one file,
    comes last: until then, and after a failure, readers go on as before. With nothing new
    since the last compaction, nothing is written.
    """
    documents = current_documents(spark, target)
    upto = documents.agg(F.max("batch_id")).first()[0]
    if upto is None or upto <= _compacted(spark, target):
        return -1 if upto is None else upto
    # what came after the batch was chosen is left to the next compaction
    where = f"{target}/compacted/{upto}"
    tables = {"facts": schemas.FACTS, "pages": schemas.RAW_PAGES}
    for name in names:
        order = CLUSTERED[name]
        rows = _current(spark, target, name, tables[name]).where(F.col("batch_id") <= upto)
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{where}/{name}")
    documents = current_documents(spark, target).where(F.col("batch_id") <= upto)
    columns = [*schemas.DOCUMENTS.fieldNames(), "batch_id"]
    documents.select(columns).write.mode("overwrite").parquet(f"{where}/documents")
    manifest = spark.createDataFrame([(upto,)], "upto long").coalesce(1)
    manifest.write.mode("overwrite").json(f"{target}/compactions/at={upto}")
    return upto
