"""Input files: discovery, cached extractions, entity lists."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factlake import schemas
from factlake.operators.documents import file_stem


def _any_case(suffix: str) -> str:
    """File name pattern of a suffix in upper or lower case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix.lstrip("."))


def discover_files(
    spark: SparkSession,
    inputs: list[str],
    suffix: str = "pdf",
    glob: str | None = None,
    recursive: bool = False,
    first: int | None = None,
) -> DataFrame:
    """Files with a suffix below files, folders or patterns, each path once.

    Contents are not read. With `first`, the first paths in order.
    """
    wanted = _any_case(suffix)
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", wanted)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    found = spark.createDataFrame([], schemas.DISCOVERED_FILES)
    for item in inputs:
        is_file = item.lower().endswith("." + suffix.lstrip(".").lower())
        is_pattern = any(c in item for c in "*?[{")
        path = item if is_file or is_pattern or recursive else f"{item.rstrip('/')}/{glob or wanted}"
        try:
            files = reader.load(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            continue
        listed = files.select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"),
            "length",
            F.col("modificationTime").alias("modified_at"),
        )
        if recursive and glob:
            name = F.element_at(F.split("path", "/"), -1)
            listed = listed.where(name.rlike(_glob_pattern(glob)))
        found = found.unionByName(listed)
    unique = found.dropDuplicates(["path"])
    return unique.orderBy("path").limit(first) if first is not None else unique


def _glob_pattern(glob: str) -> str:
    """A file name glob as a regular expression."""
    plain = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c) for c in glob)
    return f"^{plain}$"


def read_extraction_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached extractions, one JSON file per document: cache_key and payload."""
    files = (
        spark.read.schema(schemas.EXTRACTION_CACHE)
        .option("multiLine", "true")
        .option("pathGlobFilter", "*_extracted.json")
        .json(folder)
    )
    # the path comes URL-encoded, but for the plus sign
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(file_stem(path), "_extracted$", "")
    return files.select(stem.alias("cache_key"), F.struct(*schemas.EXTRACTION_CACHE.fieldNames()).alias("payload"))


def write_extraction_cache(payloads: DataFrame, path: str) -> None:
    """Append extractions to a cache table: JSON lines with cache_key and payload."""
    payloads.write.mode("append").json(path)


def read_extraction_cache_table(spark: SparkSession, path: str) -> DataFrame:
    layout = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("payload", schemas.EXTRACTION_CACHE)])
    return spark.read.schema(layout).json(path)


def cached_facts(cache: DataFrame) -> DataFrame:
    """Fact rows of cached extractions."""
    return cache.select(F.explode("payload.facts").alias("f")).select(
        *[F.col(f"f.{name}").alias(name) for name in schemas.FACT_COLUMNS]
    )


def read_entities(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Company and industry list from CSV; column names in any case. `view` names a temp view for it."""
    rows = spark.read.option("header", "true").csv(path)
    named = rows.toDF(*[c.strip().lower() for c in rows.columns])
    missing = {"company", "industry"} - set(named.columns)
    if missing:
        raise ValueError(f"the entity list lacks {', '.join(sorted(missing))}")
    if view:
        named.createOrReplaceTempView(view)
    return named


def rows_per_file(files: DataFrame, folders: list[str], suffix: str = "parquet", path: str = "path") -> DataFrame:
    """The files with `rows`, the rows that each Parquet file holds; 0 for files not below the folders.

    One scan counts all files, whatever their columns, as it reads none of them. The counts are
    joined to the listing, so neither the plan nor the driver grows with the files.
    """
    spark = files.sparkSession
    scan = spark.read.schema(T.StructType([])).option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case(suffix))
    # the path comes URL-encoded, but for the plus sign
    read = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    counts = scan.parquet(*folders).groupBy(F.regexp_replace(read, "^file:/*", "/").alias("__path")).count()
    joined = files.join(counts, F.col(path) == F.col("__path"), "left")
    return joined.select(*files.columns, F.coalesce("count", F.lit(0).cast("long")).alias("rows"))


def rows_per_table(counted: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rows per table of a folder, `file_name` and `rows`: a table is one file, or a folder of that name with its files."""
    start = re.sub("^file:/*", "/", folder).rstrip("/") + "/"
    below = F.element_at(F.split(path, re.escape(start), 2), -1)
    return counted.groupBy(F.split(below, "/")[0].alias("file_name")).agg(F.sum("rows").alias("rows")).select("rows", "file_name")
