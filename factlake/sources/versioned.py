"""Tables that are replaced by document: parts by a hash of the document, and one manifest per version.

A change writes the parts it touches into a folder of its own and then, last, the manifest of the
next version, a single file that names for every part the folder that holds it. Readers take the
newest manifest that is there, so they see a change as a whole or not at all, and what an
interrupted change left behind belongs to no version. One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from factlake.operators.ranking import first_rows

PART = "part"

# A table gets more parts when these hold more rows on average.
ROWS_PER_PART = 2_000_000
# More rows than this are not moved: a new table is written by the tasks that make its rows, and to the stored rows
# of a change the documents that go are carried, in slices with about so many bytes of keys.
STAY_ROWS = 2_000_000
SLICE_BYTES = 32 << 20

_MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("schema", T.StringType()),
        T.StructField(PART, T.IntegerType()),
        T.StructField("folder", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)


class Version(NamedTuple):
    """What a manifest says: the key column, the number of parts, the columns, and of each part with rows (folder, rows)."""

    number: int
    key: str
    parts: int
    schema: T.StructType
    live: dict[int, tuple[str, int]]


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/versions")
    except AnalysisException as error:
        raise FileNotFoundError(f"no table under {path}") from error


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of the table, or the one of that number."""
    rows = _manifests(spark, path)
    if number is None:
        number = rows.agg(F.max("version")).first()[0]
    found = rows.where(F.col("version") == F.lit(number)).collect()  # one row per part
    if not found:
        raise FileNotFoundError(f"no version {number if number is not None else ''} of a table under {path}")
    live = {r[PART]: (r["folder"], r["rows"]) for r in found if r[PART] is not None}
    one = found[0]
    return Version(number, one["key"], one["parts"], T.StructType.fromJson(json.loads(one["schema"])), live)


def _commit(spark: SparkSession, path: str, made: Version) -> None:
    """Write the manifest: one file, which is there as a whole or not at all."""
    same = (made.key, made.parts, made.schema.json())
    rows = [(*same, part, folder, rows) for part, (folder, rows) in sorted(made.live.items())] or [(*same, None, None, None)]
    schema = T.StructType(_MANIFEST.fields[1:])
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/versions/version={made.number}")


def _write(rows: DataFrame, path: str, key: str, parts: int, spread: bool = False) -> dict[int, tuple[str, int]]:
    """Write rows by part into a folder of their own; (folder, rows) of each part that has some.

    Rebalancing brings the rows of a part together, and splits a part that one document makes large;
    spread rows are written by the tasks that make them.
    """
    folder = uuid.uuid4().hex
    where = f"{path}/data/{folder}"
    rows = rows.withColumn(PART, _part(key, parts))
    (rows if spread else rows.hint("rebalance", PART)).write.partitionBy(PART).parquet(where, compression="zstd")
    return _written(rows.sparkSession, where, folder)


def _written(spark: SparkSession, where: str, folder: str) -> dict[int, tuple[str, int]]:
    """(folder, rows) of each part in a folder."""
    try:
        counts = spark.read.schema(T.StructType([T.StructField(PART, T.IntegerType())])).parquet(where)
    except AnalysisException:
        return {}
    return {r[PART]: (folder, r["count"]) for r in counts.groupBy(PART).count().collect()}


def _read(spark: SparkSession, path: str, seen: Version, only: set[int] | None = None) -> DataFrame:
    """The rows of the version, or of some of its parts."""
    paths = [f"{path}/data/{folder}/{PART}={p}" for p, (folder, _) in sorted(seen.live.items()) if only is None or p in only]
    if not paths:
        return spark.createDataFrame([], seen.schema)
    return spark.read.schema(seen.schema).parquet(*paths)


def _slices(sizes: dict[int, int], most: int) -> list[tuple[set[int], int, int]]:
    """(parts, n, i): some parts, of which the i-th of n slices; with about `most` bytes of keys each, from the bytes by part."""
    slices, some, held = [], set(), 0
    for part, size in sorted(sizes.items()):
        n = -(-size // most)
        if n > 1:
            slices += [({part}, n, i) for i in range(n)]
            continue
        if some and held + size > most:
            slices.append((some, 1, 0))
            some, held = set(), 0
        some, held = some | {part}, held + size
    return [*slices, (some, 1, 0)] if some else slices


def _write_in_place(seen: Version, docs: DataFrame, fresh: DataFrame, path: str, parts: int, sizes: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Write the rows that stay and the fresh ones into a folder of their own; (folder, rows) of each part that has some.

    Rows that stay do not move: each task reads some, drops those of the documents, which are carried to it slice by
    slice, and writes the others. A stored part lies in a few new ones, if there are more parts now. Fresh rows
    are brought together by part. `sizes` has the bytes of the documents' keys by stored part.
    """
    spark, key, names = fresh.sparkSession, seen.key, seen.schema.fieldNames()
    folder = uuid.uuid4().hex
    where = f"{path}/data/{folder}"

    def write(rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(PART).parquet(where, compression="zstd")

    write(fresh.withColumn(PART, _part(key, parts)).hint("rebalance", PART))
    changed = parts != seen.parts
    slices = _slices({p: n for p, n in sizes.items() if p in seen.live}, SLICE_BYTES)
    whole = set(seen.live) - set(sizes) if changed else set()
    for some, n, i in slices:
        here = F.pmod(F.xxhash64(F.lit(PART), key), F.lit(n)) == i if n > 1 else F.lit(True)
        gone = docs.where(_part(key, seen.parts).isin(*some) & here)
        # about SLICE_BYTES, as counted
        left = _read(spark, path, seen, some).where(here).join(F.broadcast(gone), key, "left_anti")
        write(left.select(*names, _part(key, parts).alias(PART)))
    if whole:
        write(_read(spark, path, seen, whole).select(*names, _part(key, parts).alias(PART)))
    return _written(spark, where, folder)


def create_by_doc(rows: DataFrame, path: str, parts: int = 8, key: str = "doc_id") -> None:
    """Write a table that later batches replace by document. What was under the path before becomes an older version."""
    try:
        number = version(rows.sparkSession, path).number + 1
    except FileNotFoundError:
        number = 0
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    # counted first; very many rows do not move, their tasks write a file per part
    made = _write(rows, path, key, parts, spread=rows.count() > STAY_ROWS)
    _commit(rows.sparkSession, path, Version(number, key, parts, schema, made))


def read_by_doc(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one."""
    return _read(spark, path, version(spark, path, number))


def replace_by_doc(batch_docs: DataFrame, new_rows: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> Version:
    """Replace all stored rows of the batch's documents by the new rows, as the next version.

    Only parts that hold a document of the batch are read and written, the others stay where
    they are. Very many stored rows do not move (STAY_ROWS). If the parts have grown beyond rows_per_part on average,
    the table is written whole with twice as many or more. Running a batch again gives the same rows. New rows of documents
    that are not in the batch are left out.
    """
    seen = version(new_rows.sparkSession, path)
    docs = batch_docs.select(seen.key).distinct()
    fresh = new_rows.select(seen.schema.fieldNames()).join(docs, seen.key, "left_semi")
    return _replace(seen, docs, fresh, path, rows_per_part)


def _replace(seen: Version, docs: DataFrame, fresh: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> Version:
    """The next version: rows of the documents, one row each, go; fresh rows, all of them of these documents, come."""
    spark = fresh.sparkSession
    key, names = seen.key, seen.schema.fieldNames()
    fresh = fresh.select(names)
    parts = seen.parts
    held = sum(rows for _, rows in seen.live.values())
    while held > parts * rows_per_part:
        parts *= 2
    docs = docs.persist()
    try:
        # a row per part
        keys = docs.groupBy(_part(key, seen.parts).alias(PART)).agg(F.sum(F.octet_length(F.col(key).cast("string"))).alias("size"))
        sizes = {r[PART]: r["size"] or 0 for r in keys.collect()}
        if not sizes and parts == seen.parts:
            return seen
        touched = set(sizes) if parts == seen.parts else set(seen.live)
        if sum(rows for p, (_, rows) in seen.live.items() if p in touched) > STAY_ROWS:
            made = _write_in_place(seen, docs, fresh, path, parts, sizes)
        else:
            left = _read(spark, path, seen, touched).join(docs, key, "left_anti")
            made = _write(left.select(names).unionByName(fresh), path, key, parts)
    finally:
        docs.unpersist()
    live = made if parts != seen.parts else {p: at for p, at in seen.live.items() if p not in touched} | made
    after = Version(seen.number + 1, key, parts, seen.schema, live)
    _commit(spark, path, after)
    return after


def upsert_by_doc(batch: DataFrame, path: str, order: str = "batch_order") -> Version:
    """Insert new documents and overwrite stored ones, one row each; the last of a batch wins."""
    seen = version(batch.sparkSession, path)
    # read for the parts it touches, for what it replaces and for what it brings, but computed once
    newest = first_rows(batch, [seen.key], [F.desc(order)]).select(seen.schema.fieldNames()).persist()
    try:
        # rows without a key replace nothing and do not come in
        keyed = newest.where(F.col(seen.key).isNotNull())
        return _replace(seen, newest.select(seen.key), keyed, path)
    finally:
        newest.unpersist()


def stale_folders(spark: SparkSession, path: str, keep: int = 1) -> DataFrame:
    """(folder) of data that only versions before the newest `keep` name; the storage's own tools remove them.

    Folders of interrupted changes are in no manifest; they show when the storage lists `data`.
    """
    newest = version(spark, path).number
    named = _manifests(spark, path).where(F.col("folder").isNotNull())
    live = named.where(F.col("version") > newest - keep).select("folder")
    return named.where(F.col("version") <= newest - keep).select("folder").distinct().join(live, "folder", "left_anti")
