"""Repeated passages by content-defined chunking.

A gear rolling hash cuts every text where its last bytes say so, so that an insertion moves no
cut but those beside it. Chunks are compared by a 64-bit digest; runs of neighbouring chunks
that other documents hold too are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factlake.llm.common import signed, span_hashes, stored, text_slices, word_spans

# Bytes that the rolling hash sees, and the bits of it that must be zero at a cut.
WINDOW = 16
CUT_BITS = 0xF000
# A cut needs this distance to the candidate before it; longer chunks than MAX_BYTES are cut evenly.
MIN_BYTES = 12
MAX_BYTES = 512
# Words of a passage: chunks at its edges reach beyond it, so a passage loses about ten words.
MIN_WORDS = 20

_GEAR = np.random.default_rng(23).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the chunks of each row; rows without bytes have none."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    gear = _GEAR[data]
    step = 1
    while step < WINDOW:
        wider = gear.copy()
        wider[step:] += gear[:-step] << np.uint32(step)
        gear, step = wider, 2 * step
    cut = np.flatnonzero((gear & np.uint32(CUT_BITS)) == 0) + 1  # the chunk ends before this byte
    row = np.searchsorted(starts, cut - 1, side="right") - 1
    cut = cut[cut - starts[row] >= WINDOW]
    apart = np.ones(len(cut), dtype=bool)
    apart[1:] = np.diff(cut) >= MIN_BYTES
    edges = np.unique(np.concatenate([starts, cut[apart]]))
    long = np.flatnonzero(np.diff(edges) > MAX_BYTES)
    if len(long):
        more = [np.arange(edges[i] + MAX_BYTES, edges[i + 1], MAX_BYTES) for i in long]
        edges = np.unique(np.concatenate([edges, *more]))
    begin, end = edges[:-1], edges[1:]
    return np.searchsorted(starts, begin, side="right") - 1, begin, end


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, starts in text_slices(batch.column(1)):
            row, begin, end = chunk_bounds(data, starts)
            if not len(row):
                continue
            ids = batch.column(0).slice(first, last - first)
            digest = span_hashes(data, begin, end)
            whole = span_hashes(data, starts[:-1], starts[1:])
            _, word, _ = word_spans(data, starts)
            words = np.searchsorted(word, end) - np.searchsorted(word, begin)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(digest)),
                    ids.take(pa.array(row)),
                    pa.array((signed(whole) >> 33).astype(np.int32)[row]),
                    pa.array((begin - starts[row]).astype(np.int64)),
                    pa.array((end - starts[row]).astype(np.int64)),
                    pa.array(words.astype(np.int32)),
                ],
                names=["digest", "doc_id", "version", "begin", "end", "words"],
            )


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(digest, doc_id, version, begin, end, words) of every chunk; places in bytes; version tells
    rows with one doc_id and different texts apart."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(_chunks, "digest long, doc_id long, version int, begin long, end long, words int")


def repeated_passages(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per part of a repeated passage: doc_id, begin, end (bytes, end exclusive), n_words, n_chunks, first_doc_id, kept.

    A chunk is repeated if two doc_ids hold it; a passage is a run of neighbouring repeated chunks
    with min_words words in all. It is cut into parts where it changes whether this document is the
    smallest holder (kept). Each part has a row, however short: begin, end, n_chunks, first_doc_id (the
    smallest doc_id that holds one of its chunks) and kept are the part's, n_words counts the words of
    the whole passage. Documents without a repeated passage have no row.
    Null and empty texts and null doc_ids have none; equal rows count once, rows of one doc_id
    never repeat each other; very long texts are chunked whole; an empty table gives none.
    """
    found = chunks(docs, text, doc_id)
    held = (
        found.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .select("digest", "first_doc")
    )
    repeated = found.join(held, "digest").select("doc_id", "version", "begin", "end", "words", "first_doc").distinct()
    order = Window.partitionBy("doc_id", "version").orderBy("begin")
    # a run ends where the text does; a part of it also where it changes whether this document is the first holder
    own = F.col("first_doc") == F.col("doc_id")
    breaks = F.when(F.lag("end").over(order) == F.col("begin"), 0).otherwise(1)
    turns = F.when(F.lag(own).over(order) == own, F.col("breaks")).otherwise(1)
    runs = (
        repeated.select("*", breaks.alias("breaks"))
        .select("*", turns.alias("turns"))
        .select("*", F.sum("breaks").over(order).alias("run"), F.sum("turns").over(order).alias("part"))
    )
    parts = runs.groupBy("doc_id", "version", "run", "part").agg(
        F.min("begin").alias("begin"),
        F.max("end").alias("end"),
        F.sum("words").alias("words"),
        F.count("*").alias("n_chunks"),
        F.min("first_doc").alias("first_doc_id"),
        F.bool_and(F.col("first_doc") == F.col("doc_id")).alias("kept"),
    )
    # the whole run counts: a line that an earlier document holds too does not hide the passage around it
    whole = Window.partitionBy("doc_id", "version", "run")
    return (
        parts.withColumn("n_words", F.sum("words").over(whole))
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "begin", "end", "n_words", "n_chunks", "first_doc_id", "kept")
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the passages that a document of a smaller doc_id holds.

    Rows without such passages stay as they are; columns are those of docs.
    """
    cut = stored(
        repeated_passages(docs, text, doc_id, min_words)
        .where("not kept")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("__cut")),
        "cuts",
    )

    @F.pandas_udf("string")
    def shortened(texts, cuts):
        out = []
        for value, spans in zip(texts, cuts, strict=True):
            data = value.encode()
            at, parts = 0, []
            for span in spans:
                parts.append(data[at : max(at, span["begin"])])
                at = max(at, span["end"])
            out.append(b"".join([*parts, data[at:]]).decode(errors="ignore"))
        return type(texts)(out)

    rows = docs.join(cut, F.col(doc_id) == F.col("__id"), "left")
    changed = F.when(F.col("__cut").isNull() | F.col(text).isNull(), F.col(text)).otherwise(
        shortened(F.coalesce(F.col(text), F.lit("")), F.coalesce("__cut", F.array().cast(cut.schema["__cut"].dataType)))
    )
    return rows.withColumn(text, changed).select(*docs.columns)
