"""Vectors of chunks: normalisation, exact nearest neighbours, hits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factlake import constants as K
from factlake.functions.text import float_text, matches_like
from factlake.operators.ranking import first_rows
from factlake.operators.terms import SCORE_DIGITS, TermLists, embed_terms, search_terms
from factlake.session import stored

# Queries and vectors that a task compares at a time.
STRIPE = 512
CHUNK = 4096

# The vectors in a task's memory, in double precision, and the queries that it has at least, if there are as many;
# a block is not cut below LEAST_ROWS.
BLOCK_BYTES = 32 << 20
LEAST_QUERIES = 8192
LEAST_ROWS = 256
# Vectors that pivots and first bars are taken from, and the pivots among them.
SAMPLE = 2048
PIVOTS = 256
# Steps of the angle to a pivot, from 0 to half a turn.
RINGS = 1024


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def normalize_l2(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Scale vectors to unit length; a zero vector stays as it is."""
    scaled = F.transform(vector, lambda x: x.cast("double") / F.col("__norm"))
    plain = F.transform(vector, lambda x: x.cast("double"))
    return (
        df.withColumn("__norm", l2_norm(F.col(vector)))
        .withColumn(vector, F.when(F.col("__norm") > 0, scaled).otherwise(plain))
        .drop("__norm")
    )


# --- nearest neighbours -------------------------------------------------------


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Equally long lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return flat.reshape(0, width or 0)
    if len(flat) % len(column) or (width is not None and len(flat) != len(column) * width):
        raise ValueError("vectors have different lengths")
    return flat.reshape(len(column), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=matrix.copy(), where=norms > 0)


def _sortable(ids: pa.Array) -> np.ndarray:
    """Ids, or for text the places of the ids in byte order, which is Spark's order."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    if not (pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type)):
        return ids.to_numpy(zero_copy_only=False)
    return np.unique([str(i).encode() for i in ids.to_pylist()], return_inverse=True)[1]


def _best_of(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, vector rows) of the k best scores of each line, ties by smaller place."""
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        query, row = np.nonzero(scores >= bound[:, None])
    else:
        query, row = (part.ravel() for part in np.indices(scores.shape))
    order = np.lexsort((places[row], -scores[query, row], query))
    query, row = query[order], row[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep]


class _Shelf:
    """The vectors of some blocks, gathered batch by batch until the first query comes."""

    def __init__(self):
        self.ids, self.rings, self.parts, self.unit = [], [], [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column("__id"))
        self.rings.append(batch.column("__ring").to_numpy(zero_copy_only=False))
        self.parts.append(_matrix(batch.column("__vector")))

    def close(self) -> None:
        if len({part.shape[1] for part in self.parts}) > 1:
            raise ValueError("vectors have different lengths")
        self.unit = _unit_rows(np.concatenate(self.parts))
        self.ids = pa.concat_arrays(self.ids)
        self.places = _sortable(self.ids)
        rings = np.concatenate(self.rings)
        self.rings, first = np.unique(rings, return_index=True)
        last = [*first[1:].tolist(), len(rings)]
        self.chunks = [
            (ring, begin, min(begin + CHUNK, end))
            for ring, (start, end) in enumerate(zip(first.tolist(), last, strict=True))
            for begin in range(start, end, CHUNK)
        ]
        self.parts = []

    def nearest(self, batch: pa.RecordBatch, k: int, blocks: _Blocks) -> Iterator[tuple]:
        if not self.ids:
            return
        if self.unit is None:
            self.close()
        asked = _unit_rows(_matrix(batch.column("__vector"), self.unit.shape[1]))
        bars = batch.column("__bar").to_numpy(zero_copy_only=False)
        names = batch.column("__query")
        for begin in range(0, len(asked), STRIPE):
            unit, bar = asked[begin : begin + STRIPE], bars[begin : begin + STRIPE]
            query, row, score = self._k_best(unit, bar, _reached(blocks, unit, bar, self.rings), k)
            yield names.take(pa.array(query + begin)), self.ids.take(pa.array(row)), pa.array(score)

    def _k_best(self, unit: np.ndarray, bar: np.ndarray, reached: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, vector, score) of each query's k best that reach its bar, in the blocks that it reaches."""
        found = []
        for ring, begin, end in self.chunks:
            who = np.flatnonzero(reached[:, ring])
            if not len(who):
                continue
            part = slice(begin, end)
            scores = (unit if len(who) == len(unit) else unit[who]) @ self.unit[part].T
            query, row = np.nonzero(scores >= bar[who, None] - 10.0**-SCORE_DIGITS)
            if len(query) > 4 * k * len(who):
                scores = np.round(scores, SCORE_DIGITS)
                query, row = _best_of(scores, self.places[part], k)
            found.append((who[query], row + begin, np.round(scores[query, row], SCORE_DIGITS)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, row, score = (np.concatenate(column) for column in zip(*found, strict=True))
        order = np.lexsort((self.places[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], row[keep], score[keep]


def _nearest_on_shelves(k: int, blocks: _Blocks, names: list[str]):
    """k best vectors of each shelf for each query, from rows ordered by shelf, vectors by block before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shelf = None, _Shelf()
        for batch in batches:
            if not batch.num_rows:
                continue
            shelves = batch.column("__block").to_numpy(zero_copy_only=False)
            asks = batch.column("__asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shelves[1:] != shelves[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shelves)], strict=True):
                if shelves[begin] != at:
                    at, shelf = shelves[begin], _Shelf()
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    shelf.add(part)
                    continue
                for found in shelf.nearest(part, k, blocks):
                    yield pa.RecordBatch.from_arrays(list(found), names=names)

    return run


def is_finite(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite elements."""
    values = vector.cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


class _Blocks(NamedTuple):
    """Where the vectors of an index lie: blocks are rings of angles around pivots.

    `sample` has some unit vectors of the index, the first of which, far apart, are the pivots. Block i holds
    vectors nearest to pivot[i], at angles from low[i] to high[i]. A ring with too many vectors is
    dealt to several blocks by a hash. The block of vectors without a direction has pivot -1.
    `first` and `several` say by pivot and step of the angle which block is a ring's first, and how many it has.
    Block i lies on shelf[i], with its neighbours, as many as a task's memory takes.
    """

    sample: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    several: np.ndarray
    shelf: np.ndarray


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _nearest_pivots(unit: np.ndarray, pivots: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, step of the angle to it); vectors without a direction have pivot -1."""
    cosines = unit @ pivots.T
    nearest = cosines.argmax(axis=1)
    angle = _angles(cosines[np.arange(len(unit)), nearest])
    step = np.minimum((angle / np.pi * rings).astype(np.int64), rings - 1)
    return np.where(unit.any(axis=1), nearest, -1), step


def _ring_counter(pivots: np.ndarray, rings: int):
    """Per task: (pivot, step, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pivots) + 1) * rings, np.int64)
        for batch in batches:
            unit = _unit_rows(_matrix(batch.column("__vector"), pivots.shape[1]))
            pivot, step = _nearest_pivots(unit, pivots, rings)
            counts += np.bincount((pivot + 1) * rings + step, minlength=len(counts))
        have = np.flatnonzero(counts)
        columns = [have // rings - 1, have % rings, counts[have]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pivot", "step", "n"])

    return run


def _cut_blocks(sample: np.ndarray, n_pivots: int, counts: np.ndarray, most: int, on_shelf: int) -> _Blocks:
    """Blocks of at most about `most` vectors, from the counts by pivot (the last row is pivot -1) and step.

    A shelf takes blocks of about on_shelf vectors in all.
    """
    pivot, low, high, rows = [], [], [], []
    first = np.full(counts.shape, -1, np.int64)
    several = np.ones(counts.shape, np.int64)
    for p in range(len(counts)):
        filled = np.flatnonzero(counts[p]).tolist()
        begin, held = None, 0
        for step in filled:
            begin = step if begin is None else begin
            held += int(counts[p, step])
            if held < most and step != filled[-1]:
                continue
            parts = -(-held // most)
            first[p, begin : step + 1] = len(pivot)
            several[p, begin : step + 1] = parts
            pivot += [p if p < n_pivots else -1] * parts
            # angles at the edge of a step may fall on either side of it
            low += [begin * np.pi / RINGS - 1e-6] * parts
            high += [(step + 1) * np.pi / RINGS + 1e-6] * parts
            rows += [-(-held // parts)] * parts
            begin, held = None, 0
    # the last block is for what falls, by rounding, where nothing was counted: every query asks it
    first[first < 0] = len(pivot)
    pivot, low, high = [*pivot, 0 if n_pivots else -1], [*low, 0.0], [*high, np.pi]
    shelf, filled = [], 0
    for n in rows:
        filled += n
        fresh = not shelf or filled > on_shelf
        filled = n if fresh else filled
        shelf.append(0 if not shelf else shelf[-1] + fresh)
    shelf.append(shelf[-1] if shelf else 0)
    return _Blocks(sample, np.array(pivot, np.int64), np.array(low), np.array(high), first, several, np.array(shelf, np.int64))


def _far_apart_first(unit: np.ndarray, n: int) -> np.ndarray:
    """The vectors with n of them first, each the one farthest from those before it."""
    chosen = [0][:n]
    nearest = unit @ unit[0] if n else None
    while len(chosen) < n:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    rest = np.ones(len(unit), bool)
    rest[chosen] = False
    return np.concatenate([unit[chosen], unit[rest]])


def _fit_blocks(rows: DataFrame, most_bytes: int) -> _Blocks:
    """Blocks of an index (__id, __vector), each small enough for one task's memory.

    The driver sees a fixed number of sampled vectors and the counts by pivot and step, which are
    bounded by their numbers.
    """
    spark = rows.sparkSession
    taken = rows.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE).select("__vector").toArrow()
    # a sample that is not full is the whole index, and counted where it is
    whole = taken.num_rows < SAMPLE
    n = taken.num_rows if whole else rows.count()
    sample = _unit_rows(_matrix(taken.column(0)))
    sample = sample[sample.any(axis=1)] if len(sample) else sample
    width = max(1, sample.shape[1])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on_shelf = max(1, most_bytes // (8 * width))
    most = min(on_shelf, max(LEAST_ROWS, -(-n // tasks)))
    n_pivots = min(PIVOTS, 2 * max(1, -(-n // most)), len(sample))
    sample = _far_apart_first(sample, n_pivots)
    if not n_pivots:
        # nothing, or nothing with a direction
        none = np.zeros((1, RINGS), np.int64)
        none[0, 0] = n
        return _cut_blocks(np.zeros((0, sample.shape[1])), 0, none, most, on_shelf)
    count = _ring_counter(sample[:n_pivots], RINGS)
    if whole:
        found = [row for batch in count(iter(taken.to_batches())) for row in batch.to_pylist()]
    else:
        held = rows.select("__vector").mapInArrow(count, "pivot long, step long, n long")
        found = held.groupBy("pivot", "step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((n_pivots + 1, RINGS), np.int64)
    for row in found:
        counts[row["pivot"], row["step"]] = row["n"]
    return _cut_blocks(sample, n_pivots, counts, most, on_shelf)


def _dealer(blocks: _Blocks):
    """Rows (__id, __hash, __vector) with their block."""
    pivots = blocks.sample[: len(blocks.first) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit_rows(_matrix(batch.column("__vector"), pivots.shape[1] if len(pivots) else None))
            if len(pivots):
                pivot, step = _nearest_pivots(unit, pivots, blocks.first.shape[1])
            else:
                pivot = step = np.zeros(len(unit), np.int64)
            block = blocks.first[pivot, step]
            block = block + batch.column("__hash").to_numpy() % blocks.several[pivot, step]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), batch.column("__id"), batch.column("__vector")], names=["__block", "__id", "__vector"]
            )

    return run


def _reached(blocks: _Blocks, unit: np.ndarray, bar: np.ndarray, these: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Which blocks, all or these, may hold a vector that reaches a query's bar.

    By the triangle inequality of angles no vector of a block scores more than the cosine of
    the least angle between the query and the block's ring.
    """
    pivot, low, high = blocks.pivot[these], blocks.low[these], blocks.high[these]
    rings = pivot >= 0
    most = np.zeros((len(unit), len(pivot)))
    if rings.any():
        pivots = blocks.sample[: len(blocks.first) - 1]
        to_pivot = _angles(unit @ pivots.T)[:, pivot[rings]]
        apart = np.maximum(np.maximum(to_pivot - high[rings], low[rings] - to_pivot), 0)
        most[:, rings] = np.where(unit.any(axis=1)[:, None], np.cos(np.minimum(apart, np.pi)), 0.0)
    return most + 10.0**-SCORE_DIGITS >= bar[:, None]


def _asker(blocks: _Blocks, k: int):
    """Rows (__query, __vector) with every shelf that may hold one of the query's k best, and the query's bar.

    The bar is the k-th best score among the sampled vectors, which the k best of all do not fall below.
    """
    first = np.flatnonzero(np.diff(blocks.shelf, prepend=-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STRIPE):
                part = batch.slice(begin, STRIPE)
                unit = _unit_rows(_matrix(part.column("__vector"), blocks.sample.shape[1] if len(blocks.first) > 1 else None))
                bar = np.full(len(unit), -np.inf)
                if len(blocks.sample) >= k:
                    scores = np.round(unit @ blocks.sample.T, SCORE_DIGITS)
                    bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                row, shelf = np.nonzero(np.logical_or.reduceat(_reached(blocks, unit, bar), first, axis=1))
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shelf), picked.column("__query"), picked.column("__vector"), pa.array(bar[row])],
                    names=["__block", "__query", "__vector", "__bar"],
                )

    return run


def knn_cosine(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K.SEARCH_HITS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    payload: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k vectors nearest to every query by cosine, exactly, with `score` and `place`.

    Vectors are dealt into blocks, rings of angles around pivots, and neighbouring blocks of about block_bytes
    in all onto shelves. A task has a shelf and a part of the queries; with few shelves there are more parts, so
    a vector moves once per part, a query once per shelf, whatever the number of blocks. A query goes to the shelves
    with a ring that may hold one of its k best, whatever the vectors; where they lie in clusters, these are few, and
    is compared with those rings only, by matrix products. What reaches its bar counts, the k best of a shelf
    leave it, and a window picks the k best of those. The payload is joined to these last, by
    id. Vectors and queries with null, NaN or infinite elements take no part.
    """
    id_type, name_type = vectors.schema[id_col].dataType, queries.schema[query_id].dataType
    numbers = vectors.schema[vector_col].dataType
    if numbers != queries.schema[query_vector].dataType or numbers.elementType != T.FloatType():
        numbers = T.ArrayType(T.DoubleType())
    held = vectors.where(is_finite(F.col(vector_col))).select(
        F.col(id_col).alias("__id"), F.col(vector_col).cast(numbers).alias("__vector")
    )
    wanted = queries.where(is_finite(F.col(query_vector))).select(
        F.col(query_id).alias("__query"), F.col(query_vector).cast(numbers).alias("__vector")
    )
    blocks = _fit_blocks(held, block_bytes)
    shelves = int(blocks.shelf[-1]) + 1
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # several tasks a core, as they take unequal times
    parts = max(1, min(-(-4 * tasks // shelves), -(-queries.count() // LEAST_QUERIES)))
    dealt = (
        held.select("__id", F.pmod(F.xxhash64("__id"), F.lit(1 << 31)).alias("__hash"), "__vector")
        .mapInArrow(_dealer(blocks), T.StructType().add("__block", "long").add("__id", id_type).add("__vector", numbers))
        .withColumnRenamed("__block", "__ring")
        .withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    on_shelf = F.element_at(F.lit(blocks.shelf.tolist()), (F.col("__ring") + 1).cast("int"))
    asked = wanted.mapInArrow(
        _asker(blocks, k),
        T.StructType().add("__block", "long").add("__query", name_type).add("__vector", numbers).add("__bar", "double"),
    )
    rows = dealt.select(
        (on_shelf * parts + F.col("__part")).cast("long").alias("__block"),
        F.lit(False).alias("__asks"),
        "__ring",
        "__id",
        F.lit(None).cast(name_type).alias("__query"),
        "__vector",
        F.lit(None).cast("double").alias("__bar"),
    ).union(
        asked.select(
            F.col("__block") * parts + F.pmod(F.xxhash64("__query"), F.lit(parts)),
            F.lit(True),
            F.lit(None).cast("long"),
            F.lit(None).cast(id_type),
            "__query",
            "__vector",
            "__bar",
        )
    )
    names = ["__query", "__id", "score"]
    schema = T.StructType(
        [T.StructField("__query", name_type), T.StructField("__id", id_type), T.StructField("score", T.DoubleType())]
    )
    partial = (
        rows.repartition(max(tasks, shelves * parts), "__block")
        .sortWithinPartitions("__block", "__asks", "__ring")
        .mapInArrow(_nearest_on_shelves(k, blocks, names), schema)
        .withColumnsRenamed({"__query": query_id, "__id": id_col})
    )
    best = first_rows(partial, [query_id], [F.desc("score"), F.asc(id_col)], n=k, rank="place", salt_by=[id_col])
    if not payload:
        return best
    hits = best.join(vectors.select(id_col, *payload), id_col)
    return hits.select(query_id, id_col, "score", *payload, "place")


def knn_company_filter(
    vectors: DataFrame, queries: DataFrame, company: str, k: int = K.SEARCH_HITS, mode: str = "post", **options
) -> DataFrame:
    """Neighbours whose company contains the given text.

    mode="post" filters the k neighbours, so fewer may remain; mode="pre" looks
    only at vectors of matching companies.
    """
    matching = matches_like(F.col("company"), company)
    payload = tuple(dict.fromkeys(("company", *options.pop("payload", ()))))
    if mode == "pre":
        return knn_cosine(vectors.where(matching), queries, k, payload=payload, **options)
    if mode != "post":
        raise ValueError("mode must be 'pre' or 'post'")
    return knn_cosine(vectors, queries, k, payload=payload, **options).where(matching)


# --- index tables and hits ----------------------------------------------------


def adapt_index_schema(index: DataFrame) -> DataFrame:
    """Give an index table the columns page_num and text."""
    if "page_num" not in index.columns:
        if "page" in index.columns:
            index = index.withColumnRenamed("page", "page_num")
        else:
            index = index.withColumn("page_num", F.lit(-1))
    if "text" not in index.columns:
        other = next((c for c in ("snippet", "chunk", "content") if c in index.columns), None)
        index = index.withColumnRenamed(other, "text") if other else index.withColumn("text", F.lit(""))
    return index


def index_manifest(
    index: DataFrame, embed_model: str, source: str, vector: str = "embedding", dim: int | None = None
) -> DataFrame:
    """One row about an index table. The dimension of term vectors is the number of different terms, unless `dim` has it."""
    if dim is not None:
        counts = index.agg(F.count("*").alias("count"), F.lit(dim).cast("int").alias("dim"))
    elif isinstance(index.schema[vector].dataType.elementType, T.StructType):
        terms = index.select(F.explode(vector).alias("t")).agg(F.count_distinct("t.term").cast("int").alias("dim"))
        counts = index.agg(F.count("*").alias("count")).join(terms, F.lit(True))
    else:
        counts = index.agg(
            F.count("*").alias("count"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")
        )
    return counts.select(
        F.lit(source).alias("source"),
        "count",
        "dim",
        F.lit(embed_model).alias("embed_model"),
        F.current_timestamp().alias("built_at"),
    )


def snippet_context(hits: DataFrame, queries: DataFrame | None = None, query_id: str = "query_id") -> DataFrame:
    """Context texts per query from its first hits (place, company, page_num, text, score).

    With `queries`, those without a hit get a text that says so.
    """
    page = F.concat(F.lit("p."), F.col("page_num").cast("string"))
    snippet = F.concat(F.lit("["), "company", F.lit("] ("), page, F.lit(") "), "text")
    scored = F.concat("text", F.lit("  [score="), float_text(F.col("score")), F.lit("]"))
    named = F.when(F.coalesce("company", F.lit("")) != "", F.col("company"))
    piped = F.concat_ws(" | ", named, page, scored)
    first = hits.where(F.col("place") <= K.SNIPPET_HITS)
    lines = first.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("place", snippet.alias("snippet"), piped.alias("piped")))).alias("ls")
    )
    texts = lines.select(
        query_id,
        F.array_join("ls.snippet", "\n\n").alias("context"),
        F.array_join("ls.piped", "\n").alias("rows_text"),
    )
    if queries is None:
        return texts
    return queries.select(query_id).join(texts, query_id, "left").fillna(
        {"context": K.MSG_NO_HITS, "rows_text": K.MSG_NO_ROWS}
    )


def facts_else_vector(
    questions: DataFrame, found: DataFrame, index: DataFrame, k: int = K.ROUTED_HITS, lists: TermLists | None = None
) -> DataFrame:
    """Fact rows of the questions about facts that have some, nearest chunks for all others.

    questions(question_id, text, intent), found(request_id, place, ...) as facts_search gives
    it, index(doc_id, page_num, chunk_idx, company, text, embedding) with term vectors, and
    its lists if they are stored. Every question has a row; status tells `ok` from `no hits`.
    `found` is read several times and may come from a long query: it is computed once.
    """
    found = stored(found, "found")
    about_facts = questions.where(F.col("intent") == "facts").select("question_id")
    facts = found.join(about_facts, F.col("request_id") == F.col("question_id"), "left_semi").select(
        F.col("request_id").alias("question_id"),
        F.lit("facts").alias("tool"),
        "place",
        "company",
        F.col("source_page").alias("page_num"),
        "metric_key",
        "metric_variant",
        "value",
        "unit",
    )
    answered = facts.select("question_id").distinct()
    open_questions = questions.join(answered, "question_id", "left_anti").select("question_id", "text")
    hits = search_terms(index, open_questions, k, lists=lists).select(
        "question_id", "place", "company", "page_num", "text", "score"
    )
    chunks = open_questions.select("question_id").join(hits, "question_id", "left").withColumn("tool", F.lit("vector"))
    rows = facts.unionByName(chunks, allowMissingColumns=True)
    return rows.withColumn("status", F.when(F.col("place").isNull(), "no hits").otherwise("ok"))
