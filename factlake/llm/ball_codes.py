"""Vector codes from codebooks of integer entries, fitted by ball k-means.

Vectors become integers and are cut into parts; every part position has its own codebook. An
entry with the parts assigned to it is a ball. Between two rounds only its neighbours, entries
no farther away than twice the ball's radius, can take a part from it. A part that is nearer to
its entry than half the way to the nearest neighbour lies in the stable core and is not compared;
the others are compared with as many of the nearest neighbours as the ring around the entry that
they lie in asks for. A ball that did not move, with neighbours that did not move, is skipped.
All of it is exact: distances are integers, and equal distances go to the smaller index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factlake.llm.common import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

# Integers must be smaller than this in size, so that squared distances of parts of up to 2^13
# components fit 64 bits.
LARGEST = 1 << 24

# Rows that are worked on at a time.
ROWS = 1 << 14
# Distances that are held at a time.
CELLS = 1 << 22

# Places of the values about an entry that are no sums of a component.
COUNT, RADIUS = -1, -2


class Ball(NamedTuple):
    """What a round knows of one part position: entries, and of each entry's ball the reach and whether it moved."""

    entries: np.ndarray
    reach: np.ndarray | None = None
    moved: np.ndarray | None = None


class Codebooks(NamedTuple):
    """Entries as integers by (part, entry, place in the part), and the coded rows.

    `codes` holds id, label, code (0-based index per part) and d2 (squared distance per part).
    """

    entries: np.ndarray
    codes: DataFrame


def is_whole(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    values = vector.cast("array<double>")
    return F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, q) of the rows that take part; q holds floor(SCALE * x) of each component."""
    return rows.where(is_whole(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).alias("label"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long")).alias("q"),
    )


def _cut(q: pa.Array, parts: int, width: int) -> np.ndarray:
    """(part, row, place) of the integer vectors."""
    sizes = q.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != parts * width).any():
        raise ValueError("vectors have different lengths")
    flat = q.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"components must lie below {LARGEST // SCALE} in size")
    return np.ascontiguousarray(flat.reshape(len(sizes), parts, width).transpose(1, 0, 2))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exactly."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, entries))
    if 4 * x.shape[1] * most * most < 1 << 53:
        # all values on the way are integers that a double holds
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    cross = x @ entries.T
    cross *= -2
    cross += (x * x).sum(axis=1)[:, None]
    cross += (entries * entries).sum(axis=1)
    return cross


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of all entries."""
    code, d2 = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, CELLS // max(1, len(entries)))
    for begin in range(0, len(x), step):
        cells = _distances(x[begin : begin + step], entries)
        best = cells.argmin(axis=1)
        code[begin : begin + step] = best
        d2[begin : begin + step] = cells[np.arange(len(best)), best].astype(np.int64)
    return code, d2


class _Neighbours:
    """For each entry of a part position: its neighbours, nearest first, and the balls that cannot change."""

    def __init__(self, ball: Ball):
        self.entries = ball.entries
        apart = _distances(ball.entries, ball.entries).astype(np.int64)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        # rounded up, so that no neighbour is missed
        within = self.apart <= (4 * ball.reach**2 * (1 + 1e-9) + 1)[:, None]
        self.count = within.sum(axis=1)
        self.stable = ~ball.moved & ~(within & ball.moved[self.order]).any(axis=1)

    def assign(self, x: np.ndarray, code: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The new (index, squared distance) of the parts, from those of the round before."""
        code, d2 = code.copy(), d2.copy()
        by_ball = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[by_ball], np.arange(len(self.entries) + 1))
        for entry in np.flatnonzero((edges[1:] > edges[:-1]) & ~self.stable):
            members = by_ball[edges[entry] : edges[entry + 1]]
            away = x[members] - self.entries[entry]
            own = (away * away).sum(axis=1)
            d2[members] = own
            # entries farther away than twice the distance cannot be nearer, nor as near
            ring = np.searchsorted(self.apart[entry, : self.count[entry]], 4 * own, side="right")
            asks = np.flatnonzero(ring)
            # rings of like width together: at most twice the candidates that a part needs
            width = np.frexp(ring[asks])[1]
            for w in np.unique(width):
                chosen = asks[width == w]
                near = self.order[entry, : ring[chosen].max()]
                step = max(1, CELLS // len(near))
                for begin in range(0, len(chosen), step):
                    some = chosen[begin : begin + step]
                    cells = _distances(x[members[some]], self.entries[near]).astype(np.int64)
                    least = cells.min(axis=1)
                    index = np.where(cells == least[:, None], near, len(self.entries)).min(axis=1)
                    better = (least < own[some]) | ((least == own[some]) & (index < entry))
                    rows = members[some[better]]
                    code[rows], d2[rows] = index[better], least[better]
        return code, d2


def _in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def _assigner(balls: list[Ball], width: int, with_vectors: bool) -> Callable:
    """Rows (id, label, q, code, d2) with new code and d2; without codes yet, every entry is compared."""
    parts = len(balls)

    def lists(columns: list[np.ndarray], n: int) -> pa.Array:
        flat = np.stack(columns, axis=1).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in _in_steps(batches):
            x = _cut(batch.column("q"), parts, width)
            if balls[0].reach is None:
                found = [_nearest(x[p], balls[p].entries) for p in range(parts)]
            else:
                known = known or [_Neighbours(ball) for ball in balls]
                code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                d2 = batch.column("d2").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                found = [known[p].assign(x[p], code[:, p], d2[:, p]) for p in range(parts)]
            n = batch.num_rows
            columns = [batch.column(c) for c in (("id", "label", "q") if with_vectors else ("id", "label"))]
            names = ["id", "label", "q", "code", "d2"] if with_vectors else ["id", "label", "code", "d2"]
            columns += [lists([c for c, _ in found], n), lists([d for _, d in found], n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _summer(parts: int, entries: int, width: int) -> Callable:
    """Per task: (part, entry, place, value) with sums of components, counts and largest squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        radius = np.zeros((parts, entries), np.int64)
        for batch in _in_steps(batches):
            x = _cut(batch.column("q"), parts, width)
            code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            d2 = batch.column("d2").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                have, first = np.unique(code[order, p], return_index=True)
                if width:
                    sums[p, have] += np.add.reduceat(x[p][order], first, axis=0)
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.maximum.at(radius[p], code[:, p], d2[:, p])
        part, entry = np.nonzero(counts)
        for place in (COUNT, RADIUS, *range(width)):
            value = counts if place == COUNT else radius if place == RADIUS else sums[:, :, place]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(np.full(len(part), place, np.int32)),
                    pa.array(value[part, entry]),
                ],
                names=["part", "entry", "place", "value"],
            )

    return run


def _moved(state: DataFrame, entries: np.ndarray) -> list[Ball]:
    """The balls after the entries moved to the means of their parts.

    A task sends one row per entry and component, whatever its rows; what reaches the driver
    is one number per entry and component.
    """
    parts, n, width = entries.shape
    totals = (
        state.mapInArrow(_summer(parts, n, width), "part int, entry int, place int, value long")
        .groupBy("part", "entry", "place")
        .agg(F.try_sum("value").alias("sum"), F.max("value").alias("max"))
        .collect()
    )
    counts = np.zeros((parts, n), np.int64)
    radius = np.zeros((parts, n), np.int64)
    sums = np.zeros(entries.shape, np.int64)
    for row in totals:
        if row["place"] == COUNT:
            counts[row["part"], row["entry"]] = row["sum"]
        elif row["place"] == RADIUS:
            radius[row["part"], row["entry"]] = row["max"]
        else:
            sums[row["part"], row["entry"], row["place"]] = row["sum"]
    after = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], entries)
    way = np.sqrt(((after - entries) ** 2).sum(axis=2).astype(np.float64))
    reach = np.sqrt(radius.astype(np.float64)) + way
    return [Ball(after[p], reach[p], (after[p] != entries[p]).any(axis=1)) for p in range(parts)]


def fit_codes(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codebooks:
    """Codebooks of all rows, and the code of each row.

    Rows whose vector is null or holds null or non-finite components are left out; empty vectors
    have parts without components and index 0. The codebooks start from the `entries` rows first
    in the order of vec_id (null last; repeated ids by their components); with fewer rows they
    are smaller. Repeated rows count each. An empty table gives codebooks without entries and no
    codes. Vectors of different lengths, of a length that is no multiple of `parts`, or
    with components of 2^14 and more in size raise an error. Other columns play no part.
    """
    vectors = integer_vectors(rows, vec_id, vector, label)
    code_fields = [T.StructField(name, T.ArrayType(T.LongType())) for name in ("code", "d2")]
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        schema = T.StructType([*vectors.schema.fields[:2], *code_fields])
        return Codebooks(np.zeros((parts, 0, 0), np.int64), rows.sparkSession.createDataFrame([], schema))
    lengths = {len(row["q"]) for row in first}
    if len(lengths) > 1 or min(lengths) % parts:
        raise ValueError("vectors must have one length, a multiple of the number of parts")
    width = lengths.pop() // parts
    books = _cut(pa.array([row["q"] for row in first], pa.list_(pa.int64())), parts, width)
    balls = [Ball(books[p]) for p in range(parts)]
    full = T.StructType([*vectors.schema.fields, *code_fields])
    last = T.StructType([*vectors.schema.fields[:2], *code_fields])
    state = vectors
    for _ in range(rounds):
        state = stored(state.mapInArrow(_assigner(balls, width, True), full), "ball-codes")
        balls = _moved(state, np.stack([ball.entries for ball in balls]))
    coded = stored(state.mapInArrow(_assigner(balls, width, False), last), "ball-codes")
    return Codebooks(np.stack([ball.entries for ball in balls]), coded)


def decoded(codes: DataFrame, entries: np.ndarray) -> DataFrame:
    """The rows of codes with `vector`: the entries of the code one after the other, in the scale of the input."""
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            near = np.concatenate([entries[p][code[:, p]] for p in range(parts)], axis=1) / SCALE
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (parts * width))
            column = pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields]).add("vector", T.ArrayType(T.DoubleType())))


def with_label_error(codes: DataFrame) -> DataFrame:
    """The rows of codes with error (d2 of all parts) and label_error (error summed over equal labels, nulls together).

    Labels are added up before they move; the sums are written, so that Spark knows their size
    before it chooses how to join them.
    """
    rows = codes.withColumn("error", F.aggregate("d2", F.lit(0).cast("long"), lambda total, x: total + x))
    sums = stored(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").drop("l")


def code_text(code: Column) -> Column:
    """Two hexadecimal digits per index."""
    return F.array_join(F.transform(code, lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
