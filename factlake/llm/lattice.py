"""Near-duplicate vectors by lattice hashing.

In each of TABLES tables a vector is projected at random to eight dimensions, and the nearest
point of the E8 lattice is its cell. It also probes the PROBES neighbouring cells that lie
nearest. Two vectors meet where one's cell is the cell, or a probed cell, of the other; those
that meet are verified by their cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import mixed, signed, stored
from factlake.llm.components import components
from factlake.llm.vectors import by_dimension, unit, usable, usable_vectors

TABLES = 4
PROBES = 4
# Width of the lattice against the spread of a projected unit vector.
WIDTH = 1.6
# Vectors of a cell that one task compares with as many others; larger cells are cut in blocks.
BLOCK = 4096
STRIPE = 512
MIN_COSINE = 0.95


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


_NEIGHBOURS = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _cell_codes(points: np.ndarray, table: int, dimension: int) -> np.ndarray:
    code = np.full(points.shape[:-1], mixed(np.array([table * 65537 + dimension], dtype=np.uint64))[0], dtype=np.uint64)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + twice[..., k])
    return signed(code)


def cells(vectors: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(home, probed) cell codes of unit vectors: one per table, and PROBES per table."""
    dimension = vectors.shape[1]
    home = np.empty((len(vectors), TABLES), dtype=np.int64)
    probed = np.empty((len(vectors), TABLES, PROBES), dtype=np.int64)
    for t in range(TABLES):
        spread = np.random.default_rng([seed, t, dimension]).standard_normal((dimension, 8))
        if dimension >= 8:
            spread = np.linalg.qr(spread)[0] * np.sqrt(dimension)
        x = vectors @ spread / WIDTH
        point = nearest_point(x)
        home[:, t] = _cell_codes(point, t, dimension)
        gain = (x - point) @ _NEIGHBOURS.T
        best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
        probed[:, t] = _cell_codes(point[:, None, :] + _NEIGHBOURS[best], t, dimension)
    return home, probed


def _placed(with_vector: bool):
    """(cell, at home, node, times, v) for each cell that a vector is in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                for rows, matrix in by_dimension(part.column(2)):
                    home, probed = cells(unit(matrix))
                    codes = np.concatenate([home[:, :, None], probed], axis=2).reshape(len(rows), -1)
                    take = pa.array(np.repeat(rows, codes.shape[1]))
                    at_home = np.tile(np.arange(1 + PROBES) == 0, len(rows) * TABLES)
                    columns = [pa.array(codes.ravel())]
                    if with_vector:
                        columns += [pa.array(at_home), *(part.column(i).take(take) for i in range(3))]
                    names = ["cell", "at_home", "node", "times", "v"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _within(codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    return (codes[:, None] == lists).any(axis=1)


def _first_meeting(a, b, cell, home, probed) -> np.ndarray:
    """Whether `cell` is the first place where a and b (a the smaller node) meet: by table, then a's cell before b's."""
    met = np.zeros(len(a), dtype=bool)
    first = np.zeros(len(a), dtype=bool)
    for t in range(TABLES):
        ha, hb = home[a, t], home[b, t]
        in_a = (ha == hb) | _within(ha, probed[b, t])
        in_b = ~in_a & _within(hb, probed[a, t])
        first |= ~met & ((in_a & (ha == cell)) | (in_b & (hb == cell)))
        met |= in_a | in_b
    return first


def _labels(n: int, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Smallest node of each row's connected part."""
    low = node.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        if (low == before).all():
            return low


def _verify(cell, node, times, at_home, block, same, column, min_cosine):
    """(node, linked, low) of the members of one cell that have links in it."""
    out = []
    for rows, matrix in by_dimension(column):
        if len(rows) < 2:
            continue
        vectors = unit(matrix)
        home, probed = cells(vectors)
        mine, count, here, part = node[rows], times[rows], at_home[rows], block[rows]
        linked = np.zeros(len(rows), dtype=np.int64)
        from_, to = [], []
        for begin in range(0, len(rows), STRIPE):
            stripe = slice(begin, begin + STRIPE)
            near = vectors[stripe] @ vectors.T >= min_cosine
            near &= mine[stripe][:, None] < mine[None, :]
            near &= here[stripe][:, None] | here[None, :]
            if not same:
                near &= part[stripe][:, None] != part[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a += begin
            first = _first_meeting(a, b, cell, home, probed)
            np.add.at(linked, a[first], count[b[first]])
            np.add.at(linked, b[first], count[a[first]])
            from_.append(a)
            to.append(b)
        if from_:
            low = _labels(len(rows), np.concatenate(from_), np.concatenate(to), mine)
            some = (linked > 0) | (low != mine)
            out.append((mine[some], linked[some], low[some]))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first columns, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(values[:, begin])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            parts = [np.concatenate([f[i] for f in found]) for i in range(3)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["node", "linked", "low"])

        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            column = {c: group.column(c).combine_chunks() for c in group.column_names}
            array = {c: column[c].to_numpy(zero_copy_only=False) for c in ("node", "times", "at_home", "block")}
            if not array["at_home"].any():
                continue
            found += _verify(
                group.column("cell")[0].as_py(),
                array["node"], array["times"], array["at_home"].astype(bool), array["block"],
                group.column("x")[0].as_py() == group.column("y")[0].as_py(),
                column["v"], min_cosine,
            )
            if len(found) >= 256:
                yield flush()
        if found:
            yield flush()

    return run


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    as do vectors of different dimensions with each other; such a row has no links, is its own
    component and is kept. Equal vectors are compared once and always linked; each repeated row
    counts as a vector. Ties at min_cosine link. An empty table gives none; other columns are
    not looked at. A null vec_id takes part in nothing and is kept.
    """
    distinct = stored(
        usable_vectors(rows, vec_id, vector).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")).select("node", "times", "v"),
        "vectors",
    )
    kind = distinct.schema["v"].dataType.simpleString()
    sizes = distinct.mapInArrow(_placed(False), "cell long").groupBy("cell").count()
    hot = stored(sizes.where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    placed = distinct.mapInArrow(_placed(True), f"cell long, at_home boolean, node long, times long, v {kind}")
    placed = placed.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    pairs = placed.select(
        "cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "at_home", "node", "times", "block", "v",
    )
    linked = stored(
        pairs.repartition("cell", "x", "y")
        .sortWithinPartitions("cell", "x", "y")
        .mapInArrow(_linked(min_cosine), "node long, linked long, low long"),
        "linked",
    )
    counts = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    joined = components(linked.select(F.col("node").alias("a"), F.col("low").alias("b")))
    nodes = (
        distinct.select("node", "times")
        .join(counts, "node", "left")
        .join(joined, "node", "left")
        .select(
            "node",
            (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    # a row finds its node by its vector, so ids that are repeated with other vectors stay apart
    taking_part = F.col("vec_id").isNotNull() & usable(F.col("v"))
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        .withColumn("v", F.when(taking_part, F.col("v")))
        .join(distinct.select("v", "node"), "v", "left")
        .join(nodes, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
