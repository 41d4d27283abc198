"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned on a bounded sample (iterative
quantisation). Codes are cut into substrings, each with an index of its values. Within a
Hamming radius r two codes agree up to r / SUBSTRINGS bits in one substring at least, so
looking up the values that near, in every index, retrieves every code within r. What is
retrieved is ranked by the inner product of the vectors; no other vector is looked at.

A query's radius grows bit by bit of a substring. It ends where it holds the codes of the
vectors as near as the k-th best so far: how far codes of such an angle lie apart is measured
on the sample. The k-th best of the sample is the first bar, and what a block yields raises it.
Queries with too few finds are asked again without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.llm.common import sample_order, stored
from factlake.llm.vectors import by_dimension, usable_vectors

# The bounded sample that the rotations, the radii and the first bars come from.
SAMPLE = 4096
SAMPLE_QUERIES = 256
CODE_BITS = 256
SUBSTRING_BITS = 16
ROUNDS = 20
# Share of the sample's pairs of an angle that must lie within the radius for it.
WITHIN = 0.97
# The nearest pairs of the sample are the first step of angles; every other step holds GROWTH times as many.
FIRST_PAIRS = 256
GROWTH = 1.4
# Vectors that one task searches, and queries compared with the sample at a time.
BLOCK_ROWS = 1 << 16
# Queries that are worth an index of their own, where tasks would be idle otherwise.
SHARE = 256
STRIPE = 256
# Scores nearer than this to the last one are computed again before ranking.
SLACK = 1e-9

_VALUES = np.arange(1 << SUBSTRING_BITS, dtype=np.int64)
_ONES = np.bitwise_count(_VALUES)
# Values by their number of bits: what a substring is changed by to reach those so far away.
_MASKS = [_VALUES[_ONES == e] for e in range(SUBSTRING_BITS + 1)]


@dataclass(frozen=True)
class Codes:
    """Rotations, the centre they are about, the largest norm, and the radius for each step of angles."""

    centre: np.ndarray
    rotations: np.ndarray
    largest: float
    angles: np.ndarray
    radii: np.ndarray

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of vectors, with the lack of norm as one more component: then the inner product orders like the angle."""
        lack = np.sqrt(np.maximum(0.0, self.largest**2 - (vectors * vectors).sum(axis=1)))
        return self._packed(np.concatenate([vectors, lack[:, None]], axis=1) / self.largest)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return self._packed(np.concatenate([vectors / length, np.zeros((len(vectors), 1))], axis=1))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.centre) @ self.rotations >= 0
        return np.packbits(bits, axis=1).view(np.uint16)

    def radius(self, bar: float, length: float) -> int:
        """The radius that holds codes of vectors with an inner product of `bar` or more with a query of this length."""
        if bar == -np.inf:
            return CODE_BITS
        angle = np.arccos(np.clip(bar / (length * self.largest), -1.0, 1.0))
        step = int(np.searchsorted(self.angles, angle))
        return int(self.radii[step]) if step < len(self.radii) else CODE_BITS


def _rotations(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns of rotations that bring the rows of x near to sign vectors, CODE_BITS in all."""
    dimension = x.shape[1]
    found = []
    while sum(r.shape[1] for r in found) < CODE_BITS:
        turn = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
        for _ in range(ROUNDS):
            signs = np.where(x @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ signs)
            turn = u @ v
        found.append(turn)
    return np.concatenate(found, axis=1)[:, :CODE_BITS]


def _apart(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    return np.bitwise_count(queries.view(np.uint64) ^ rows.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _steps(x: np.ndarray, made: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of steps of angles between rows of the sample, and a radius for each that never falls."""
    queries = x[:SAMPLE_QUERIES]
    length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    angle = np.arccos(np.clip(queries @ x.T / (length * made.largest), -1.0, 1.0))
    rows = made.rows(x)
    apart = np.stack([_apart(q, rows) for q in made.queries(queries)])
    others = ~np.eye(len(queries), len(x), dtype=bool)
    angle, apart = angle[others], apart[others]
    order = np.argsort(angle, kind="stable")
    angle, apart = angle[order], apart[order]
    ends, radii, begin, size = [], [], 0, FIRST_PAIRS
    while begin < len(angle):
        end = min(len(angle), begin + int(size))
        ends.append(angle[end - 1])
        radii.append(np.ceil(np.quantile(apart[begin:end], WITHIN)))
        begin, size = end, size * GROWTH
    return np.array(ends), np.maximum.accumulate(np.array(radii, dtype=np.int64))


def fit(vectors: DataFrame, seed: int = 5) -> dict[int, tuple[Codes, np.ndarray, np.ndarray]]:
    """Codes for each dimension of the usable (vec_id, v) rows, with the ids and vectors of the sample they come from.

    The sample has at most SAMPLE rows, in seeded order.
    """
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    largest = {r["d"]: r["m"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.max(norm).alias("m")).collect()}
    sample = vectors.orderBy(sample_order(F.col("vec_id"), seed), "vec_id").limit(SAMPLE).collect()
    fitted = {}
    for dimension, most in largest.items():
        ours = [r for r in sample if len(r["v"]) == dimension]
        ids = np.array([r["vec_id"] for r in ours], dtype=np.int64)
        known = np.array([r["v"] for r in ours], dtype=np.float64).reshape(-1, dimension)
        rng = np.random.default_rng([seed, dimension])
        x = known if len(known) else rng.standard_normal((1, dimension))
        most = max(most, 1e-300)
        lack = np.sqrt(np.maximum(0.0, most**2 - (x * x).sum(axis=1)))
        full = np.concatenate([x, lack[:, None]], axis=1) / most
        centre = full.mean(axis=0)
        none = np.zeros(0)
        made = Codes(centre, _rotations(full - centre, rng), most, none, none)
        if len(known) > 1:
            angles, radii = _steps(known, made)
            made = replace(made, angles=angles, radii=radii)
        fitted[dimension] = (made, ids, known)
    return fitted


def _bars(fitted: dict[int, tuple[Codes, np.ndarray, np.ndarray]], k: int):
    """(vec_id, v, bar): each query with its k-th best inner product in the sample, without its own id."""
    samples = {}
    for dimension, (_, ids, known) in fitted.items():
        ids, first = np.unique(ids, return_index=True)
        samples[dimension] = ids, known[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bar = np.full(batch.num_rows, -np.inf)
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            for places, matrix in by_dimension(batch.column(1)):
                ids, known = samples[matrix.shape[1]]
                if len(ids) <= k:
                    continue
                for begin in range(0, len(places), STRIPE):
                    rows = places[begin : begin + STRIPE]
                    scores = matrix[begin : begin + STRIPE] @ known.T
                    scores[asked[rows][:, None] == ids] = -np.inf
                    bar[rows] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bar)], names=["vec_id", "v", "bar"])

    return run


class Index:
    """Vectors of one block: their codes, and for each substring the rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.model = ids, vectors, codes
        self.codes = codes.rows(vectors)
        self.repeated = len(np.unique(ids)) < len(ids)
        self.scored = 0  # inner products computed so far
        values = 1 << SUBSTRING_BITS
        parts = self.codes.shape[1]
        self.order = np.argsort(self.codes, axis=0, kind="stable").T.ravel()
        # rows of value v in substring s: order[starts[s * values + v] : starts[s * values + v + 1]]
        keys = self.codes.T.astype(np.int64) + (np.arange(parts) * values)[:, None]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys.ravel(), minlength=parts * values))]).astype(np.int32)

    def _holders(self, code: np.ndarray, changed: int, parts: int) -> np.ndarray:
        """Rows that differ from the code in exactly `changed` bits of one of the first substrings."""
        values = code[:parts, None].astype(np.int64) ^ _MASKS[changed]
        values += (np.arange(parts) << SUBSTRING_BITS)[:, None]
        begin = self.starts[values].ravel()
        count = self.starts[values + 1].ravel() - begin
        begin, count = begin[count > 0], count[count > 0]
        shift = np.repeat(begin - (np.cumsum(count) - count), count)
        return self.order[shift + np.arange(len(shift))]

    def probe(self, code: np.ndarray, need) -> Iterator[np.ndarray]:
        """Rows whose codes lie within need() bits, each once, from near to far; need() may fall while they are taken."""
        parts = len(code)
        unmet, given = CODE_BITS + 1, CODE_BITS + 2
        apart = np.full(len(self.ids), unmet)
        for changed in range(SUBSTRING_BITS + 1):
            # pigeonhole: beyond radius parts * changed - 1 only the first `more` substrings are needed
            more = min(parts, need() - parts * changed + 1)
            if more <= 0:
                return
            met = np.zeros(len(self.ids), dtype=bool)
            met[self._holders(code, changed, more)] = True
            fresh = np.flatnonzero(met & (apart == unmet))
            apart[fresh] = _apart(code, self.codes[fresh])
            near = np.flatnonzero(apart <= min(need(), parts * (changed + 1) - 1, CODE_BITS))
            apart[near] = given
            if len(near):
                yield near

    def search(self, asked: int, vector: np.ndarray, bar: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vec ids and scores of the k best rows retrieved for a query; `bar` is a score that k rows reach somewhere."""
        length = float(np.sqrt((vector * vector).sum()))
        slack = SLACK * self.model.largest * length
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        need = self.model.radius(bar, length)
        for near in self.probe(self.model.queries(vector[None])[0], lambda: need):
            near = near[self.ids[near] != asked]
            self.scored += len(near)
            rows, scores = np.concatenate([rows, near]), np.concatenate([scores, self.vectors[near] @ vector])
            each = self._best_of_ids(rows, scores) if self.repeated else scores
            if len(each) >= k:
                last = np.partition(each, len(each) - k)[len(each) - k]
                keep = scores >= last - slack
                rows, scores = rows[keep], scores[keep]
                if last > bar:
                    bar = last
                    need = min(need, self.model.radius(bar, length))
        exact = np.zeros(len(rows))
        for d in range(len(vector)):  # one order of adding for every pair, so that equal vectors tie
            exact += vector[d] * self.vectors[rows, d]
        best = np.lexsort((self.ids[rows], -exact))
        if self.repeated:
            best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])]
        return self.ids[rows[best[:k]]], exact[best[:k]]

    def _best_of_ids(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        order = np.lexsort((-scores, self.ids[rows]))
        return scores[order][np.unique(self.ids[rows][order], return_index=True)[1]]


def _searched(codes: dict[int, Codes], k: int):
    """(query_id, vec_id, score) from rows ordered by block, with a block's vectors before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        held: dict[int, list] = {}
        indexes: dict[int, Index] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if block[begin] != at:
                    at, held, indexes = block[begin], {}, {}
                part = batch.slice(begin, end - begin)
                ids = part.column(2).to_numpy(zero_copy_only=False)
                bars = part.column(4).to_numpy(zero_copy_only=False)
                for rows, matrix in by_dimension(part.column(3)):
                    d = matrix.shape[1]
                    if not asks[begin]:
                        held.setdefault(d, []).append((ids[rows], matrix))
                        continue
                    if d in held:
                        indexes[d] = Index(*(np.concatenate(p) for p in zip(*held.pop(d), strict=True)), codes[d])
                    if d not in indexes:
                        continue
                    found = [(i, *indexes[d].search(i, v, b, k)) for i, v, b in zip(ids[rows], matrix, bars[rows], strict=True)]
                    asked = np.repeat(ids[rows], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2))],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def _round(vectors: DataFrame, queries: DataFrame, codes: dict[int, Codes], k: int, blocks: int, shares: int) -> DataFrame:
    """Each block meets all queries; with fewer blocks than tasks, in `shares` tasks that take a part of the queries each."""
    block = F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)") * shares
    in_all = F.explode(F.sequence(block, block + shares - 1)).alias("block")
    share = F.expr(f"cast(pmod(xxhash64(vec_id, 1), {shares}) as int)")
    to_all = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * shares + share)).alias("block")
    rows = vectors.select(in_all, F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("bar")).union(
        queries.select(to_all, F.lit(True).alias("asks"), "vec_id", "v", "bar")
    )
    return (
        rows.repartition("block")
        .sortWithinPartitions("block", "asks")
        .mapInArrow(_searched(codes, k), "query_id long, vec_id long, score double")
    )


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product) of the k nearest found rows of each query.

    The rows where is_query holds are asked against all rows but those with their own vec_id;
    equal scores go to the smaller vec_id. Vectors that are null, empty, zero or hold null or
    non-finite components, and null ids, take no part; vectors of another dimension are no
    candidates. A query gets all candidates if there are fewer than k. Rows repeated with one
    vec_id are one candidate (the best) and one query. An empty table gives none. Queries are repeated once per block; vectors only
    while the table has fewer blocks than there are tasks.
    """
    known = usable_vectors(rows, vec_id, vector)
    fitted = fit(known)
    codes = {d: made for d, (made, _, _) in fitted.items()}
    asked = usable_vectors(rows.where(is_query), vec_id, vector).dropDuplicates(["vec_id"])
    kind = asked.schema["v"].dataType.simpleString()
    asked = stored(asked.mapInArrow(_bars(fitted, k), f"vec_id long, v {kind}, bar double"), "asked")
    sizes = {r["d"]: r["n"] for r in known.groupBy(F.size("v").alias("d")).agg(F.countDistinct("vec_id").alias("n")).collect()}
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-sum(sizes.values()) // BLOCK_ROWS))
    shares = max(1, min(parallel // blocks, -(-asked.count() // SHARE)))
    best = stored(_ranked(_round(known, asked, codes, k, blocks, shares), k), "nearest")
    wanted = F.lit(0)
    for d, n in sizes.items():
        wanted = F.when(F.size("v") == d, min(k, n - 1)).otherwise(wanted)
    got = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got"))
    missed = asked.join(got, "vec_id", "left").where(F.coalesce("got", F.lit(0)) < wanted)
    short = stored(missed.select("vec_id", "v", F.lit(-float("inf")).alias("bar")), "short")
    if short.isEmpty():
        return best
    # without a bar a block gives k rows, or all it has
    again = _ranked(_round(known, short, codes, k, blocks, shares), k)
    return best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
