"""Vector codes against plain k-means, with integers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import ball_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{id: [(code, distances)]} and the entries, comparing every part with every entry."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(1024 * x)) for x in r[1]]))
    q = np.array([[int(np.floor(1024 * x)) for x in v] for _, v in kept], dtype=np.int64)
    w = q.shape[1] // parts
    codes, dists, books = [], [], []
    for p in range(parts):
        x = q[:, p * w : (p + 1) * w]
        book = x[:entries].copy()
        for step in range(rounds + 1):
            d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if step < rounds:
                for e in set(code.tolist()):
                    mine = x[code == e]
                    book[e] = mine.sum(axis=0) // len(mine)
        codes.append(code), dists.append(d[np.arange(len(x)), code]), books.append(book)
    return [r[0] for r in kept], np.array(codes).T, np.array(dists).T, np.array(books)


def check(spark, rows, dims_rows=None, **options):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    books = ball_codes.fit_codes(table.repartition(3), **options)
    ids, codes, dists, entries = plain_codes(rows, **options)
    got = sorted((r.id is None, r.id or 0, tuple(r.code), tuple(r.d2)) for r in books.codes.collect())
    want = sorted((i is None, i or 0, tuple(c), tuple(d)) for i, c, d in zip(ids, codes.tolist(), dists.tolist(), strict=True))
    assert got == want
    assert np.array_equal(books.entries, entries)


@pytest.mark.parametrize("seed,n,dims,spread", [(1, 700, 16, 0.02), (2, 400, 8, 1.0), (3, 300, 12, 0.0), (4, 900, 4, 0.3)])
def test_equal_to_plain_k_means(spark, seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, (centres[rng.integers(12)] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]
    check(spark, rows, entries=40)


def test_ties_and_few_levels(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 0, 1]) / 1024 for _ in range(8)]) for i in range(500)]
    check(spark, rows, entries=30)


def test_fewer_rows_than_entries_nulls_and_repeats(spark):
    rows = [(i, [i / 7, -i / 3, 0.0, 1.0]) for i in range(20)]
    rows += [(3, [3 / 7, -1.0, 0.0, 1.0]), (3, [3 / 7, -1.0, 0.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0])]
    check(spark, rows)


def test_rounds_beyond_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * 3000).tolist()) for i in range(200)]
    check(spark, rows, entries=20)


def test_only_rings_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 8)) * 5000
    x = (centres[rng.integers(50, size=3000)] + rng.normal(size=(3000, 8)) * 100).astype(np.int64)
    entries = centres.astype(np.int64)
    code, d2 = ball_codes._nearest(x, entries)
    radius = np.zeros(50)
    np.maximum.at(radius, code, np.sqrt(d2))
    moved = np.zeros(50, bool)
    after = entries.copy()
    after[7] += 3
    moved[7] = True
    balls = ball_codes._Neighbours(ball_codes.Ball(after, radius + 6, moved))
    cells = []
    plain = ball_codes._distances

    def counted(a, b):
        cells.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(ball_codes, "_distances", counted)
    got = balls.assign(x, code, d2)
    assert sum(cells) < 3000 * 50 / 10
    want = ball_codes._nearest(x, after)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_empty_table_and_empty_vectors(spark):
    none = ball_codes.fit_codes(spark.createDataFrame([], SCHEMA))
    assert none.entries.size == 0 and none.codes.count() == 0
    rows = spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)
    found = ball_codes.fit_codes(rows).codes.collect()
    assert [list(r.code) for r in found] == [[0] * 4] * 2


def test_unequal_lengths_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA)
    with pytest.raises(ValueError):
        ball_codes.fit_codes(rows)


def test_label_errors_decoding_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), [None, 1, 2][i % 3]) for i in range(90)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "code", "d2", "error", "l", "part")})
    books = ball_codes.fit_codes(table, entries=5)
    found = ball_codes.with_label_error(books.codes).collect()
    sums = {}
    for r in found:
        sums[r.label] = sums.get(r.label, 0) + sum(r.d2)
    assert len(found) == 90 and all(r.error == sum(r.d2) and r.label_error == sums[r.label] for r in found)
    for r in ball_codes.decoded(books.codes, books.entries).collect():
        want = np.concatenate([books.entries[p][r.code[p]] for p in range(4)]) / 1024
        assert np.allclose(r.vector, want)
    text = books.codes.select("code", ball_codes.code_text(F.col("code")).alias("t")).collect()
    assert all(r.t == bytes(r.code).hex() for r in text)
