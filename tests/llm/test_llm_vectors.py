"""Lattice hashing and multi-index hashing against brute force."""

import itertools
import math

import numpy as np
import pytest

from factlake.llm import hamming, lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    for i in range(0, n, 3):
        # near copies at cosines around the threshold
        base[i] = base[(i * 7) % n] + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.3, 0.35])
    return base.astype(np.float32)


def odd_rows(d):
    good = [0.5] * d
    return [
        (5000, None, 1), (5001, [0.0] * d, 1), (5002, [float("nan")] + good[1:], 1),
        (5003, [float("inf")] + good[1:], 1), (5004, [None] + good[1:], 1), (5005, [], 1),
        (5006, good, 1), (5007, good, 1), (5008, [0.25] * d, None), (5009, [0.5] * (d - 1), 1), (5010, [-0.5] * d, 1),
    ]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, least=0.95):
    good = [(i, r[0], np.array(r[1], dtype=np.float64)) for i, r in enumerate(rows) if usable(r[1])]
    links = []
    for (i, _, a), (j, _, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
            links.append((i, j))
    return links


@pytest.mark.parametrize("d", [64, 6])
def test_near_duplicates(spark, d):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors(d=d))] + odd_rows(d)
    rows += [rows[5], rows[5], (77, rows[5][1], 2)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    links = brute_links(rows)
    true = {i: set() for i in range(len(rows))}
    for i, j in links:
        true[i].add(j)
        true[j].add(i)
    found = sum(r.n_links for r in got) / 2
    assert 0.95 * len(links) <= found <= len(links)
    # no link that is not there: counts never exceed the true ones
    most = {}
    for i, r in enumerate(rows):
        most.setdefault(r[0], []).append(len(true[i]))
    for r in got:
        assert r.n_links <= max(most[r.vec_id]) and r.kept == (r.component_id == r.vec_id)
    alone = {r.vec_id: r for r in got}
    for i in (5000, 5001, 5002, 5003, 5004, 5005, 5009, 5010):
        assert (alone[i].n_links, alone[i].component_id, alone[i].kept) == (0, i, True)
    assert {alone[i].n_links for i in (5006, 5007, 5008)} == {2} and {alone[i].component_id for i in (5007, 5008)} == {5006}


def test_large_cells_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * 0.02).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(32).tolist(), 0) for i in range(100)]
    whole = {r.vec_id: tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(lattice, "BLOCK", 64)
    monkeypatch.setattr(lattice, "STRIPE", 16)
    cut = {r.vec_id: tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert whole == cut
    assert all(whole[i][1:3] == (299, 0) for i in range(300))


def test_near_duplicates_of_no_rows(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], SCHEMA)
    assert {(r.vec_id, r.n_links, r.kept) for r in lattice.near_duplicates(none).collect()} == {(1, 0, True), (None, 0, True)}


def test_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (200, 8))
    near = lattice.nearest_point(x)
    twice = np.rint(near * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (near.sum(axis=1) % 2 == 0)).all()
    # no shorter way by any of the shortest lattice vectors
    for v in lattice._NEIGHBOURS:
        assert (((x - near) ** 2).sum(axis=1) <= ((x - near - v) ** 2).sum(axis=1) + 1e-9).all()
    assert len(lattice._NEIGHBOURS) == 240


def brute_nearest(rows, k, every):
    good = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and usable(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            scores = sorted((-float(x @ v), i) for i, v in good.items() if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_finds_most(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors(800, 48, 4) * 3)] + [
        (5000 + 20 * i, r[1], 0) for i, r in enumerate(odd_rows(48))
    ]
    rows += [(None, rows[0][1], 1), rows[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hamming.nearest(df, df.vec_id % 20 == 0, 10).collect()
    want = brute_nearest(rows, 10, 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {q for q in want if want[q]}
    hits = total = 0
    for q, found in by.items():
        assert len(found) == len(want[q]) and q not in dict(found) and len(dict(found)) == len(found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s <= t + 1e-9 for (_, s), (_, t) in zip(found, want[q], strict=True))
        hits += len(set(dict(found)) & set(dict(want[q])))
        total += len(found)
    assert hits >= 0.93 * total


def test_nearest_with_few_rows_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i < 6 else [0.0, float(i)], 0) for i in range(9)] + [(40, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hamming.nearest(df, df.vec_id % 20 == 0, 20).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 9))
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == [1.0] * 5 + [0.0] * 3
    few = hamming.nearest(df, df.vec_id % 20 == 0, 3).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]


def test_nearest_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hamming.nearest(df, df.vec_id % 20 == 0, 5).count() == 0


def plain_index(x, seed=9):
    rng = np.random.default_rng(seed)
    most = float(np.sqrt((x * x).sum(axis=1)).max())
    lack = np.sqrt(np.maximum(0, most**2 - (x * x).sum(axis=1)))
    full = np.c_[x, lack] / most
    centre = full.mean(axis=0)
    made = hamming.Codes(centre, hamming._rotations(full - centre, rng), most, np.zeros(0), np.zeros(0))
    ends, radii = hamming._steps(x, made)
    return hamming.Index(np.arange(len(x)), x, hamming.replace(made, angles=ends, radii=radii))


def test_probing_finds_every_code_within_the_radius():
    x = np.random.default_rng(9).standard_normal((400, 24))
    index = plain_index(x)
    for code in index.model.queries(x[:20]):
        apart = np.array([bin(int.from_bytes((code ^ c).tobytes(), "little")).count("1") for c in index.codes])
        for radius in (0, 7, 15, 16, 40, 99, 130, 256):
            met = [r for near in index.probe(code, lambda: radius) for r in near]
            assert len(met) == len(set(met)) and set(met) == set(np.flatnonzero(apart <= radius))


def test_radii_hold_the_pairs_of_their_angles():
    index = plain_index(np.random.default_rng(3).standard_normal((600, 32)))
    assert (np.diff(index.model.angles) >= 0).all() and (np.diff(index.model.radii) >= 0).all()
    assert index.model.radius(-np.inf, 1.0) == hamming.CODE_BITS
    assert index.model.radius(1e9, 1.0) <= index.model.radius(0.1, 1.0)


def test_only_what_is_retrieved_is_scored():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 48)) * 2
    x = np.repeat(centres, 30, axis=0) + rng.standard_normal((3000, 48)) * 0.2
    index = plain_index(x)
    hits = 0
    for i in range(0, 3000, 60):
        ids, scores = index.search(i, x[i], -np.inf, 10)
        every = x @ x[i]
        every[i] = -np.inf
        assert np.allclose(scores, every[ids]) and (np.diff(scores) <= 0).all()
        hits += len(set(ids) & set(np.argsort(-every)[:10]))
    assert hits >= 0.95 * 50 * 10
    assert index.scored <= 0.1 * 50 * 3000
