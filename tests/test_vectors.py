import numpy as np
import pytest

from factlake.operators import vectors as V

RNG = np.random.default_rng(11)


def unit(matrix):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=matrix.copy(), where=norms > 0)


def brute(vectors, queries, k, names):
    scores = np.round(unit(queries) @ unit(vectors).T, 6)
    out = {}
    for q, line in enumerate(scores):
        order = sorted(range(len(line)), key=lambda i: (-line[i], names[i]))[:k]
        out[q] = [(names[i], float(line[i])) for i in order]
    return out


def index(spark, vectors, names, kind):
    rows = [(n, [float(x) for x in v], f"label_{i % 3}", i) for i, (n, v) in enumerate(zip(names, vectors))]
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>, company string, page_num int").repartition(6)


def asked(spark, queries):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id int, query_vector array<float>")


def collected(hits):
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r.place):
        assert r.place == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_knn_like_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(V, "STRIPE", 4)
    vectors = RNG.integers(-4, 5, (300, 5)).astype("float32").astype(float)
    vectors[:100] = vectors[0]  # a third of all vectors are copies of one
    vectors[200] = 0
    queries = np.vstack([RNG.integers(-4, 5, (9, 5)).astype(float), vectors[0], np.zeros(5)])
    names = list(range(300)) if kind == "bigint" else [f"v{i}" for i in range(300)]
    hits = V.knn_cosine(index(spark, vectors, names, kind), asked(spark, queries), k=7, payload=("company",))
    labels = {n: f"label_{i % 3}" for i, n in enumerate(names)}
    assert all(r.company == labels[r.vec_id] for r in hits.collect())
    assert collected(hits) == brute(vectors, queries, 7, names)


def test_fewer_vectors_than_k_and_none(spark):
    vectors = np.eye(3)
    df = index(spark, vectors, [0, 1, 2], "bigint")
    assert collected(V.knn_cosine(df, asked(spark, vectors[:1]), k=9)) == brute(vectors, vectors[:1], 9, [0, 1, 2])
    assert V.knn_cosine(df, asked(spark, vectors[:1]).limit(0)).count() == 0
    assert V.knn_cosine(df.limit(0), asked(spark, vectors[:1])).count() == 0


def test_nan_takes_no_place(spark):
    vectors = RNG.normal(size=(40, 6))
    broken = [float("nan"), float("inf"), float("-inf")]
    rows = [[broken[i % 3], *v[1:]] if i < 9 else list(v) for i, v in enumerate(vectors.tolist())]
    df = index(spark, rows, list(range(40)), "bigint")
    good = vectors[9:].astype("float32").astype(float)
    q = spark.createDataFrame(
        [(0, rows[20]), (1, rows[3]), (2, None), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "query_id int, query_vector array<float>"
    )
    want = brute(good, good[11:12], 8, list(range(9, 40)))
    assert collected(V.knn_cosine(df, q, k=8)) == want


@pytest.mark.parametrize("block_bytes", [8 * 6 * 40, 1 << 25])
def test_clusters_copies_and_vectors_without_direction(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(V, "PIVOTS", 12)
    monkeypatch.setattr(V, "LEAST_ROWS", 20)
    monkeypatch.setattr(V, "SAMPLE", 100)
    monkeypatch.setattr(V, "RINGS", 64)
    centres = RNG.normal(size=(10, 6))
    vectors = centres[RNG.integers(10, size=900)] + RNG.normal(size=(900, 6)) * 0.02
    vectors[:300] = vectors[0]
    vectors[300:340] = 0
    vectors = vectors.astype("float32").astype(float)
    queries = np.vstack([vectors[::37], np.zeros((1, 6)), RNG.normal(size=(5, 6)).astype("float32").astype(float)])
    hits = V.knn_cosine(index(spark, vectors, list(range(900)), "bigint"), asked(spark, queries), k=6, block_bytes=block_bytes)
    assert collected(hits) == brute(vectors, queries, 6, list(range(900)))


def blocks_of(spark, vectors, queries, k, block_bytes):
    held = index(spark, vectors, list(range(len(vectors))), "bigint").selectExpr("vec_id AS __id", "CAST(embedding AS array<double>) AS __vector")
    blocks = V._fit_blocks(held, block_bytes)
    rows = held.selectExpr("__id", "pmod(xxhash64(__id), 2147483648L) AS __hash", "__vector").toArrow().to_batches()
    dealt = np.concatenate([b.column("__block").to_numpy() for b in V._dealer(blocks)(iter(rows))])
    names = V.pa.RecordBatch.from_pydict({"__query": list(range(len(queries))), "__vector": queries.tolist()})
    visits = sum(b.num_rows for b in V._asker(blocks, k)(iter([names])))
    return np.bincount(dealt, minlength=len(blocks.pivot)), visits / len(queries)


def test_blocks_are_bounded_and_most_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_ROWS", 50)
    sizes = []
    centres = RNG.normal(size=(30, 16))
    for n in (1500, 6000):
        vectors = centres[RNG.integers(30, size=n)] + RNG.normal(size=(n, 16)) * 0.05
        vectors[: n // 3] = vectors[0]
        held, visits = blocks_of(spark, vectors, vectors[::50], 5, 8 * 16 * 100)
        sizes.append(held.max())
        assert held.sum() == n and visits < len(held) / 2
    assert max(sizes) < 300  # whatever the rows


def test_many_queries_do_not_repeat_the_payload(spark):
    vectors = RNG.normal(size=(50, 4))
    queries = RNG.normal(size=(5000, 4))
    df = index(spark, vectors, list(range(50)), "bigint")
    hits = V.knn_cosine(df, asked(spark, queries), k=3, payload=("company",))
    exact = vectors.astype("float32").astype(float)
    assert collected(hits) == brute(exact, queries.astype("float32").astype(float), 3, list(range(50)))
    dealt = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "__block" in line and "Repartition" in line]
    assert dealt and not any("company" in line for line in dealt)


def test_wrong_width_is_an_error(spark):
    df = index(spark, np.eye(3), [0, 1, 2], "bigint")
    with pytest.raises(Exception, match="different lengths"):
        V.knn_cosine(df, asked(spark, np.eye(2))).collect()


def test_company_filter(spark):
    vectors = RNG.normal(size=(30, 4))
    df, q = index(spark, vectors, list(range(30)), "bigint"), asked(spark, vectors[:2])
    every = brute(vectors.astype("float32").astype(float), vectors[:2].astype("float32").astype(float), 8, list(range(30)))
    post = V.knn_company_filter(df, q, "LABEL_1", k=8)
    got = {}
    for r in sorted(post.collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: [v for v, _ in hits if v % 3 == 1] for i, hits in every.items()}
    pre = V.knn_company_filter(df, q, "label_1", k=8, mode="pre")
    assert all(len(h) == 8 and all(v % 3 == 1 for v, _ in h) for h in collected(pre).values())


def test_normalize(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "i int, embedding array<float>")
    got = {r.i: r.embedding for r in V.normalize_l2(df).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}


def test_term_vectors(spark):
    texts = ["copper price rose", "Copper  price rose", "unrelated words here", "copper", "a b a\tA", "", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    v = {r.i: None if r.embedding is None else dict(map(tuple, r.embedding)) for r in V.embed_terms(df).collect()}
    assert v[0] == v[1] and v[3] == {"copper": 1.0}
    assert v[0] == pytest.approx({"copper": 1 / 3**0.5, "price": 1 / 3**0.5, "rose": 1 / 3**0.5})
    assert v[4] == pytest.approx({"a": 3 / 10**0.5, "b": 1 / 10**0.5})
    assert v[5] == v[7] == {} and not v[6]
    assert "Python" not in V.embed_terms(df)._jdf.queryExecution().executedPlan().toString()


def chunk_index(spark):
    rows = [("d", 1, 0, "A", "copper prices rose"), ("d", 2, 0, "A", "copper"), ("e", 1, 0, "B", "copper"), ("e", 1, 1, "B", "tin")]
    return V.embed_terms(
        spark.createDataFrame(rows, "doc_id string, page_num int, chunk_idx int, company string, text string")
    )


def test_search_terms(spark):
    asked = spark.createDataFrame([(1, "Copper"), (2, "copper prices"), (3, "zinc"), (4, None)], "question_id int, text string")
    hits = V.search_terms(chunk_index(spark), asked, k=2).collect()
    got = {(r.question_id, r.place): (r.doc_id, r.page_num, r.score, r.text) for r in hits}
    assert got == {
        (1, 1): ("d", 2, 1.0, "copper"), (1, 2): ("e", 1, 1.0, "copper"),
        (2, 1): ("d", 1, round(2 / 6**0.5, 6), "copper prices rose"), (2, 2): ("d", 2, round(0.5**0.5, 6), "copper"),
    }


def test_adapt_schema(spark):
    def columns(spec, row):
        return V.adapt_index_schema(spark.createDataFrame([row], spec)).first().asDict()
    assert columns("page int, chunk string", (3, "c")) == {"page_num": 3, "text": "c"}
    assert columns("snippet string, content string", ("s", "c")) == {"text": "s", "content": "c", "page_num": -1}
    assert columns("x int", (1,)) == {"x": 1, "page_num": -1, "text": ""}


def test_snippets(spark):
    hits = spark.createDataFrame(
        [(1, i, "Acme" if i % 2 else None, i, f"t{i}", 1 / i) for i in range(1, 11)],
        "query_id int, place int, company string, page_num int, text string, score double",
    ).where("company IS NOT NULL")
    r = V.snippet_context(hits).first()
    assert r.context == "\n\n".join(f"[Acme] (p.{i}) t{i}" for i in (1, 3, 5, 7))
    assert r.rows_text.split("\n")[1] == f"Acme | p.3 | t3  [score={1 / 3}]"
    asked_ids = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: (r.context, r.rows_text) for r in V.snippet_context(hits, asked_ids).collect()}
    assert got[1][0] == r.context and got[2] == ("No matching data found.", "No rows.")


def test_fall_through(spark):
    found = spark.createDataFrame(
        [(i, 1, "A", "Roe", None, 1.0, "%", 4) for i in (1, 3)],
        "request_id int, place int, company string, metric_key string, metric_variant string, value double, unit string, source_page int",
    )
    q = spark.createDataFrame(
        [(1, "roe of A", "facts"), (2, "tin", "facts"), (3, "copper prices", "vector"), (4, "zinc", "vector")],
        "question_id int, text string, intent string",
    )
    rows = V.facts_else_vector(q, found, chunk_index(spark), k=2).collect()
    got = sorted((r.question_id, r.tool, r.status, r.place, r.value, r.text) for r in rows if r.place in (1, None))
    assert got == [
        (1, "facts", "ok", 1, 1.0, None), (2, "vector", "ok", 1, None, "tin"),
        (3, "vector", "ok", 1, None, "copper prices rose"), (4, "vector", "no hits", None, None, None),
    ]
    assert len(rows) == 5


def test_moves_do_not_grow_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_ROWS", 20)
    monkeypatch.setattr(V, "LEAST_QUERIES", 200)
    vectors = RNG.normal(size=(800, 6)).astype("float32").astype(float)
    shelves, visits = [], []
    for block_bytes in (8 * 6 * 400, 1 << 25):
        held, seen = blocks_of(spark, vectors, vectors, 5, block_bytes)
        assert len(held) > 8
        visits.append(seen)
        shelves.append(-(-800 // 400) if block_bytes < 1 << 25 else 1)
    assert visits[1] == 1 and visits[0] <= shelves[0] + 1
    hits = V.knn_cosine(index(spark, vectors, list(range(800)), "bigint"), asked(spark, vectors), k=5, block_bytes=8 * 6 * 400)
    assert collected(hits) == brute(vectors, vectors, 5, list(range(800)))
