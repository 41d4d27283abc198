import random

from factlake.operators import chunks as C


def plain_chunks(text):
    """Windows by a plain loop over the cleaned text."""
    if len(text) <= 800:
        return [text]
    out, at = [], 0
    while True:
        window = text[at:at + 800]
        dot = window.rfind(".")
        length = dot if dot >= 480 else len(window)
        if window[:length].strip():
            out.append(window[:length].strip())
        if at + length == len(text):
            return out
        at = max(at + length - 150, at + 1)


def chunked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in sorted(C.chunk_text(df).collect(), key=lambda r: (r.i, r.chunk_idx)):
        assert r.chunk_idx == len(got.setdefault(r.i, []))
        got[r.i].append(r.text)
    return [got.get(i, []) for i in range(len(texts))]


def test_chunks_like_plain_loop(spark):
    rng = random.Random(3)
    texts = ["", "x" * 39, "x" * 40, "x" * 800, "x" * 801, "x" * 1000, "." * 2000, "é" * 1700]
    texts += ["".join(rng.choices("abc ü.", weights=[9, 9, 9, 6, 3, rng.random()], k=rng.randint(700, 9000))) for _ in range(40)]
    import re

    cleaned = [re.sub(r"[ \t]+", " ", t).strip() for t in texts]
    got = chunked(spark, texts)
    assert got == [plain_chunks(t) for t in cleaned]
    assert max(len(c) for cs in got for c in cs) <= 800


def test_characters_beyond_the_first_plane(spark):
    rng = random.Random(8)
    texts = ["😀" + "x" * 2000, "x" * 400 + "😀" + "y" * 9599, "x" * 799 + "😀" * 3 + "y" * 900, "𠀀" * 1700, "😀" * 800]
    texts += ["".join(rng.choices("ab😀𠀀\r.", weights=[9, 9, 3, 3, 1, rng.random()], k=rng.randint(700, 9000))).strip() for _ in range(20)]
    assert chunked(spark, texts) == [plain_chunks(t) for t in texts]


def test_long_text_is_whole(spark):
    text = " ".join(str(i) for i in range(60_000))
    pieces = chunked(spark, [text])[0]
    seen = set(" ".join(pieces).split())
    assert {str(i) for i in range(60_000)} <= seen and len(pieces) < 700


def test_chunks_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "x" * 900)], "i int, text string")
    plan = C.chunk_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunk_rows(spark):
    pages = spark.createDataFrame(
        [("d", "Acme", 1, "/p", "x" * 39), ("d", "Acme", 2, "/p", "y" * 820), ("d", "Acme", 3, "/p", "z" * 50), ("e", "Beta", 1, "/q", "w" * 60)],
        "doc_id string, company string, page_num int, source_path string, text string",
    )
    def rows(**options):
        return sorted((r.doc_id, r.page_num, r.chunk_idx, len(r.text)) for r in C.chunk_rows(pages, **options).collect())
    assert rows() == [("d", 2, 0, 800), ("d", 2, 1, 170), ("d", 3, 0, 50), ("e", 1, 0, 60)]
    assert rows(ignore_last_page=True) == [("d", 2, 0, 800), ("d", 2, 1, 170)]
    assert rows(company="bet") == [("e", 1, 0, 60)]
