"""Small tables with the odd rows every operator must take."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

VOWELS = "aeiou"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def prose(rng: random.Random, words: int, letters: str = "bcdfglmnprst") -> str:
    return " ".join(
        "".join(rng.choice(letters) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(words)
    )


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, nulls, blanks, repeated rows and a long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(3, 90))
        if i % 7 == 3 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        if i % 11 == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(text)))
    long = prose(rng, 30_000)
    return [
        *rows,
        (1000, None, None, None, None),
        (1001, "", "en", "a", 0),
        (1002, " \t\n ", "en", "b", 4),
        (1003, "One", "en", "a", 3),
        (1004, "one", "en", "a", 3),
        (1005, long, "en", "b", len(long)),
        (1006, long + " end", "en", "b", len(long) + 4),
        (1007, "été ▁ 日本語 \x00 \r\n x y", "fr", "c", 20),
        rows[0],
        rows[0],
        (None, "no id here at all, six", "en", "a", 22),
    ]


def table(spark, rows=None, **extra):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name, value in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


CLASHING = dict(node="x", h=1, a="q", b=2, key=0, size="s", score="t", begin=1, end=2, text_2="u", component=9, low=5)
