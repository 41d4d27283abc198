"""Quality counts against plain Python, and fences against exact quantiles within the width of a bucket."""

import random
import re
from collections import Counter

from llm_data import CLASHING, documents, prose, table
from pyspark.sql import functions as F

from factlake.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        len(lines),
        len(lines) - len(set(lines)),
        len(inside),
    )


ODD = [
    "a b c a b c",
    "a a a a",
    "x\n\nx\n x\nx \r\nx \r\n",
    "\n\n",
    "no end\nno end",
    "été été été\nété été été",
    "日本 語 日本 語 日本",
    "#*$%&|<> # a|b <c>\x0b\x0c\x1c",
    "one\ntwo\none\x00\none\x00",
    "  lead\n  lead\nlead",
    "👍 👍 👍 👍",
]


def test_measures_equal_plain_python(spark):
    rng = random.Random(4)
    rows = documents()
    rows += [(5000 + i, t, "en", "a", 0) for i, t in enumerate(ODD)]
    for i in range(300):
        text = "".join(rng.choice("ab é#\n\n  \t") for _ in range(rng.randint(0, 60)))
        rows.append((6000 + i, text, "en", "a", 0))
    got = Counter(map(tuple, quality.measured(table(spark, rows).select("doc_id", "text").repartition(3)).collect()))
    assert got == Counter((r[0], *plain_measures(r[1])) for r in rows)


def test_long_texts_in_one_batch(spark):
    long = prose(random.Random(1), 400_000)
    rows = [(1, long, "en", "a", 0), (2, "a b c a b c", "en", "a", 0), (3, long + " end\nend", "en", "a", 0)]
    got = {r.doc_id: tuple(r)[1:] for r in quality.measured(table(spark, rows).select("doc_id", "text").coalesce(1)).collect()}
    assert got == {r[0]: plain_measures(r[1]) for r in rows}


def varied(rng, n, lang, source, first, line=8):
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(60, 200)).split(" ")
        text = "\n".join(" ".join(words[k : k + line]) for k in range(0, len(words), line))
        rows.append((first + i, text, lang, source, len(text)))
    return rows


def test_outliers_of_their_group_go(spark):
    rng = random.Random(2)
    rows = varied(rng, 120, "en", "a", 0) + varied(rng, 120, "fr", None, 1000) + varied(rng, 5, "en", "small", 2000)
    # ordinary in source "sym", an outlier elsewhere
    symbols = " ".join(w + " #|" for w in prose(rng, 80).split(" "))
    rows += [(3000 + i, symbols + prose(rng, 60 + i), "en", "sym", 0) for i in range(80)]
    rows += [(4000, symbols, "fr", None, 0), (4001, symbols, "fr", "small", 0), (4002, "z" * 40 + " " + " ".join(prose(rng, 300).replace(" ", "")[i : i + 60] for i in range(0, 1500, 25)), "en", "a", 0)]
    rows += [(4003, "short text", "en", "a", 0), (4004, None, None, None, 0), (4005, "the same old words " * 40, "en", "a", 0)]
    got = {r.doc_id: r for r in quality.quality(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[4000].failed_rules == ["symbols"] and not got[4000].kept and not got[4000].base_failed
    assert got[4002].failed_rules == ["word_length"]
    assert not got[4001].kept
    assert all(got[i].base_failed and not got[i].kept for i in (4003, 4004, 4005))
    clean = [r for r in rows if r[0] < 3000 or 3000 <= r[0] < 3080]
    assert all(got[r[0]].kept for r in clean)
    names = sorted(r[0] for r in rows if got[r[0]].kept)
    assert sorted(r.doc_id for r in quality.kept_documents(table(spark, rows)).collect()) == names


def test_quartiles_within_a_bucket_and_dealing(spark):
    rng = random.Random(3)
    rows = [(i, 1000, rng.randint(0, 900_000), 0, 9, 0, 0, "en", rng.choice("ab")) for i in range(3000)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "lang", "source"]
    df = spark.createDataFrame(rows, names)
    found = [sorted(map(tuple, quality.sketches(df.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert found[0] == found[1]
    whole = {r.a: r for r in quality.fences(quality.sketches(df), least_docs=10**9, reach=1).collect()}
    values = sorted(r[2] // 10 for r in rows)
    q1, q3 = values[749], values[2249]
    low, high = whole["en"].low_word_length, whole["en"].high_word_length
    # low = q1 - d, high = q3 + d with d = q3 - q1
    assert abs((2 * low + high) / 3 - q1) <= q1 / 16 and abs((2 * high + low) / 3 - q3) <= q3 / 16
    assert whole["en"].level == 2


def test_repeats_clashing_and_empty(spark):
    rows = documents()
    extra = {c: F.lit("x") for c in (*CLASHING, "kept", "base_failed", "failed_rules", "n_words", "a", "b", "level", "rule", "__text")}
    plain = quality.quality(table(spark, rows)).collect()
    clashing = table(spark, rows).withColumns(extra)
    assert Counter(map(str, quality.quality(clashing).collect())) == Counter(map(str, plain))
    assert len(plain) == len(rows)
    kept = quality.kept_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in plain)
    assert quality.quality(table(spark, rows).limit(0)).count() == 0
