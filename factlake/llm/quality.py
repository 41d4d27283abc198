"""Quality rules whose cutoffs follow the documents of the same language and source.

Each document gets a few counts. For every language and source the values of a rule go into a
quantile sketch: counts per bucket, buckets as wide as a 32nd of their values at most. Sketches are
merged by adding counts, so they do not depend on how rows are dealt, and a group with few documents
takes the merged sketch of its language, or of everything. The fences of a rule lie beyond the
quartiles by a multiple of their distance; a document outside one is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from factlake.llm.common import SLICE_BYTES, mixed, span_hashes, stored, text_slices, word_spans

# Base rules.
FEWEST_WORDS = 50
MOST_REPEATED = 50  # of 100 words
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

# A bucket is a value without all bits but its first six.
BUCKET_BITS = 6
# A group needs so many documents for fences of its own.
LEAST_DOCS = 50
# Fences lie so many quartile distances beyond the quartiles.
REACH = 6

# Rule: (numerator, factor, denominator, least quartile distance, has a lower fence).
# Values are whole numbers: hundredths of a character, or parts of 10,000.
RULES = {
    "word_length": ("word_chars", 100, "n_words", 50, True),
    "symbols": ("n_symbols", 10_000, "word_chars", 100, False),
    "dup_lines": ("n_dup_lines", 10_000, "n_lines", 1000, False),
    "repeats": ("n_repeat_words", 10_000, "n_words", 500, False),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SYMBOLS, np.uint8))


def _later_equal(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equals one of the same row, equals an earlier one of the same row) for places in order of rows."""
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[order[1:]] == rows[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    later = np.zeros(len(rows), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    any_other = np.zeros(len(rows), bool)
    any_other[order] = twice
    return any_other, later


def measures(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """MEASURES of the texts data[starts[i]:starts[i + 1]]; words and lines are compared by 64-bit hashes."""
    n = len(starts) - 1

    def per_row(rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=n).astype(np.int64)

    def sums(marks: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return upto[starts[1:]] - upto[starts[:-1]]

    if not len(data):
        return [np.zeros(n, np.int64)] * len(MEASURES)
    row, begin, end = word_spans(data, starts)
    words = span_hashes(data, begin, end)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = sums(inside & ((data & 0xC0) != 0x80))

    whole = np.flatnonzero(row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1]) if len(row) >= WINDOW else np.zeros(0, np.int64)
    joint = np.zeros(len(whole), np.uint64)
    for k in range(WINDOW):
        joint = mixed(joint + words[whole + k])
    twice, _ = _later_equal(row[whole], joint)
    repeated = np.zeros(len(row), bool)
    for k in range(WINDOW):
        repeated[whole[twice] + k] = True

    cuts = np.unique(np.concatenate([starts[:-1], np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts < len(data)]
    ends = np.concatenate([cuts[1:], [len(data)]])
    ends = ends - (data[ends - 1] == 10)
    upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = upto[ends] > upto[cuts]
    cuts, ends = cuts[full], ends[full]
    line_row = np.searchsorted(starts, cuts, side="right") - 1
    _, later = _later_equal(line_row, span_hashes(data, cuts, ends))
    return [
        per_row(row),
        chars,
        sums(_SYMBOL[data]),
        per_row(line_row),
        per_row(line_row[later]),
        per_row(row[repeated]),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with MEASURES; columns of these names are replaced.

    n_words counts runs of other than blanks, word_chars their code points, n_symbols the
    characters of SYMBOLS, n_lines the lines with a word, n_dup_lines those equal to an earlier one,
    n_repeat_words the words in windows of three words found twice or more in the text. Null
    and empty texts have zeros. Very long texts are measured whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(data, starts) for _, _, data, starts in text_slices(batch.column(batch.num_columns - 1), SLICE_BYTES)]
            columns = [pa.array(np.concatenate(values)) for values in zip(*parts, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *MEASURES]
                )

    kept = [c for c in docs.columns if c not in (text, *MEASURES)]
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("__text"))
    schema = T.StructType(rows.schema.fields[:-1])
    for name in MEASURES:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule_value(rule: str) -> Column:
    """The value of a rule; 0 without words."""
    above, factor, below, _, _ = RULES[rule]
    return F.when(F.col(below) > 0, F.expr(f"{above} * {factor}L div {below}")).otherwise(F.lit(0).cast("long"))


def sketches(rows: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(level, a, b, rule, bucket, n): quantile sketches of all documents with a word.

    Level 0 has one per pair of groups, level 1 those merged over the second group, level 2 all
    of them merged. Null is a group of its own. Counts are added up before they move; the
    buckets of a sketch do not grow with the documents.
    """
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rule_value(r).alias("v")) for r in RULES])).alias("x")
    bits = f"greatest(length(bin(v)) - {BUCKET_BITS}, 0)"
    lowest = (
        rows.where(F.col("n_words") > 0)
        .select(F.col(groups[0]).alias("a"), F.col(groups[1]).alias("b"), values)
        .select("a", "b", "x.rule", "x.v")
        .groupBy("a", "b", "rule", F.expr(f"shiftleft(shiftright(v, {bits}), {bits})").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    return merged_levels(stored(lowest, "sketches"))


def merged_levels(lowest: DataFrame) -> DataFrame:
    """The sketches of pairs of groups, of first groups and of everything."""
    types = dict(lowest.dtypes)
    no_a, no_b = F.lit(None).cast(types["a"]).alias("a"), F.lit(None).cast(types["b"]).alias("b")
    levels = [
        lowest.select(F.lit(0).alias("level"), "a", "b", "rule", "bucket", "n"),
        lowest.select(F.lit(1).alias("level"), "a", no_b, "rule", "bucket", "n"),
        lowest.select(F.lit(2).alias("level"), no_a, no_b, "rule", "bucket", "n"),
    ]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return every.groupBy("level", "a", "b", "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(found: DataFrame, least_docs: int = LEAST_DOCS, reach: int = REACH) -> DataFrame:
    """(a, b, level, low_<rule>, high_<rule>): the fences of each pair of groups.

    They come from its own sketch if that has `least_docs` documents, else from that of its first
    group, else from everything; `level` says from which.
    """
    sketch = Window.partitionBy("level", "a", "b", "rule")
    upto = F.sum("n").over(sketch.orderBy("bucket"))
    total = F.sum("n").over(sketch)
    marked = found.select("*", upto.alias("upto"), total.alias("total"))
    quartiles = (
        marked.groupBy("level", "a", "b", "rule")
        .agg(
            F.max("total").alias("total"),
            F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        )
    )
    least = F.element_at(F.create_map(*[x for r, rule in RULES.items() for x in (F.lit(r), F.lit(rule[3]))]), F.col("rule"))
    width = F.greatest(F.col("q3") - F.col("q1"), least.cast("long")) * reach
    bounds = quartiles.withColumn("low", F.col("q1") - width).withColumn("high", F.col("q3") + width)
    per_group = bounds.groupBy("level", "a", "b").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{side}_{r}") for r in RULES for side in ("low", "high")],
    )
    types = dict(found.dtypes)
    no_a, no_b = F.lit(None).cast(types["a"]), F.lit(None).cast(types["b"]).alias("kb")
    keys = F.explode(
        F.array(
            F.struct(F.lit(0).alias("kl"), F.col("a").alias("ka"), F.col("b").alias("kb")),
            F.struct(F.lit(1).alias("kl"), F.col("a").alias("ka"), no_b),
            F.struct(F.lit(2).alias("kl"), no_a.alias("ka"), no_b),
        )
    )
    wanted = per_group.where("level = 0").select(F.col("a").alias("ga"), F.col("b").alias("gb"), keys.alias("k"))
    sides = [f"{side}_{r}" for r in RULES for side in ("low", "high")]
    taken = wanted.join(
        per_group,
        (F.col("k.kl") == F.col("level")) & F.col("k.ka").eqNullSafe(F.col("a")) & F.col("k.kb").eqNullSafe(F.col("b")),
    ).where((F.col("total") >= least_docs) | (F.col("level") == 2))
    first = taken.groupBy(F.col("ga").alias("a"), F.col("gb").alias("b")).agg(
        F.min(F.struct("level", *sides)).alias("f")
    )
    return first.select("a", "b", "f.*")


def judged(rows: DataFrame, found: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The measured rows with base_failed, failed_rules (names) and kept.

    The fences are joined by both groups, null with null; they are written before, so that
    Spark knows their size. A row whose groups have no fences (no word) fails the base rules.
    """
    f = found.select(*[F.col(c).alias(f"__f_{c}") for c in found.columns])
    failed = []
    for rule, (_, _, _, _, has_low) in RULES.items():
        out = rule_value(rule) > F.col(f"__f_high_{rule}")
        if has_low:
            out = out | (rule_value(rule) < F.col(f"__f_low_{rule}"))
        failed.append(F.when(out, F.lit(rule)))
    on = F.col(groups[0]).eqNullSafe(F.col("__f_a")) & F.col(groups[1]).eqNullSafe(F.col("__f_b"))
    base = base_failed()
    return (
        rows.join(f, on, "left")
        .select(*rows.columns, base.alias("base_failed"), F.array_compact(F.array(*failed)).alias("failed_rules"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def quality(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", groups: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    """doc_id, MEASURES, base_failed, failed_rules and kept of each document.

    Null ids and groups are taken as they are; repeated rows are judged each; an empty table
    gives none. Other columns play no part. The texts are read once.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(groups[0]).alias("a"), F.col(groups[1]).alias("b"), F.col(text).alias("text")
    )
    rows = stored(measured(rows), "quality")
    found = stored(fences(sketches(rows, ("a", "b"))), "fences")
    return judged(rows, found, ("a", "b")).drop("a", "b")


def kept_documents(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The documents that are kept, with their columns, whatever these are called."""
    inner = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(name) for c, name in inner.items()], F.col(text).alias("__measured"))
    short = stored(measured(rows.select(F.col(inner[groups[0]]).alias("a"), F.col(inner[groups[1]]).alias("b"), "__measured"), "__measured"), "quality")
    found = stored(fences(sketches(short, ("a", "b"))), "fences")
    kept = judged(measured(rows, "__measured"), found, (inner[groups[0]], inner[groups[1]])).where("kept")
    return kept.select(*[F.col(name).alias(c) for c, name in inner.items()])
