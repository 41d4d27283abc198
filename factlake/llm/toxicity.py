"""Toxicity of whole texts by a weighted lexicon that is learned from labelled rows.

Texts are folded (case, accents, look-alike letters, digits and signs inside words), the
lexicon is matched by one Aho-Corasick pass, matches inside exception phrases do not count,
and the sum of the weights is set against the length of the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import held_out, sample_order, stored, text_slices

# The bounded sample of labelled rows that the lexicon and the scale are learned from.
SAMPLE_TOXIC = 4000
SAMPLE_CLEAN = 8000
LEXICON = 2000
# Entries are words and beginnings of words of these lengths.
STEMS = range(4, 8)
MIN_WORD = 3
MIN_SHARE = 0.015
MIN_WEIGHT = 2.0

# Look-alike letters of other scripts, and digits and signs that stand for letters.
LOOKALIKE = str.maketrans(
    "авеёзіїјкмнорстухѕһԁԛԝαβγεηικμνορτυχωℓıø",
    "abee3iijkmhopctyxshdqwabyenikmvoptuxwlio",
)
STANDS_FOR = str.maketrans("0134579@$!|+", "oieastgasilt")
# Phrases in which words of abuse have another meaning.
EXCEPTIONS = (
    "clown fish", "class clown car", "trash can", "trash bag", "trash bin", "trash collection", "pond scum",
    "idiot proof", "pathetic fallacy", "sore loser board", "useless use of", "stupid simple", "kill switch",
    "killer whale", "dumb terminal", "dumb waiter", "dumb bell",
)

_ACCENTS = re.compile("[\u0300-\u036f]+")
_LOOKALIKE = re.compile(f"[{''.join(map(chr, LOOKALIKE))}]")
_STANDS_FOR = re.compile(r"[0-9@$!|+]")
_MIXED = re.compile(r"(?<!\S)\S*?[0-9@$!|+]\S*")
_EDGE = "$!|@+*.,;:?&%#\"'()[]{}<>=-_/\\"
_LETTERS = re.compile(r"[^\W\d_]+")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def _unmix(match: re.Match) -> str:
    word = match[0].strip(_EDGE)
    return word.translate(STANDS_FOR) if _HAS_LETTER.search(word) else " "


def folded(text: str | None) -> str:
    """The words of a text as the lexicon sees them, with one blank before, between and after them."""
    text = (text or "").lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if _LOOKALIKE.search(text):
            text = text.translate(LOOKALIKE)
    if _STANDS_FOR.search(text):
        text = _MIXED.sub(_unmix, text)
    return f" {' '.join(_LETTERS.findall(text))} "


def entries(fold: str) -> set[str]:
    """What of a folded text may become an entry: words (blank on both sides) and beginnings of words."""
    words = {w for w in fold.split(" ") if len(w) >= MIN_WORD}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = 2.0

    def matcher(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(folded(phrase), (len(folded(phrase)), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def strength(matcher: ahocorasick.Automaton | None, fold: str) -> float:
    """Weights of the matched words, the largest per word, over the root of the number of words."""
    words = fold.count(" ") - 1
    if matcher is None or words < 1:
        return 0.0
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in matcher.iter(fold):
        begin = end - length + 1
        if weight is None:
            excused.append((begin, end))
        elif weight > best.get(begin, 0.0):
            best[begin] = weight
    if excused and best:
        best = {b: w for b, w in best.items() if not any(x <= b < y for x, y in excused)}
    return sum(best.values()) / math.sqrt(words + 25)


def probability(lexicon: Lexicon, value: float) -> float:
    z = lexicon.slope * math.log(value + 0.01) + lexicon.offset
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(labels: DataFrame, doc_id: str, label: str, seed: int) -> DataFrame:
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")
    )
    order = sample_order(F.col("__id"), seed)
    parts = [
        known.where(F.col("__label") == value).orderBy(order, "__id").limit(rows)
        for value, rows in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    return stored(parts[0].union(parts[1]).distinct(), "labelled")


def _first_shingle(words: list[str]) -> str:
    """One five-word passage that copies of a text agree on."""
    runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(runs, key=lambda run: (zlib.crc32(run.encode()), run))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", seed: int = 1
) -> Lexicon:
    """A lexicon from a bounded sample of the labelled rows outside the held-out fold.

    Entries are kept that occur in at least max(2, 1.5 %) of the toxic texts, copies counted
    once, and are MIN_WEIGHT or more (log of the ratio of the smoothed rates, less its standard
    error) more frequent there. Without rows of both labels the lexicon is empty and every score is low.
    """
    chosen = F.broadcast(_sample(labels, doc_id, label, seed))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN narrow rows
    rows = stored(
        docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(chosen, "__id"),
        "labelled_texts",
    )

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = [folded(t) for t in texts]
            keys = [_first_shingle(f.split(" ")[1:-1]) for f in done]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.int32()), pa.array(keys), pa.array(done)], names=["label", "copy", "fold"]
            )

    singles = stored(
        rows.select("__text", "__label")
        .mapInArrow(folds, "label int, copy string, fold string")
        .dropDuplicates(["label", "copy"]),
        "folded",
    )
    sizes = {row["label"]: row["n"] for row in singles.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for mark, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in entries(fold):
                    counts.setdefault(entry, [0, 0])[mark] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))],
                names=["entry", "clean", "toxic"],
            )

    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (
        singles.select("label", "fold")
        .mapInArrow(candidates, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= max(2, math.ceil(MIN_SHARE * toxic)))
        .withColumn("weight", weight - error)
        .where(F.col("weight") >= MIN_WEIGHT)
        .orderBy((F.col("weight") * F.sqrt("toxic")).desc(), "entry")
        .limit(LEXICON)
        .select("entry", "weight")
        .collect()
    )
    lexicon = Lexicon({row["entry"]: row["weight"] for row in found})

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            values = [strength(matcher, f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["label", "x"])

    points = singles.select("label", "fold").mapInArrow(strengths, "label int, x double").collect()
    slope, offset = _scale(np.array([p["x"] for p in points]), np.array([p["label"] for p in points]))
    return Lexicon(lexicon.weights, EXCEPTIONS, slope, offset)


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on log(x + 0.01), slightly ridged."""
    design = np.stack([np.log(x + 0.01), np.ones(len(x))], axis=1)
    share = 1.0 / len(y)
    beta = np.array([1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (share * (y - p)) - 1e-3 * beta
        hessian = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.1, float(beta[0])), float(beta[1])


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns with held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts and texts without a word get the lowest score. Very long texts are read
    whole; repeated rows come back each; an empty table gives none; columns with the added names
    are replaced. The score depends on the text alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            scores = []
            for first, last, _, _ in text_slices(values):
                for t in values.slice(first, last - first).to_pylist():
                    scores.append(probability(lexicon, strength(matcher, folded(t))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"]
            )

    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept, held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
