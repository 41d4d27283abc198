"""Language of a text by compression: the dictionary that makes it smallest names the language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from factlake.llm.common import held_out, sample_order, text_slices

UNKNOWN = "und"

# The bounded sample that the dictionaries are made of: rows per language, characters of each
# row (from its middle), bytes of the dictionary.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 128 * 1024

# Texts are compressed in pieces of this many bytes, so that a long text does not become its own dictionary.
PIECE_BYTES = 2048
# Pieces of the sample that must read as their own language.
CLEAN_CHARS = 256
LEVEL = 6

# The best language must be smaller than the second by this share to be accepted.
MARGIN = 0.01

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> str:
    """The runs of letters in lower case, one blank between; empty if the text has no letter."""
    found = " ".join(_LETTERS.findall((text or "").lower()))
    return found if any(map(str.isalpha, found)) else ""


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", seed: int = 1) -> dict[str, bytes]:
    """One raw dictionary per language of the rows outside the held-out fold.

    Made of at most SAMPLE_ROWS rows per language in seeded order. Rows without language, id or
    letters teach nothing.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    order = Window.partitionBy("__lang").orderBy("__order", "__id")
    ids = (
        rows.select(F.col(lang).alias("__lang"), F.col(doc_id).alias("__id"), sample_order(F.col(doc_id), seed).alias("__order"))
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= SAMPLE_ROWS)
        .select("__id")
        .collect()
    )
    if not ids:
        return {}
    middle = F.greatest(F.lit(1), F.floor((F.length(text) - SAMPLE_CHARS) / 2).cast("int"))
    sample = (
        rows.where(F.col(doc_id).isin([row[0] for row in ids]))
        .select(F.col(lang).alias("l"), F.substring(F.col(text), middle, F.lit(SAMPLE_CHARS)).alias("t"))
        .distinct()
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["l"], r["t"] or "")):
        if found := letters(row["t"]):
            parts.setdefault(row["l"], []).append(found)
    sizes = {row[lang]: row["count"] for row in rows.groupBy(lang).count().collect()}
    return dictionaries_of({name: parts[name] for name in sorted(parts, key=lambda n: (-sizes[n], n))})


def dictionaries_of(parts: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionaries of equal size from the sample's texts, without what reads as another language.

    Texts hold passages of other languages. Pieces that the first dictionaries give to another
    language than their text's are left out of the second ones.
    """
    first = {name: _dictionary(texts) for name, texts in parts.items()}
    if len(first) < 2:
        return first
    classify = Classifier(first)
    clean = {}
    for name, texts in parts.items():
        own = classify.names.index(name)
        kept = []
        for text in texts:
            pieces = [text[i : i + CLEAN_CHARS] for i in range(0, len(text), CLEAN_CHARS)]
            good = [p for p in pieces if classify.sizes(p)[own] <= min(classify.sizes(p))]
            if good:
                kept.append(" ".join(good))
        clean[name] = _dictionary(kept or texts)
    return clean


def _dictionary(texts: list[str]) -> bytes:
    each = max(256, DICTIONARY_BYTES // len(texts))
    return " ".join(t[:each] for t in texts).encode()[-DICTIONARY_BYTES:]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def sizes(self, folded: str) -> list[int]:
        data = folded.encode()
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(piece)) for piece in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, accepted); ties go to the first dictionary."""
        folded = letters(text)
        if not folded or not self.names:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(folded)
        best = min(sizes)
        scale = 1.0 + 0.01 * best
        score = 1.0 / sum(math.exp(max(-700.0, (best - size) / scale)) for size in sizes)
        second = min((s for i, s in enumerate(sizes) if i != sizes.index(best)), default=None)
        accepted = second is None or second - best >= MARGIN * best
        return self.names[sizes.index(best)], score, accepted


def language(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The rows (without their text) with held_out, lang_pred, score and accepted.

    lang_pred is a learned language, `und` if the text is null or has no letter (score 0, not
    accepted) or if nothing was learned. Narrow margins keep the prediction and are marked by
    accepted = false; equal sizes go to the first dictionary: the most frequent language learned
    from, then the first name by code point. Very long texts are read
    whole; repeated rows come back each; an empty table gives none; columns with the added
    names are replaced.
    """
    names = ["held_out", "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            found = []
            for first, last, _, _ in text_slices(values):
                found.extend(classify(t) for t in values.slice(first, last - first).to_pylist())
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = pa.string(), pa.float64(), pa.bool_()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=[*batch.schema.names[:-1], *names[1:]],
            )

    kept = [c for c in docs.columns if c not in (text, *names)]
    rows = docs.select(*kept, held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return rows.mapInArrow(run, schema)
