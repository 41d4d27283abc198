"""Token counts of whole texts, without the tokens.

The pieces of a model never join a blank to the character before it, so a text falls into
pre-tokens (a run of blanks with what follows up to the next blank) that are encoded on their
own. Each distinct pre-token of a task is encoded once; a document's count is the sum over its
pre-token frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import text_slices

BLANK = "▁"

# Pre-tokens of a task whose counts are remembered; beyond it the memory starts anew, which
# costs time and changes nothing else.
REMEMBERED = 600_000

# Texts are split here: before a run of blanks, the character that stands for a blank among them, and
# around line ends, which are bytes of their own in models without a piece that holds them.
PRETOKEN = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """The sums are only right for models whose pieces never hold a blank after another character."""
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if BLANK in model.id_to_piece(i).lstrip(BLANK):
            raise ValueError(f"a piece crosses pre-tokens: {model.id_to_piece(i)!r}")


def _counter(model_path: str) -> Callable[[list[str]], list[int]]:
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    check_model(model)
    # a mark that the model holds no piece for keeps the blank that the model puts before every
    # text apart from the pre-token; what it costs alone is taken off
    mark = "\n"
    known: dict[str, int] = {}
    own = len(model.encode(mark))

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            # the model puts one blank before the text
            frequency = Counter(PRETOKEN.findall(" " + text)) if text else Counter()
            missing = [p for p in frequency if p not in known]
            if missing:
                if len(known) + len(missing) > REMEMBERED:
                    known.clear()
                    missing = list(frequency)
                for piece, ids in zip(missing, model.encode([mark + p for p in missing], num_threads=1), strict=True):
                    known[piece] = len(ids) - own
            out.append(sum(known[p] * n for p, n in frequency.items()))
        return out

    return count


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """The rows with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    The counts equal those of the sentencepiece library without begin and end ids. Null and
    empty texts have no bytes and no tokens; very long texts are counted whole; repeated rows
    are counted each; an empty table gives none. Columns of the three names are replaced.

    The per-document frequencies stay in the task that read the document: they hold about two
    thirds as many entries as the texts hold words, so a shuffle of them would move more than the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            sizes, tokens = [], []
            for first, last, _, starts in text_slices(values):
                sizes.extend((starts[1:] - starts[:-1]).tolist())
                tokens.extend(count([t or "" for t in values.slice(first, last - first).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
