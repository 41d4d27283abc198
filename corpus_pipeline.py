"""From raw documents to tokens: clean, deduplicate, redact, mix and encode.

STAGES lists the steps in order. Each takes (spark, docs, sf_dir), works on all of docs, and
its result is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factlake.llm import mixing, ngram_jaccard, pieces, secret_scan, toxicity
from factlake.llm.common import stored, table

PIECE_MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text scores 0.5 or more; the lexicon comes from the labelled rows of docs."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    inner = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(name) for c, name in inner.items()])
    scored = toxicity.toxicity(rows, lexicon, inner["text"], inner["doc_id"]).where(F.col("predicted") == 0)
    return scored.select(*[F.col(name).alias(c) for c, name in inner.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of n-gram neighbours."""
    return ngram_jaccard.first_of_groups(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    model = secret_scan.fit(secret_scan.labelled_strings(docs))
    return secret_scan.redacted(docs, model)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each row of the mix with its ids, the byte spans they stand for and what they decode to."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode_pieces(rows, public_tokenizers.path(PIECE_MODEL), outputs=("ids", "begins", "ends", "decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("pieces", encode),
]

# The lexicon, the secret models and the token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
