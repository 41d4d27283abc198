"""The registered queries and the pipeline on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import oracle_check
from factlake.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_lattice_near_dups": ["vec_id", "n_links", "component_id", "kept"],
    "op4_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op5_multi_index_hashing": ["query_id", "rank", "vec_id", "score"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_substring_dedup": ["doc_id", "begin", "end"],
    "op8_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op10_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_ball_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = oracle_check._bag(df.columns, df.collect())
    result = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert got == oracle_check._bag(list(result.columns), result.fetchall()) and got


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    found = queries.QUERIES["op4_ngram_jaccard"](spark, SF_DIR)
    firsts = {r.doc_id for r in found.where("component_id = doc_id").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == names, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        if name == "toxicity":
            assert len(left) >= 0.8 * len(ids)
        if name == "ngram_jaccard":
            assert firsts & ids <= left
        if name == "secret_scan":
            assert left == ids and not docs.where(r"text rlike '[0-9a-f]{32}|AKIA[A-Z0-9]{12}'").count()
        ids = left
    last = corpus_pipeline.run(spark, SF_DIR)
    rows = last.collect()
    assert {r.doc_id for r in rows} <= ids and all(len(r.ids) == r.n_tokens == len(r.begins) for r in rows)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_stages_with_clashing_columns(spark):
    import corpus_pipeline

    plain = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = dict(held_out="h", score="s", predicted=7, component_id="c", found="f", ids="i", decoded="d", n_tokens="n", size="z", part="p", whole="w", taken="t")
    clashing = plain.withColumns({c: F.lit(v) for c, v in extra.items()})
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, SF_DIR), stage(spark, clashing, SF_DIR)
        if name == "pieces":
            assert got.columns == want.columns
        else:
            assert got.columns == clashing.columns, name
            assert not got.where(" or ".join(f"{c} is null or {c} <> '{v}'" for c, v in extra.items())).count(), name
        rows = [sorted(map(str, df.select(*want.columns).collect())) for df in (want, got)]
        assert rows[0] == rows[1] and rows[0], name


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_decodes(spark):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(corpus_pipeline.PIECE_MODEL)))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = corpus_pipeline.encode(spark, docs, SF_DIR).collect()
    assert rows and all(r.decoded == library.decode(list(r.ids)) for r in rows)
