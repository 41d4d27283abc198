"""One query per operator of this subpackage over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factlake.llm import (
    ball_codes,
    chunk_dedup,
    hamming,
    langid,
    lattice,
    mixing,
    ngram_jaccard,
    pieces,
    prefix_trie,
    quality,
    secret_scan,
    token_counts,
    toxicity,
)
from factlake.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon).select("doc_id", "held_out", "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_groups(table(spark, sf_dir, "documents"))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.language(docs.drop("lang"), langid.fit(docs))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.fit(secret_scan.labelled_strings(docs))
    return secret_scan.span_digests(secret_scan.secrets(docs, model)).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(PIECE_MODEL))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = ("ids_sha256", "decoded_sha256", "n_covered")
    return pieces.encode_pieces(docs, public_tokenizers.path(PIECE_MODEL), outputs=wanted)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("digest1", "digest2")


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = ball_codes.fit_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()
    return ball_codes.with_label_error(books.codes).select(
        F.col("id").alias("vec_id"),
        ball_codes.code_text(F.col("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_lattice_near_dups": op3_lattice_near_dups,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_multi_index_hashing": op5_multi_index_hashing,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_pieces": op10_pieces,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ball_codes": op12_ball_codes,
    "op13_quality_rules": op13_quality_rules,
}


def _ball_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round as its own pair of steps: all distances, then means."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, p, q[CAST(p * len(q) // {parts} + 1 AS BIGINT) : CAST((p + 1) * len(q) // {parts} AS BIGINT)] AS x
  FROM kept, range({parts}) AS r(p)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM firsts JOIN pieces USING (vec_id)
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min((d, e)) AS best
  FROM (
    SELECT vec_id, pieces.p, x, e,
      list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM pieces JOIN book{i} ON pieces.p = book{i}.p
  ) GROUP BY 1, 2
)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
  SELECT p, e, list(floor_mean ORDER BY place) AS c FROM (
    SELECT p, e, place, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
      SELECT p, best[2] AS e, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT p, best, unnest(x) AS v, unnest(range(len(x))) AS place FROM near{i}) GROUP BY 1, 2, 3
    )
  ) GROUP BY 1, 2
), book{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, e)
)""")
    return ",\n".join(steps) + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM near{rounds} GROUP BY 1
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


def _quality_sql() -> str:
    """The same counts by splitting, and the same sketches and fences as whole numbers."""
    values, fences, failed = [], [], []
    for rule, (above, factor, below, least, has_low) in quality.RULES.items():
        values.append(f"SELECT a, b, '{rule}' AS rule, CASE WHEN {below} > 0 THEN {above} * {factor} // {below} ELSE 0 END AS v FROM m WHERE n_words > 0")
        fences.append(f"WHEN '{rule}' THEN {least}")
        value = f"(CASE WHEN {below} > 0 THEN {above} * {factor} // {below} ELSE 0 END)"
        low = f" OR {value} < f_{rule}.low" if has_low else ""
        failed.append(f"({value} > f_{rule}.high{low})")
    joins = " ".join(
        f"LEFT JOIN fences f_{r} ON f_{r}.rule = '{r}' AND f_{r}.a IS NOT DISTINCT FROM m.a AND f_{r}.b IS NOT DISTINCT FROM m.b"
        for r in quality.RULES
    )
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang AS a, source AS b, coalesce(text, '') AS t FROM documents
), words AS MATERIALIZED (
  SELECT rid, unnest(w) AS w, unnest(range(len(w))) AS i FROM (
    SELECT rid, regexp_extract_all(t, '[^ 	-
]+') AS w FROM docs)
), windows AS MATERIALIZED (
  SELECT x.rid, x.i, x.w || ' ' || y.w || ' ' || z.w AS s
  FROM words x JOIN words y ON y.rid = x.rid AND y.i = x.i + 1 JOIN words z ON z.rid = x.rid AND z.i = x.i + 2
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), repeated AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS i FROM twice, range(3) AS r(k)) GROUP BY 1
), counted AS (
  SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY 1
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1
), m AS MATERIALIZED (
  SELECT doc_id, a, b, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN counted USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)
), vals AS (
  {' UNION ALL '.join(values)}
), levels AS (
  SELECT 0 AS level, a, b, rule, v FROM vals UNION ALL SELECT 1, a, NULL, rule, v FROM vals
  UNION ALL SELECT 2, NULL, NULL, rule, v FROM vals
), sketch AS (
  SELECT level, a, b, rule, bucket, count(*) AS n FROM (
    SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM levels)
  GROUP BY ALL
), upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, a, b, rule ORDER BY bucket) AS u,
    sum(n) OVER (PARTITION BY level, a, b, rule) AS total FROM sketch
), quartiles AS (
  SELECT level, a, b, rule, max(total) AS total, min(bucket) FILTER (4 * u >= total) AS q1, min(bucket) FILTER (4 * u >= 3 * total) AS q3
  FROM upto GROUP BY ALL
), bounds AS (
  SELECT *, {quality.REACH} * greatest(q3 - q1, CASE rule {' '.join(fences)} END) AS d FROM quartiles
), fences AS (
  SELECT g.a, g.b, g.rule, arg_min(o.q1 - o.d, o.level) AS low, arg_min(o.q3 + o.d, o.level) AS high
  FROM (SELECT * FROM bounds WHERE level = 0) g JOIN bounds o ON o.rule = g.rule AND (
    (o.level = 0 AND o.a IS NOT DISTINCT FROM g.a AND o.b IS NOT DISTINCT FROM g.b)
    OR (o.level = 1 AND o.a IS NOT DISTINCT FROM g.a) OR o.level = 2)
  WHERE o.total >= {quality.LEAST_DOCS} OR o.level = 2 GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({' OR '.join(failed)}, false) AS kept
FROM m {joins}
"""


ORACLES = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM texts
), sizes AS (
  SELECT t.doc_id, count(s) AS n FROM texts t LEFT JOIN sets USING (doc_id) GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id
FROM sizes JOIN reach USING (doc_id) GROUP BY 1, 2
""",
    "op2_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('7:' || doc_id) AS k
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER f, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth
  FROM weighed
  WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, nth) FROM levels WHERE level <= cap / w)) AS target
  FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
), placed AS (
  SELECT doc_id, size, source_size, target, whole,
    CAST(floor(target - whole * source_size + 1e-6) AS BIGINT) AS rest,
    coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY substr(k, 1, 15), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN parts ON docs.source IS NOT DISTINCT FROM parts.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM placed
""",
    "op3_lattice_near_dups": """
WITH RECURSIVE units AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM units a JOIN units b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.other
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reach LEFT JOIN counts ON x = vec_id GROUP BY vec_id
""",
    "op11_prefix_trie": """
WITH ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, list_reduce([4294967295::BIGINT] || range(8 * length(CAST(conv_id AS VARCHAR))), lambda c, i:
    xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END::BIGINT) >> 1,
      3988292384::BIGINT
        * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END::BIGINT) & 1))) AS crc
  FROM ids
), shares AS (
  SELECT conv_id, xor(crc, 4294967295::BIGINT) % 6 AS h FROM bits
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(x ORDER BY place) AS turns FROM placed GROUP BY 1
), rebuilt AS MATERIALIZED (
  SELECT conv_id, coalesce(b.turns[1:h], []) || own.turns[h + 1:] AS turns
  FROM own JOIN shares USING (conv_id) LEFT JOIN own b ON b.conv_id = conv_id - conv_id % 100
), starts AS MATERIALIZED (
  SELECT conv_id, d, turns[1:d] AS node, len(turns) AS n FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '') AS ends
  FROM starts GROUP BY ALL
), kids AS (
  SELECT node[1:d - 1] AS parent, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), whole AS MATERIALIZED (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * coalesce(length(node[d].t), 0) AS saved
  FROM nodes LEFT JOIN kids ON kids.parent = node
), sums AS (
  SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT DISTINCT a.node AS top, b.node AS node FROM starts a JOIN starts b ON a.conv_id = b.conv_id AND a.d <= b.d) pairs
  JOIN whole USING (node) GROUP BY 1
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs,
  CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums ON sums.top = w.node LEFT JOIN nodes p ON w.d > 0 AND p.node = w.node[1:w.d - 1]
""",
    "op12_ball_codes": _ball_codes_sql(),
    "op13_quality_rules": _quality_sql(),
}
