"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from factlake import constants as K
from factlake.fixtures import DUCKDB_VIEWS, TABLES
from factlake.functions.metrics import NAMED_NUMBER_TEXT, NUMBER_TEXT
from factlake.functions.text import LINE_END, SPACE
from factlake.operators.extraction import FENCE_PATTERN, OBJECT_PATTERN

TIES = "confidence DESC, source_page, doc_id, source_span NULLS LAST, value"
NEWEST = f"coalesce(period_end, '{K.OPEN_PERIOD_END}') DESC, {TIES}"
LISTING = f"company, metric_key, coalesce(period_end, '{K.OPEN_PERIOD_END}'), {TIES}"
FACT_COLUMNS = (
    "doc_id, company, period_type, period_end, metric_key, metric_variant, value, unit, "
    "source_page, source_span, confidence"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _clean(text: str) -> str:
    spaced = f"regexp_replace(replace({text}, chr(0), ' '), '[ \\t]+', ' ', 'g')"
    return _strip(f"regexp_replace({spaced}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _lines(text: str) -> str:
    unified = f"regexp_replace({text}, '{LINE_END}', chr(10), 'g')"
    body = f"regexp_replace({unified}, '\\n\\z', '')"
    blank = SPACE.replace("\\n", "")
    return f"regexp_replace({body}, '(?m){blank}+$', '', 'g')"


PARSED = f"""
stripped_bodies AS (
  SELECT path, raw, {_strip(f"regexp_replace({_strip('raw')}, {_quoted(FENCE_PATTERN)}, '\\1')")} AS body
  FROM extraction_fx
), bodies AS (
  SELECT path, raw, body, regexp_extract(body, {_quoted(OBJECT_PATTERN)}, 1) AS part FROM stripped_bodies
), parsed AS (
  SELECT path, raw, CASE WHEN json_valid(body) THEN CASE WHEN body LIKE '{{%' THEN CAST(body AS JSON) END
                    WHEN json_valid(part) THEN CAST(part AS JSON) END AS doc
  FROM bodies
)"""

FIELDS = (
    PARSED
    + """, page_objects AS (
  SELECT path, doc, page, source_page, json_extract(doc, '$.' || page) AS body
  FROM parsed, (VALUES ('page_1', 1), ('page_2', 2), ('page_3', 3)) AS p(page, source_page)
), sections AS (
  SELECT o.path, doc, page, source_page, s.key AS section, s.value AS body
  FROM (SELECT * FROM page_objects WHERE json_type(body) = 'OBJECT') AS o, json_each(o.body) AS s
), fields AS (
  SELECT o.path, doc, page, source_page, section, f.key AS field, f.value AS content, f.type AS kind
  FROM (SELECT * FROM sections WHERE json_type(body) = 'OBJECT') AS o, json_each(o.body) AS f
)"""
)

LABEL = f"nullif(upper(regexp_extract(lower(section || '_' || field), '{K.FIELD_PERIOD_PATTERN}', 1)), '')"


def _period_type(label: str) -> str:
    return (
        f"CASE WHEN {label} IS NULL THEN 'snapshot' WHEN {label} LIKE 'Q%' THEN 'quarter' "
        f"WHEN {label} LIKE '%E' THEN 'estimate' ELSE 'year' END"
    )


def _unit(field: str, hint: str) -> str:
    suffixes = " ".join(f"WHEN suffix({field}, '{s}') THEN '{u}'" for s, u in K.UNIT_BY_SUFFIX.items())
    words = " ".join(f"WHEN contains(lower({hint}), '{w}') THEN '{u}'" for w, u in K.UNIT_BY_HINT_WORD.items())
    return f"CASE {suffixes} WHEN coalesce({hint}, '') = '' THEN '{K.DEFAULT_UNIT}' {words} ELSE {hint} END"


def _confidence(section: str) -> str:
    tables = " ".join(f"WHEN starts_with({section}, '{p}') THEN {K.CONFIDENCE_TABLE}::DOUBLE" for p in K.TABLE_SECTIONS)
    return (
        f"CASE {tables} WHEN contains({section}, 'narrative') THEN {K.CONFIDENCE_NARRATIVE}::DOUBLE "
        f"WHEN contains({section}, 'market_data') OR contains({section}, 'shareholding') "
        f"THEN {K.CONFIDENCE_MARKET}::DOUBLE ELSE {K.CONFIDENCE_OTHER}::DOUBLE END"
    )


def _human(field: str) -> str:
    """Words of the name, every letter after a digit or blank raised."""
    bare = f"regexp_replace({field}, '{K.UNIT_SUFFIX_PATTERN}', '')"
    spaced = f"trim(regexp_replace(regexp_replace({bare}, '_(yoy|bps|per_share)', ' \\1', 'g'), '[_-]+', ' ', 'g'))"
    runs = f"regexp_extract_all(lower({spaced}), '[a-z]+|[^a-z]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || w[2:]), '')"


COMPANY = f"nullif(doc ->> '$.document_meta.company', '')"

NUMBER = f"""
  CASE WHEN kind = 'VARCHAR' THEN
         CASE WHEN regexp_matches(content ->> '$', '{NUMBER_TEXT}') OR regexp_matches(content ->> '$', '{NAMED_NUMBER_TEXT}')
              THEN TRY_CAST(regexp_replace(content ->> '$', '[_\\s]', '', 'g') AS DOUBLE) END
       WHEN kind = 'BOOLEAN' THEN CASE WHEN content ->> '$' = 'true' THEN 1.0 ELSE 0.0 END
       WHEN kind IN ('ARRAY', 'OBJECT', 'NULL') THEN NULL
       ELSE TRY_CAST(content ->> '$' AS DOUBLE) END"""


def _flat(doc_id: str, company: str, hint: str) -> str:
    return f"""
SELECT {doc_id} AS doc_id, {company} AS company, {_period_type(LABEL)} AS period_type,
       CAST(NULL AS VARCHAR) AS period_end, {_human('field')} AS metric_key, {LABEL} AS metric_variant,
       value, {_unit('field', hint)} AS unit, source_page, concat_ws('.', page, section, field) AS source_span,
       {_confidence('section')} AS confidence
FROM (SELECT *, {NUMBER} AS value FROM fields) AS n WHERE value IS NOT NULL"""


EXTRACTED = _flat(
    "sha1(path)", f"coalesce({_strip(COMPANY)}, '{K.UNKNOWN_COMPANY}')", "(doc ->> '$.document_meta.unit_hint')"
)

BEST = f"""best AS (
  SELECT *, row_number() OVER (PARTITION BY company, metric_key, coalesce(metric_variant, '') ORDER BY {TIES}) AS rn
  FROM facts_fx QUALIFY rn = 1
)"""

LATEST = f"""latest AS (
  SELECT r.request_id, r.company, r.metric_key, f.value, f.unit, f.period_type, f.period_end, f.source_page, f.confidence
  FROM requests_fx r JOIN facts_fx f ON r.company = f.company AND r.metric_key = f.metric_key
  QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY
    CASE WHEN f.period_type = r.prefer_period THEN 0 ELSE 1 END,
    coalesce(f.period_end, '{K.OPEN_PERIOD_END}') DESC, f.confidence DESC, f.source_page, f.doc_id,
    f.source_span NULLS LAST, f.value) = 1
)"""


def _industry(condition: str, message: str) -> str:
    return f"""subject AS (
  SELECT * FROM facts_fx WHERE metric_key = 'Revenue' AND period_type = 'quarter'
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY {NEWEST}) = 1
), filter_values AS (
  SELECT lower(company) AS company_key, metric_key, value FROM facts_fx
  QUALIFY row_number() OVER (PARTITION BY lower(company), metric_key ORDER BY {NEWEST}) = 1
), members AS (
  SELECT DISTINCT lower(company) AS company_key, lower(industry) AS industry_key FROM entities_fx
), ranked AS (
  SELECT m.industry_key, s.company, s.value, s.unit, s.period_end,
         row_number() OVER (PARTITION BY m.industry_key ORDER BY s.value DESC, s.company) AS place
  FROM subject s JOIN members m ON lower(s.company) = m.company_key WHERE {condition}
)
SELECT n.n_name AS industry, CAST(r.place AS INT) AS place, r.company, r.value, r.unit, r.period_end,
       CASE WHEN r.place IS NULL THEN 'not_available' ELSE 'ok' END AS status,
       CASE WHEN r.place IS NULL THEN {message} END AS message
FROM nation n LEFT JOIN (SELECT * FROM ranked WHERE place <= {K.INDUSTRY_ROWS}) r ON lower(n.n_name) = r.industry_key"""


SEARCH_REQUESTS = """search_requests AS (
  SELECT s_name AS request_id, left(s_name, 17) AS hint,
         CASE s_nationkey % 2 WHEN 0 THEN ['revenue', 'sales', 'roe'] ELSE ['ebitda'] END AS metrics,
         CASE s_nationkey % 4 WHEN 0 THEN 'fy97' WHEN 1 THEN 'Q3FY98' WHEN 2 THEN 'part_1' END AS period
  FROM supplier
  UNION ALL
  SELECT n_name, NULL, ['market cap'], 'part_' || CAST(n_nationkey AS STRING) FROM nation
)"""

ROUTES_OF = "SELECT question_id, text FROM questions_fx"


def _metric_hits(text: str) -> list[tuple[str, str]]:
    """(condition, canonical name) per metric of the question vocabulary."""
    return [
        (" OR ".join(f"contains(lower({text}), '{alias}')" for alias in aliases), name)
        for name, aliases in K.QUESTION_ALIASES.items()
    ]


def _metric_list(text: str) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for condition, name in _metric_hits(text))
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


QUOTED = f"regexp_extract(text, {_quoted(K.QUOTED_NAME_PATTERN)}, {{group}})"
PERIOD = f"nullif(upper(regexp_extract(text, '{K.QUESTION_PERIOD_PATTERN}', 1)), '')"

NAMES = f"""phrases AS (
  SELECT question_id, unnest(list) AS phrase, generate_subscripts(list, 1) AS place
  FROM (SELECT question_id, regexp_extract_all(text, '{K.COMPANY_PATTERN}', 1) AS list FROM texts)
), longest AS (
  SELECT question_id, {_strip('phrase')} AS name,
         len(list_filter(regexp_split_to_array(phrase, '{SPACE}+'), lambda w: w <> '')) AS words
  FROM phrases QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY words DESC, place) = 1
), named AS (
  SELECT t.question_id, t.text,
         CASE WHEN concat({QUOTED.format(group=1)}, {QUOTED.format(group=2)}) <> ''
              THEN {_strip(f"concat({QUOTED.format(group=1)}, {QUOTED.format(group=2)})")}
              WHEN l.words <= 1 AND lower(l.name) IN ('what', 'how', 'tell') THEN NULL
              ELSE l.name END AS company_hint,
         {_metric_list('t.text')} AS metrics, {PERIOD.replace('text', 't.text')} AS period_label
  FROM texts t LEFT JOIN longest l ON t.question_id = l.question_id
)"""
NAMES = NAMES.replace("regexp_extract(text", "regexp_extract(t.text").replace("regexp_extract_all(t.text", "regexp_extract_all(text")

ALL_TEXTS = """texts AS (
  SELECT 'q' || CAST(question_id AS STRING) AS question_id, text FROM questions_fx
  UNION ALL SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations
)"""

QUESTION_TEXTS = f"texts AS ({ROUTES_OF})"

FOUND = f"""wanted AS (
  SELECT question_id, nullif(company_hint, '') AS hint, period_label,
         list_distinct(flatten(list_transform(metrics, lambda m:
           CASE WHEN lower(m) = 'revenue' THEN ['revenue', 'sales'] ELSE [lower(m)] END))) AS names
  FROM named WHERE len(metrics) > 0
), found AS (
  SELECT w.question_id, f.*,
         row_number() OVER (PARTITION BY w.question_id ORDER BY f.confidence DESC, f.source_page, f.doc_id,
                            f.source_span NULLS LAST, f.value) AS place
  FROM wanted w JOIN facts_fx f ON list_contains(w.names, lower(f.metric_key))
   AND (w.hint IS NULL OR contains(lower(f.company), lower(w.hint)))
   AND (w.period_label IS NULL OR contains(lower(f.metric_variant), lower(w.period_label))
        OR contains(lower(f.source_span), lower(w.period_label)))
  QUALIFY place <= {K.FACT_ROWS}
)"""

LINES = f"""answers AS (
  SELECT question_id, CAST(count(*) AS INT) AS row_count,
    CASE WHEN count(*) = 1 THEN max(company || ': ' || metric_key ||
           coalesce(' (' || coalesce(nullif(metric_variant, ''), nullif(period_type, '')) || ')', '') || ' = ' ||
           CAST(value AS VARCHAR) || ' ' || unit || ' (p.' || CAST(source_page AS VARCHAR) || ')')
         ELSE string_agg(CASE WHEN place = 1 THEN company || ': ' ELSE '- ' END || metric_key || ' (' ||
           coalesce(metric_variant, 'None') || ') = ' || CAST(value AS VARCHAR) || ' ' || unit || ' (p.' ||
           CAST(source_page AS VARCHAR) || ')', chr(10) ORDER BY place) END AS answer,
    string_agg(company || ' | ' || metric_key || ' | ' || coalesce(metric_variant, 'None') || ' | ' ||
           CAST(value AS VARCHAR) || ' ' || unit || ' | p.' || CAST(source_page AS VARCHAR), chr(10) ORDER BY place) AS context
  FROM found GROUP BY question_id
)"""


def _chunks(source: str, keys: str) -> str:
    """Chunks of source(keys, text): cleaned, cut, numbered."""
    size, overlap, least = K.CHUNK_CHARS, K.CHUNK_OVERLAP, int(K.CHUNK_CHARS * K.CHUNK_BREAK_SHARE)
    window = f"substring(t, b + 1, {size})"
    dot = f"(CASE WHEN contains({window}, '.') THEN length({window}) - position('.' IN reverse({window})) ELSE -1 END)"
    cut = f"CASE WHEN {dot} >= {least} THEN b + {dot} ELSE least(b + {size}, length(t)) END"
    return f"""cleaned AS (SELECT {keys}, {_clean('text')} AS t FROM {source}
), steps AS (
  SELECT {keys}, t, b, {cut} AS e FROM (SELECT *, CAST(0 AS BIGINT) AS b FROM cleaned WHERE length(t) > {size})
  UNION ALL
  SELECT {keys}, t, b, {cut} AS e
  FROM (SELECT {keys}, t, greatest(e - {overlap}, b + 1) AS b FROM steps WHERE e < length(t))
), pieces AS (
  SELECT {keys}, b, {_strip('substring(t, b + 1, e - b)')} AS text FROM steps
), chunks AS (
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY b) - 1 AS INT) AS chunk_idx, text
  FROM pieces WHERE text <> ''
  UNION ALL SELECT {keys}, 0, t FROM cleaned WHERE length(t) <= {size}
)"""


PAGE_KEYS = "doc_id, company, page_num, source_path"

NEIGHBOURS = f"""scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
               / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
               / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score,
         'label_' || CAST(v.label AS STRING) AS company, v.label AS page_num,
         'chunk ' || CAST(v.vec_id AS STRING) AS text
  FROM embeddings q, embeddings v
), hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS place
  FROM scored QUALIFY place <= {{k}}
)"""


def _term_counts(source: str, keys: str) -> str:
    """Terms of source(keys, text) and their share of the length of the count vector."""
    return f"""SELECT {keys}, term, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS weight
  FROM (SELECT {keys}, term, count(*)::DOUBLE AS n
        FROM (SELECT {keys}, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM {source})
        WHERE term <> '' GROUP BY ALL)"""


CHUNK_KEYS = "doc_id, page_num, chunk_idx"
TERMS = f"""indexed AS (SELECT * FROM chunks WHERE length(text) >= {K.CHUNK_MIN_CHARS}
), terms AS (
  {_term_counts('indexed', CHUNK_KEYS)}
)"""
TERM_HITS = f"""asked_terms AS (
  {_term_counts('asked', 'question_id')}
), scored AS (
  SELECT question_id, {CHUNK_KEYS}, round(sum(t.weight * q.weight), 6) AS score
  FROM terms t JOIN asked_terms q USING (term) GROUP BY ALL
), hits AS (
  SELECT s.*, i.company, i.text,
         CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, {CHUNK_KEYS}) AS INT) AS place
  FROM scored s JOIN indexed i USING ({CHUNK_KEYS}) QUALIFY place <= {{k}}
)"""


def _with(body: str, *views: str, recursive: bool = False) -> str:
    """The body behind the fixture views it reads. The body may start with more views."""
    heads = [f"{name} AS ({DUCKDB_VIEWS[name].strip()})" for name in views]
    ctes, _, select = body.partition("=>")
    parts = heads + ([ctes.strip()] if select else [])
    text = (select or body).strip()
    if not parts:
        return text
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + text


CONTEXTS = f"""
SELECT conv_id, coalesce(right(string_agg(line, chr(10) ORDER BY turn, line), {K.CONTEXT_CHARS}), '') AS context
FROM (SELECT conv_id, turn, CASE WHEN body <> '' THEN coalesce(role, 'user') || ': ' || body END AS line
      FROM (SELECT *, {_strip("coalesce(text, '')")} AS body FROM conversations))
GROUP BY conv_id"""

LAST_QUERIES = f"""
SELECT c.conv_id, nullif({_strip('u.text')}, '') AS query
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN
  (SELECT conv_id, text FROM conversations WHERE lower(role) = 'user'
   QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1) u ON c.conv_id = u.conv_id"""

ORACLES: dict[str, str] = {
    "discover_files": " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, count(*) AS rows FROM {t}" for t in TABLES),
    "doc_identity": """
SELECT path, sha1(path) AS doc_id,
       trim(regexp_replace(regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1), '[_-]', ' ', 'g')) AS company
FROM (SELECT concat('/corpus/', lang, '/', source, '_', CAST(doc_id AS STRING), '.txt') AS path FROM documents)""",
    "page_text": _with(
        f"SELECT CAST(doc_id AS BIGINT) AS doc_id, page_num, {_lines('text')} AS text FROM raw_pages_fx", "raw_pages_fx"
    ),
    "drop_last_page": _with(
        """SELECT doc_id, page_num, company, source_path, text FROM raw_pages_fx
        QUALIFY page_num < max(page_num) OVER (PARTITION BY doc_id)""",
        "raw_pages_fx",
    ),
    "kept_page_counts": _with(
        """SELECT doc_id, CAST(count(*) AS INT) AS page_count
        FROM (SELECT doc_id, page_num FROM raw_pages_fx QUALIFY page_num < max(page_num) OVER (PARTITION BY doc_id))
        GROUP BY doc_id""",
        "raw_pages_fx",
    ),
    "skip_existing": _with(
        """SELECT doc_id, source_path FROM order_documents_fx
        WHERE doc_id NOT IN (SELECT doc_id FROM facts_fx)""",
        "facts_fx",
        "order_documents_fx",
    ),
    "documents_upsert": _with(
        """batch AS (
  SELECT doc_id, min(company) AS company, CAST(NULL AS VARCHAR) AS ticker, min(unit) AS industry,
         max(period_end) AS report_date, '/reports/' || doc_id AS source_path, max(source_page) AS page_count,
         CASE period_type WHEN 'year' THEN 1 WHEN 'quarter' THEN 2 WHEN 'estimate' THEN 3 ELSE 4 END AS batch_order
  FROM facts_fx GROUP BY doc_id, period_type
) =>
SELECT doc_id, company, ticker, industry, report_date, source_path, page_count FROM order_documents_fx
WHERE doc_id NOT IN (SELECT doc_id FROM batch)
UNION ALL
SELECT doc_id, company, ticker, industry, report_date, source_path, page_count FROM
  (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch_order DESC) = 1)""",
        "facts_fx",
        "order_documents_fx",
    ),
    "facts_replace_by_doc": _with(
        f"""again AS (SELECT doc_id FROM order_documents_fx WHERE status = 'F') =>
SELECT {FACT_COLUMNS} FROM facts_fx WHERE doc_id NOT IN (SELECT doc_id FROM again)
UNION ALL
SELECT {FACT_COLUMNS.replace('value', 'value + 1.0 AS value')} FROM facts_fx
WHERE doc_id IN (SELECT doc_id FROM again) AND confidence >= 0.7""",
        "facts_fx",
        "order_documents_fx",
    ),
    "pages_validated_append": _with(
        """SELECT doc_id, nullif(page_num, 2) AS page_num, text, nullif(company, 'src3') AS company, source_path,
       CASE WHEN page_num = 2 THEN 'page_num is missing' END AS reject_reason FROM raw_pages_fx""",
        "raw_pages_fx",
    ),
    "cache_merge": _with(
        """SELECT path, regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1) AS cache_key,
       contains(raw, '"company":""') AS force,
       contains(raw, 'USD mn') AND NOT contains(raw, '"company":""') AS from_cache,
       CASE WHEN contains(raw, 'USD mn') AND NOT contains(raw, '"company":""')
            THEN concat('cached ', sha1(raw)) ELSE raw END AS payload
FROM extraction_fx""",
        "extraction_fx",
    ),
    "facts_validated_append": _with(
        f"""checked AS (
  SELECT * REPLACE (confidence + 0.25 AS confidence, nullif(unit, 'Rs') AS unit) FROM facts_fx
) =>
SELECT {FACT_COLUMNS}, CASE WHEN unit IS NULL THEN 'unit is missing'
  WHEN confidence < 0 OR confidence > 1 THEN 'confidence is outside 0 to 1' END AS reject_reason FROM checked""",
        "facts_fx",
    ),
    "entities_load": _with("SELECT company, industry FROM entities_fx", "entities_fx"),
    "index_table_write": """
SELECT vec_id, 'label_' || CAST(label AS STRING) AS company, 'chunk ' || CAST(vec_id AS STRING) AS text,
       CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
FROM embeddings""",
    "index_manifest": """
SELECT 'embeddings' AS source, count(*) AS count, CAST(max(len(embedding)) AS INT) AS dim, 'given' AS embed_model
FROM embeddings""",
    "export_rows": _with(
        f"""{FIELDS}, extracted AS ({EXTRACTED}) =>
SELECT company, metric_key, source_page AS page, value, unit FROM facts_fx
UNION ALL SELECT company, metric_key, source_page, value, unit FROM extracted""",
        "facts_fx",
        "extraction_fx",
    ),
    "incremental_ingest": _with(f"{FIELDS} => {EXTRACTED}", "extraction_fx"),
    "incremental_versions": _with(
        f"""versions_fx AS (
  SELECT path, CASE CAST(regexp_extract(path, '([0-9]+)', 1) AS INT) % 3
    WHEN 0 THEN replace(raw, '"revenue":', '"revenue":1') ELSE raw END AS raw FROM extraction_fx
), {FIELDS.replace('FROM extraction_fx', 'FROM versions_fx')} => {EXTRACTED}""",
        "extraction_fx",
    ),
    "incremental_rejects": _with(
        """SELECT sha1(path) AS doc_id, path, 'no JSON object' AS reason, true AS open
FROM extraction_fx WHERE CAST(regexp_extract(path, '([0-9]+)', 1) AS INT) % 3 = 1""",
        "extraction_fx",
    ),
    "incremental_pages": _with(
        f"""SELECT sha1(source_path) AS doc_id, page_num, {_lines('text')} AS text, doc_id AS company, source_path
FROM raw_pages_fx""",
        "raw_pages_fx",
    ),
    "extraction_cache": _with(f"{FIELDS} => {EXTRACTED}", "extraction_fx"),
    "parse_extraction": _with(
        f"""{PARSED} =>
SELECT path, CASE WHEN doc IS NULL THEN 'fail' ELSE 'ok' END AS parse_status,
       doc ->> '$.document_meta.unit_hint' AS unit_hint,
       CAST(doc ->> '$.page_1.general_market_data.cmp_rs' AS DOUBLE) AS price
FROM parsed""",
        "extraction_fx",
    ),
    "flatten_facts": _with(f"{FIELDS} => {_flat('path', _quoted('all'), _quoted('USD mn'))}", "extraction_fx"),
    "normalize_unit": _with(
        f"""{FIELDS} => SELECT path, field, unit_hint, {_unit('field', 'unit_hint')} AS unit
FROM (SELECT *, doc ->> '$.document_meta.unit_hint' AS unit_hint FROM fields)""",
        "extraction_fx",
    ),
    "period_label": _with(
        f"""{FIELDS} => SELECT path, section, field, label, {_period_type('label')} AS period_type
FROM (SELECT *, {LABEL} AS label FROM fields)""",
        "extraction_fx",
    ),
    "humanize_metric": _with(f"{FIELDS} => SELECT path, field, {_human('field')} AS metric FROM fields", "extraction_fx"),
    "section_confidence": _with(
        f"{FIELDS} => SELECT path, section, field, {_confidence('section')} AS confidence FROM fields", "extraction_fx"
    ),
    "resolve_company": _with(
        f"""{PARSED} => SELECT path, coalesce({_strip(COMPANY)}, '{K.UNKNOWN_COMPANY}') AS company,
       coalesce({_strip(COMPANY)}, 'Hinted Ltd') AS company_with_hint FROM parsed""",
        "extraction_fx",
    ),
    "page_count": _with(
        f"""{PARSED} => SELECT path, CAST(greatest(1, {' + '.join(
            f"CASE WHEN json_type(doc, '$.{p}') = 'OBJECT' THEN 1 ELSE 0 END" for p in K.COUNTED_PAGES)}) AS INT) AS page_count
FROM parsed""",
        "extraction_fx",
    ),
    "flatten_fields": _with(
        f"""{FIELDS} => SELECT path, page || '.' || section AS section, field,
       CASE WHEN kind = 'NULL' THEN NULL WHEN kind = 'DOUBLE' THEN CAST(CAST(content ->> '$' AS DOUBLE) AS VARCHAR)
            ELSE content ->> '$' END AS value,
       doc ->> '$.document_meta.company' AS company, doc ->> '$.document_meta.report_period' AS report_period
FROM fields""",
        "extraction_fx",
    ),
    "provenance_rows": _with(
        f"""{PARSED} => SELECT parsed.path, e.value ->> '$.metric' AS metric, e.value ->> '$.page' AS page,
       substring(e.value ->> '$.quote', 1, {K.QUOTE_CHARS}) AS quote
FROM parsed, json_each(parsed.doc, '$.provenance') AS e""",
        "extraction_fx",
    ),
    "notice_rows": _with(
        f"""{PARSED} => SELECT parsed.path, 'missing' AS kind, e.value ->> '$' AS entry FROM parsed, json_each(parsed.doc, '$.missing') AS e
UNION ALL
SELECT parsed.path, 'warnings', e.value ->> '$' FROM parsed, json_each(parsed.doc, '$.warnings') AS e""",
        "extraction_fx",
    ),
    "canonicalize_metric": _with(
        f"""SELECT name, coalesce(known, name) AS metric_key, CASE WHEN known IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
       count(*) AS fact_count
FROM (SELECT metric_key AS name, CASE {' '.join(
            f"WHEN {' OR '.join(f'contains(lower(metric_key), {_quoted(a)})' for a in aliases)} THEN '{key}'"
            for key, aliases in K.HEADER_ALIASES.items())} END AS known FROM facts_fx)
GROUP BY name, known""",
        "facts_fx",
    ),
    "extract_to_facts": _with(f"{FIELDS} => {EXTRACTED}", "extraction_fx"),
    "facts_best": _with(f"{BEST} => SELECT * REPLACE (CAST(rn AS INT) AS rn) FROM best", "facts_fx"),
    "rows_flat": _with(
        f"""{BEST} => SELECT source_page AS "page number", metric_key AS metric, metric_variant AS time_period, value, unit
FROM best""",
        "facts_fx",
    ),
    "latest_metric": _with(f"{LATEST} => SELECT * FROM latest", "facts_fx", "requests_fx"),
    "metric_lookup": _with(
        f"""{LATEST} =>
SELECT r.request_id, r.company, r.metric_key, l.value, l.unit, l.period_type, l.period_end, l.source_page, l.confidence,
       CASE WHEN l.value IS NULL THEN 'not_available' WHEN l.confidence < {K.CONFIDENCE_THRESHOLD} THEN 'uncertain'
            ELSE 'ok' END AS status,
       CASE WHEN l.value IS NULL THEN format('Metric ''{{}}'' not reported for ''{{}}''.', r.metric_key, r.company)
            WHEN l.confidence < {K.CONFIDENCE_THRESHOLD} THEN '{K.MSG_LOW_CONFIDENCE}' END AS message
FROM requests_fx r LEFT JOIN latest l ON r.request_id = l.request_id""",
        "facts_fx",
        "requests_fx",
    ),
    "industry_topk": _with(
        _industry("true", "format('No rows found for industry=''{}'', metric=''{}''.', n.n_name, 'Revenue')").replace(
            ")\nSELECT n.n_name", ") =>\nSELECT n.n_name"
        ),
        "facts_fx",
        "entities_fx",
    ),
    "filtered_topk": _with(
        _industry(
            """EXISTS (SELECT 1 FROM filter_values v WHERE v.company_key = lower(s.company)
                       AND v.metric_key = 'Market Cap' AND v.value >= 30000.0)
               AND EXISTS (SELECT 1 FROM filter_values v WHERE v.company_key = lower(s.company)
                       AND v.metric_key = 'Roe' AND v.value < 80000.0)""",
            _quoted(K.MSG_NO_FILTERED_ROWS),
        ).replace(")\nSELECT n.n_name", ") =>\nSELECT n.n_name"),
        "facts_fx",
        "entities_fx",
    ),
    "facts_search": _with(
        f"""{SEARCH_REQUESTS} =>
SELECT r.request_id, CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY f.confidence DESC, f.source_page,
         f.doc_id, f.source_span NULLS LAST, f.value) AS INT) AS place,
       f.company, f.metric_key, f.metric_variant, f.value, f.unit, f.period_type, f.period_end, f.source_page,
       f.source_span, f.confidence
FROM search_requests r JOIN facts_fx f ON list_contains(r.metrics, lower(f.metric_key))
 AND (r.hint IS NULL OR contains(lower(f.company), lower(r.hint)))
 AND (r.period IS NULL OR contains(lower(f.metric_variant), lower(r.period))
      OR contains(lower(f.source_span), lower(r.period)))
QUALIFY place <= {K.FACT_ROWS}""",
        "facts_fx",
    ),
    "facts_page": _with(
        f"""SELECT company, metric_key, metric_variant, value, unit, period_type, period_end, source_page,
       substring(source_span, 1, {K.SNIPPET_CHARS}) AS snippet, confidence
FROM (SELECT * FROM facts_fx ORDER BY {LISTING} LIMIT 50 OFFSET 100)""",
        "facts_fx",
    ),
    "facts_dump": _with(
        f"""SELECT company, metric_key, value, unit, period_type, period_end, source_page,
       substring(source_span, 1, {K.SNIPPET_CHARS}) AS snippet FROM facts_fx ORDER BY {LISTING}""",
        "facts_fx",
    ),
    "best_sample": _with(
        f"""{BEST} => SELECT company, metric_key, metric_variant, value, unit FROM best
WHERE company ILIKE '%supplier#00000000%' AND metric_key ILIKE '%revenue%' AND metric_variant ILIKE '%fy9%'
ORDER BY company, metric_key, metric_variant LIMIT {K.SQL_ROWS}""",
        "facts_fx",
    ),
    "pages_preview": _with(
        f"SELECT doc_id, page_num, substring(text, 1, {K.PREVIEW_CHARS}) AS preview FROM raw_pages_fx", "raw_pages_fx"
    ),
    "metric_counts": _with("SELECT metric_key, count(*) AS fact_count FROM facts_fx GROUP BY metric_key", "facts_fx"),
    "ingest_summary": _with(
        """SELECT d.doc_id, d.company, CASE d.status WHEN 'F' THEN 'ok' WHEN 'P' THEN 'skip' ELSE 'fail' END AS status,
       CASE WHEN d.status = 'F' THEN coalesce(c.n, 0) ELSE 0 END AS fact_count
FROM order_documents_fx d LEFT JOIN (SELECT doc_id, count(*) AS n FROM facts_fx GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
        "facts_fx",
        "order_documents_fx",
    ),
    "ingest_totals": _with(
        """SELECT count(*) FILTER (d.status = 'F') AS ok_documents, count(*) FILTER (d.status = 'P') AS skip_documents,
       count(*) FILTER (d.status NOT IN ('F', 'P')) AS fail_documents,
       CAST(coalesce(sum(c.n) FILTER (d.status = 'F'), 0) AS BIGINT) AS fact_count
FROM order_documents_fx d LEFT JOIN (SELECT doc_id, count(*) AS n FROM facts_fx GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
        "facts_fx",
        "order_documents_fx",
    ),
    "keyword_search": _with(
        f"""SELECT doc_id, page_num, text FROM raw_pages_fx WHERE company ILIKE '%s%' AND text ILIKE '%tion%'
ORDER BY company, doc_id, page_num LIMIT {K.PAGE_ROWS}""",
        "raw_pages_fx",
    ),
    "keyword_search_batch": _with(
        f"""asked AS (
  SELECT DISTINCT request_id, lower(company) AS part, keyword FROM (
    SELECT source || '/' || lang AS request_id, source AS company,
           CASE lang WHEN 'fr' THEN 'ment' WHEN 'de' THEN 'ung' ELSE 'th' END AS keyword FROM documents
    UNION ALL
    SELECT lang, 'S', CASE lang WHEN 'fr' THEN 'ment' WHEN 'de' THEN 'ung' ELSE 'th' END FROM documents)
) =>
SELECT a.request_id, CAST(row_number() OVER (PARTITION BY a.request_id ORDER BY p.company, p.doc_id, p.page_num) AS INT) AS place,
       p.doc_id, p.page_num, p.text
FROM asked a JOIN raw_pages_fx p ON contains(lower(p.company), a.part) AND contains(lower(p.text), a.keyword)
QUALIFY place <= {K.PAGE_ROWS}""",
        "raw_pages_fx",
    ),
    "sql_period_fuzzy": _with(
        f"""{BEST} => SELECT company, metric_key, metric_variant, value, unit FROM best
WHERE metric_variant ILIKE '%FY98%'""",
        "facts_fx",
    ),
    "sql_top_by_metric": _with(
        f"""{BEST}, ranked AS (
  SELECT b.*, row_number() OVER (ORDER BY b.value DESC, b.company, b.metric_variant NULLS LAST) AS nth
  FROM best b SEMI JOIN (SELECT upper(company) AS name FROM entities_fx WHERE upper(industry) = 'NATION_7') e
    ON e.name = upper(b.company)
  WHERE upper(b.metric_key) = 'REVENUE'
) => SELECT company, metric_key, metric_variant, value, unit, source_page FROM ranked WHERE nth <= 5""",
        "facts_fx",
        "entities_fx",
    ),
    "sql_metric_threshold": _with(
        f"""{BEST}, above AS (SELECT company, list(value) AS found FROM best WHERE upper(metric_key) = 'ROE' AND value > 60000 GROUP BY 1)
=> SELECT company, list_max(found) AS best_value, CAST(len(found) AS BIGINT) AS fact_count FROM above""",
        "facts_fx",
    ),
    "sql_group_aggregate": _with(
        f"""{BEST}, grouped AS (
  SELECT DISTINCT company, metric_key, max(metric_variant) OVER w AS metric_variant, max(value) OVER w AS value,
    min(unit) OVER w AS unit, min(source_page) OVER w AS source_page
  FROM best WINDOW w AS (PARTITION BY company, metric_key)
) => SELECT company, metric_key, metric_variant, value, unit, source_page FROM grouped
QUALIFY row_number() OVER (ORDER BY value DESC, company, metric_key) <= {K.SQL_ROWS}""",
        "facts_fx",
    ),
    "fact_answer_lines": _with(
        f"""{QUESTION_TEXTS}, {NAMES}, {FOUND}, {LINES} =>
SELECT w.question_id AS request_id, coalesce(a.row_count, 0) AS row_count,
       coalesce(a.answer, '{K.MSG_NO_FACTS}') AS answer, coalesce(a.context, '{K.MSG_NO_ROWS}') AS context
FROM wanted w LEFT JOIN answers a ON w.question_id = a.question_id""",
        "facts_fx",
        "questions_fx",
    ),
    "question_metrics": _with(
        f"""{ALL_TEXTS} => SELECT question_id, array_to_string({_metric_list('text')}, '|') AS metric_keys FROM texts""",
        "questions_fx",
    ),
    "question_period": _with(f"{ALL_TEXTS} => SELECT question_id, {PERIOD} AS period_label FROM texts", "questions_fx"),
    "question_company": _with(
        f"{ALL_TEXTS}, {NAMES} => SELECT question_id, company_hint FROM named", "questions_fx"
    ),
    "route_questions": _with(
        f"""{ALL_TEXTS}, {NAMES} =>
SELECT question_id, CASE WHEN len(metrics) > 0 THEN 'facts_sql' ELSE 'unknown' END AS tool,
       array_to_string(metrics, '|') AS metric_keys, company_hint, period_label FROM named""",
        "questions_fx",
    ),
    "intent_class": _with(
        f"""{ALL_TEXTS} =>
SELECT question_id, CASE WHEN regexp_matches(text, '{K.FACT_INTENT_PATTERN}') THEN 'facts' ELSE 'vector' END AS intent
FROM texts""",
        "questions_fx",
    ),
    "chat_context": CONTEXTS,
    "last_user_message": LAST_QUERIES,
    "conversation_questions": _with(
        f"""contexts AS ({CONTEXTS}), last_queries AS ({LAST_QUERIES}), texts AS (
  SELECT conv_id AS question_id, query AS text FROM last_queries WHERE query IS NOT NULL
), {NAMES} =>
SELECT n.question_id, n.text, c.context,
       CASE WHEN regexp_matches(n.text, '{K.FACT_INTENT_PATTERN}') THEN 'facts' ELSE 'vector' END AS intent,
       CASE WHEN len(metrics) > 0 THEN 'facts_sql' ELSE 'unknown' END AS tool,
       array_to_string(metrics, '|') AS metric_keys, company_hint, period_label
FROM named n JOIN contexts c ON n.question_id = c.conv_id"""
    ),
    "answer_questions": _with(
        f"""{QUESTION_TEXTS}, {NAMES}, {FOUND}, {LINES} =>
SELECT n.question_id, CASE WHEN w.question_id IS NULL THEN 'unknown' ELSE 'ok' END AS status,
       CASE WHEN w.question_id IS NULL THEN 'unknown' ELSE 'facts_sql' END AS tool,
       CASE WHEN w.question_id IS NULL THEN '{K.MSG_NO_ROUTE}' END AS message,
       CASE WHEN w.question_id IS NOT NULL THEN coalesce(a.row_count, 0) END AS row_count,
       CASE WHEN w.question_id IS NOT NULL THEN coalesce(a.answer, '{K.MSG_NO_FACTS}') END AS answer
FROM named n LEFT JOIN wanted w ON n.question_id = w.question_id LEFT JOIN answers a ON n.question_id = a.question_id""",
        "facts_fx",
        "questions_fx",
    ),
    "answer_conversations": _with(
        f"""talks AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT question_id, 1000, 'user', text FROM questions_fx WHERE question_id % 3 = 0
), contexts AS ({CONTEXTS.replace('FROM conversations', 'FROM talks')}),
last_queries AS ({LAST_QUERIES.replace('FROM conversations', 'FROM talks')}), texts AS (
  SELECT conv_id AS question_id, query AS text FROM last_queries WHERE query IS NOT NULL
), {NAMES}, {FOUND.replace('WHERE len(metrics) > 0', f"WHERE len(metrics) > 0 AND regexp_matches(text, '{K.FACT_INTENT_PATTERN}')")}, {LINES},
{_chunks('raw_pages_fx', PAGE_KEYS)}, {TERMS},
asked AS (SELECT question_id, text FROM texts WHERE question_id NOT IN (SELECT question_id FROM answers)),
{TERM_HITS.format(k=K.ROUTED_HITS)}, snippets AS (
  SELECT question_id, CAST(count(*) AS INT) AS row_count,
    string_agg('[' || company || '] (p.' || CAST(page_num AS VARCHAR) || ') ' || text, chr(10) || chr(10) ORDER BY place) AS answer
  FROM hits GROUP BY 1
) =>
SELECT t.question_id AS conv_id, t.text AS question, c.context,
  CASE WHEN a.question_id IS NULL THEN 'vector' ELSE 'facts' END AS tool,
  CASE WHEN coalesce(a.answer, s.answer) IS NULL THEN 'no hits' ELSE 'ok' END AS status,
  coalesce(a.row_count, s.row_count, 0) AS row_count, coalesce(a.answer, s.answer, '{K.MSG_NO_HITS}') AS answer
FROM texts t JOIN contexts c ON t.question_id = c.conv_id
LEFT JOIN answers a ON t.question_id = a.question_id LEFT JOIN snippets s ON t.question_id = s.question_id""",
        "facts_fx",
        "questions_fx",
        "raw_pages_fx",
        recursive=True,
    ),
    "facts_else_vector": _with(
        f"""{QUESTION_TEXTS}, {NAMES}, {FOUND}, {_chunks('raw_pages_fx', PAGE_KEYS)}, {TERMS},
asked AS (
  SELECT question_id, text FROM questions_fx
  WHERE NOT (regexp_matches(text, '{K.FACT_INTENT_PATTERN}') AND question_id IN (SELECT question_id FROM found))
), {TERM_HITS.format(k=K.ROUTED_HITS)} =>
SELECT f.question_id, 'facts' AS tool, place, company, source_page AS page_num, metric_key, metric_variant, value, unit,
       CAST(NULL AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS score, 'ok' AS status
FROM found f WHERE f.question_id NOT IN (SELECT question_id FROM asked)
UNION ALL
SELECT a.question_id, 'vector', h.place, h.company, h.page_num, NULL, NULL, NULL, NULL, h.text, h.score,
       CASE WHEN h.place IS NULL THEN 'no hits' ELSE 'ok' END
FROM asked a LEFT JOIN hits h ON a.question_id = h.question_id""",
        "facts_fx",
        "questions_fx",
        "raw_pages_fx",
        recursive=True,
    ),
    "search_chunks": _with(
        f"""{_chunks('raw_pages_fx', PAGE_KEYS)}, {TERMS}, asked AS (SELECT question_id, text FROM questions_fx),
{TERM_HITS.format(k=K.SEARCH_HITS)} =>
SELECT question_id, place, score, doc_id, page_num, chunk_idx, company, text FROM hits""",
        "questions_fx",
        "raw_pages_fx",
        recursive=True,
    ),
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "chunk_text": _with(
        f"{_chunks('documents', 'doc_id')} => SELECT doc_id, chunk_idx, text FROM chunks", recursive=True
    ),
    "chunk_rows": _with(
        f"""{_chunks('raw_pages_fx', PAGE_KEYS)} => SELECT {PAGE_KEYS}, chunk_idx, text FROM chunks WHERE length(text) >= {K.CHUNK_MIN_CHARS}""",
        "raw_pages_fx",
        recursive=True,
    ),
    "normalize_l2": """
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos,
       round(unnest(v) / sqrt(list_inner_product(v, v)), 6) AS x
FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * (label + 2)) AS v FROM embeddings)""",
    "embed_chunks": _with(
        f"""{_chunks('raw_pages_fx', PAGE_KEYS)}, {TERMS} =>
SELECT doc_id, page_num, chunk_idx, term, round(weight, 6) AS weight FROM terms""",
        "raw_pages_fx",
        recursive=True,
    ),
    "knn_cosine": _with(
        f"""{NEIGHBOURS.format(k=K.SEARCH_HITS)} =>
SELECT query_id, vec_id, score, company, page_num, text, place FROM hits"""
    ),
    "knn_company_filter": _with(
        f"""{NEIGHBOURS.format(k=K.SEARCH_HITS)} =>
SELECT query_id, vec_id, score, company, place FROM hits WHERE company ILIKE '%LABEL_1%'"""
    ),
    "adapt_index_schema": "SELECT doc_id, n_chars AS page_num, text, source FROM documents",
    "snippet_context": _with(
        f"""{NEIGHBOURS.format(k=K.SEARCH_HITS)} =>
SELECT query_id, string_agg('[' || company || '] (p.' || CAST(page_num AS VARCHAR) || ') ' || text,
                            chr(10) || chr(10) ORDER BY place) AS context,
       string_agg(company || ' | p.' || CAST(page_num AS VARCHAR) || ' | ' || text || '  [score=' ||
                  CAST(score AS VARCHAR) || ']', chr(10) ORDER BY place) AS rows_text
FROM hits GROUP BY query_id"""
    ),
    "build_index": _with(
        f"""{_chunks('raw_pages_fx', PAGE_KEYS)}, {TERMS} =>
SELECT (SELECT count(*) FROM chunks WHERE length(text) >= {K.CHUNK_MIN_CHARS}) AS count,
       CAST(count(DISTINCT term) AS INT) AS dim, 'terms' AS embed_model, round(sum(weight * weight), 3) AS squares FROM terms""",
        "raw_pages_fx",
        recursive=True,
    ),
}
ORACLES["facts_replace_stored"] = ORACLES["facts_replace_by_doc"]
ORACLES["documents_upsert_stored"] = ORACLES["documents_upsert"]
