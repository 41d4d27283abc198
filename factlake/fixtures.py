"""Views that bring the test tables into the shape of the data model.

Each SQL text below runs as it is on Spark and on DuckDB; only the two row
generators differ. The queries read these views, and the oracles carry the same
texts as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FACTS = """
SELECT sha1(concat('/fixture/', CAST(l_orderkey AS STRING), '.pdf')) AS doc_id,
       s_name AS company,
       CASE WHEN l_returnflag='A' THEN 'year' WHEN l_returnflag='N' THEN 'quarter'
            WHEN l_linestatus='O' THEN 'estimate' ELSE 'snapshot' END AS period_type,
       CASE WHEN l_quantity <= 5 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS period_end,
       CASE l_linenumber WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Sales' WHEN 3 THEN 'Ebitda' WHEN 4 THEN 'Roe'
            WHEN 5 THEN 'Market Cap' WHEN 6 THEN 'Adj Eps' ELSE 'Ebitda Margin' END AS metric_key,
       CASE WHEN l_returnflag='A' THEN concat('FY', lpad(CAST(year(l_shipdate)%100 AS STRING),2,'0'), 'A')
            WHEN l_returnflag='N' THEN concat('Q', CAST(quarter(l_shipdate) AS STRING), 'FY',
                                              lpad(CAST(year(l_shipdate)%100 AS STRING),2,'0'))
            WHEN l_linestatus='O' THEN concat('FY', lpad(CAST(year(l_shipdate)%100 AS STRING),2,'0'), 'E')
       END AS metric_variant,
       l_extendedprice AS value,
       CASE WHEN l_linenumber IN (4,7) THEN '%' WHEN l_linenumber=6 THEN 'Rs' ELSE 'cr' END AS unit,
       l_linenumber AS source_page,
       concat('page_', CAST(1+l_linenumber%3 AS STRING), '.sec_', CAST(l_linenumber AS STRING),
              '.part_', CAST(l_partkey AS STRING)) AS source_span,
       0.5 + 5*l_discount AS confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""

ENTITIES = """
SELECT s_name AS company, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

RAW_PAGES = """
SELECT CAST(doc_id AS STRING) AS doc_id, CAST(p+1 AS INT) AS page_num, source AS company,
       concat('/corpus/', lang, '/', CAST(doc_id AS STRING), '.txt') AS source_path,
       substring(text, CAST(p*2000+1 AS INT), 2000) AS text
FROM documents {generator}
"""
RAW_PAGES_SPARK = (
    "LATERAL VIEW explode(sequence(0, CAST(greatest(1,ceil(n_chars/2000.0)) AS INT)-1)) e AS p"
)
RAW_PAGES_DUCKDB = ", unnest(range(0, CAST(greatest(1,ceil(n_chars/2000.0)) AS BIGINT))) e(p)"

EXTRACTIONS = """
SELECT concat('/fixture/part/', CAST(p_partkey AS STRING), '.pdf') AS path,
  concat(CASE WHEN p_partkey%5=0 THEN concat('```json', chr(10)) WHEN p_partkey%5=1 THEN 'Here you go: ' ELSE '' END,
   '{"document_meta":{"company":"', CASE WHEN p_partkey%7=0 THEN '' ELSE p_brand END, '","unit_hint":"',
   CASE p_size%4 WHEN 0 THEN 'Rs crore' WHEN 1 THEN 'USD mn' WHEN 2 THEN 'bn' ELSE 'lacs' END, '"},',
   '"page_1":{"general_market_data":{"cmp_rs":', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING),
   ',"cmp_as_of":"2024-06-21","beta":null},',
   '"consolidated_financials_annual_fy24a":{"sales_cr":', CAST(p_size AS STRING), ',"roe_pct":"',
   CAST(p_size AS STRING), '.5","projections_available_for":["FY25E"]}},',
   '"page_2":{"quarterly_financials_q4fy24_cr":{"revenue":', CAST(p_size*10 AS STRING),
   '},"changes_in_estimates_pct":{"fy25e_margins_change_bps":-15},"note":"n/a"},"missing":["page_3"],',
   '"provenance":[{"metric":"sales_cr","page":1,"quote":"x"}]}',
   CASE WHEN p_partkey%5=0 THEN concat(chr(10), '```') ELSE '' END) AS raw
FROM part
"""

QUESTIONS = """
SELECT s_suppkey AS question_id,
  CASE s_suppkey % 5
    WHEN 0 THEN concat('What is "', s_name, '" revenue in FY9', CAST(s_suppkey % 4 + 5 AS STRING), '?')
    WHEN 1 THEN concat('Tell me the ebitda margin of "', s_name, '" for Q', CAST(s_suppkey % 4 + 1 AS STRING), 'FY98')
    WHEN 2 THEN concat('How is ROE at ', s_name, ' trending?')
    WHEN 3 THEN concat('Why did ', s_name, ' expand abroad?')
    ELSE concat('what is the adj eps for "', s_name, '" fy00e')
  END AS text
FROM supplier
"""

# One request per supplier and stored metric name; 'Net Debt' is reported nowhere.
REQUESTS = """
SELECT concat(s_name, '/', m) AS request_id, s_name AS company, m AS metric_key,
       CASE s_nationkey % 4 WHEN 0 THEN 'quarter' WHEN 1 THEN 'year' WHEN 2 THEN 'asof' END AS prefer_period
FROM supplier {generator}
"""
_REQUEST_METRICS = "'Revenue','Sales','Ebitda','Roe','Market Cap','Adj Eps','Ebitda Margin','Net Debt'"
REQUESTS_SPARK = f"LATERAL VIEW explode(array({_REQUEST_METRICS})) e AS m"
REQUESTS_DUCKDB = f", unnest([{_REQUEST_METRICS}]) e(m)"

# A document row for every order, and one for every order that facts name.
ORDER_DOCUMENTS = """
SELECT sha1(concat('/fixture/', CAST(o_orderkey AS STRING), '.pdf')) AS doc_id, c_name AS company,
       CAST(NULL AS STRING) AS ticker, c_mktsegment AS industry,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS report_date,
       concat('/fixture/', CAST(o_orderkey AS STRING), '.pdf') AS source_path,
       CAST(1 AS INT) AS page_count, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey
"""

SPARK_VIEWS = {
    "facts_fx": FACTS,
    "entities_fx": ENTITIES,
    "raw_pages_fx": RAW_PAGES.format(generator=RAW_PAGES_SPARK),
    "extraction_fx": EXTRACTIONS,
    "questions_fx": QUESTIONS,
    "requests_fx": REQUESTS.format(generator=REQUESTS_SPARK),
    "order_documents_fx": ORDER_DOCUMENTS,
}

DUCKDB_VIEWS = {
    **SPARK_VIEWS,
    "raw_pages_fx": RAW_PAGES.format(generator=RAW_PAGES_DUCKDB),
    "requests_fx": REQUESTS.format(generator=REQUESTS_DUCKDB),
}


# The extraction texts are made of few narrow columns: one split of the table gives many gigabytes of text.
SPREAD = {"extraction_fx": ("part", "p_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_files(sf_dir: str, name: str) -> str:
    """A pattern for the table, one file or a folder of files: a stream takes a single file only by a pattern."""
    return f"{sf_dir.rstrip('/')}/{name}[.]parquet"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of one folder."""
    text = SPARK_VIEWS[name]
    for t in TABLES:
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            rows = table(spark, sf_dir, t)
            spread, key = SPREAD.get(name, (None, None))
            if t == spread:
                # the narrow rows move, so that the texts are made and read by all tasks, however few files there are
                rows = rows.select([c for c in rows.columns if c in text]).repartition(key)
            rows.createOrReplaceTempView(t)
    return spark.sql(text)
