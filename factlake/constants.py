"""Fixed values of the data model.

Everything here is a value that must stay as it is for results to be right:
word lists, lookup tables, patterns, limits and message texts.
"""

# --- fixed values: extraction documents ---------------------------------------

# Page objects that carry facts, with their page number.
FACT_PAGES = {"page_1": 1, "page_2": 2, "page_3": 3}

# Page objects that count towards the number of pages.
COUNTED_PAGES = ("page_1", "page_2", "page_3", "page_4", "page_5")

UNIT_BY_SUFFIX = {
    "_pct": "%",
    "_x": "x",
    "_rs": "Rs",
    "_days": "days",
    "_tonne": "tonne",
}

# Tested in this order on the lower-cased hint.
UNIT_BY_HINT_WORD = {
    "cr": "cr",
    "million": "mn",
    "mn": "mn",
    "billion": "bn",
    "bn": "bn",
}

DEFAULT_UNIT = "cr"

# Sections read from tables, by name prefix.
TABLE_SECTIONS = (
    "quarterly_financials",
    "financial_ratios",
    "cash_flow",
    "consolidated_financials_annual",
    "sotp_valuation",
)

CONFIDENCE_TABLE = 0.88
CONFIDENCE_NARRATIVE = 0.72
CONFIDENCE_MARKET = 0.78
CONFIDENCE_OTHER = 0.75

FIELD_PERIOD_PATTERN = r"(q\d+fy\d{2}|fy\d{2}[a-z]?)"
UNIT_SUFFIX_PATTERN = r"(?i)_(cr|pct|x|rs|days|tonne)$"
UNKNOWN_COMPANY = "Unknown"

QUOTE_CHARS = 140
SNIPPET_CHARS = 160
PREVIEW_CHARS = 200

# --- fixed values: metric vocabularies ----------------------------------------

# Column headers to canonical metric, first match wins.
HEADER_ALIASES = {
    "revenue": ["revenue", "sales", "top line"],
    "ebitda": ["ebitda", "operating profit"],
    "pat": ["pat", "net profit", "profit after tax"],
    "eps": ["eps", "earnings per share"],
    "market cap": ["market cap", "mcap", "capitalization"],
}

# Words in a question to canonical metric, every match counts.
QUESTION_ALIASES = {
    "Revenue": ["revenue", "sales", "turnover", "top line"],
    "EBITDA": ["ebitda"],
    "EBIT": ["ebit", "operating profit"],
    "PAT": ["pat", "net profit", "profit after tax"],
    "Adj. EPS": ["adj eps", "adjusted eps"],
    "EPS": ["eps"],
    "EBITDA margin": ["ebitda margin", "operating margin"],
    "ROE": ["roe", "return on equity"],
    "ROCE": ["roce", "return on capital employed"],
    "P/E": ["pe", "p e", "price to earnings"],
    "EV/EBITDA": ["ev ebitda", "ev/ebitda"],
}

# A metric that stands for several stored names.
METRIC_EXPANSION = {"revenue": ["Revenue", "Sales"]}

# --- fixed values: question patterns ------------------------------------------

QUESTION_PERIOD_PATTERN = r"(?i)\b(q[1-4]fy\d{2}|fy\d{2}[a-z]?)\b"
QUOTED_NAME_PATTERN = r""""([^"]+)"|'([^']+)'"""
COMPANY_PATTERN = r"([A-Z][A-Za-z.&\-\s]{1,60})"
NOT_A_COMPANY = ("what", "how", "tell")
FACT_INTENT_PATTERN = (
    r"(?i)\b(revenue|sales|ebitda|pat|eps|margin|roe|ev/ebitda|capex|guidance"
    r"|price target|valuation|sotp)\b"
)
FISCAL_LABEL_PATTERN = r"(?i)FY[0-9]{2}"

# --- fixed values: limits and thresholds --------------------------------------

CONFIDENCE_THRESHOLD = 0.70
OPEN_PERIOD_END = "9999-12-31"
FACT_ROWS = 5
PAGE_ROWS = 5
INDUSTRY_ROWS = 3
SQL_ROWS = 20
FACT_PAGE_SIZE = 50
FACT_PAGE_MAX = 1000
CONTEXT_CHARS = 1500
CHUNK_CHARS = 800
CHUNK_OVERLAP = 150
CHUNK_BREAK_SHARE = 0.6
CHUNK_MIN_CHARS = 40
SEARCH_HITS = 8
ROUTED_HITS = 5
SNIPPET_HITS = 8
FILTER_OPERATORS = (">", ">=", "<", "<=", "=", "==", "!=")

# --- fixed values: messages ---------------------------------------------------

MSG_NOT_REPORTED = "Metric '%s' not reported for '%s'."
MSG_LOW_CONFIDENCE = "Low-confidence extraction. Consider verifying the source page."
MSG_NO_INDUSTRY_ROWS = "No rows found for industry='%s', metric='%s'."
MSG_NO_FILTERED_ROWS = "No companies matched the filters for this industry/metric."
MSG_BAD_OPERATOR = "Unsupported operator '%s' in filters."
MSG_NO_FACTS = "No matching facts found. Try re-ingesting or broaden the query."
MSG_NO_ROWS = "No rows."
MSG_NO_ROUTE = "Router could not determine the right tool."
MSG_NO_HITS = "No matching data found."
