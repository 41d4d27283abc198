"""Expressions that turn extraction field names into metric names, units, periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factlake import constants as K
from factlake.functions.text import title_case

# The text forms a number may have.
NUMBER_TEXT = (
    r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
)
NAMED_NUMBER_TEXT = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def _first_of(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first pair whose condition holds."""
    expression = F
    for condition, value in pairs:
        expression = expression.when(condition, value)
    return expression.otherwise(default)


def normalize_unit(field: Column, hint: Column) -> Column:
    """Unit by field suffix, else by the document's hint, else the default."""
    lowered = F.lower(hint)
    by_suffix = [(F.endswith(field, F.lit(s)), F.lit(u)) for s, u in K.UNIT_BY_SUFFIX.items()]
    no_hint = [(F.coalesce(hint, F.lit("")) == "", F.lit(K.DEFAULT_UNIT))]
    by_hint = [(F.contains(lowered, F.lit(w)), F.lit(u)) for w, u in K.UNIT_BY_HINT_WORD.items()]
    return _first_of(by_suffix + no_hint + by_hint, hint)


def period_label(section: Column, field: Column) -> Column:
    """Fiscal label named in the section or field ("Q4FY24", "FY25E"), else NULL."""
    name = F.lower(F.concat_ws("_", section, field))
    return F.nullif(F.upper(F.regexp_extract(name, K.FIELD_PERIOD_PATTERN, 1)), F.lit(""))


def period_type(label: Column) -> Column:
    return (
        F.when(label.isNull(), "snapshot")
        .when(F.startswith(label, F.lit("Q")), "quarter")
        .when(F.endswith(label, F.lit("E")), "estimate")
        .otherwise("year")
    )


def humanize_metric(field: Column) -> Column:
    """Field name as a readable metric name ("ebitda_growth_yoy_pct" -> "Ebitda Growth Yoy")."""
    name = F.regexp_replace(field, K.UNIT_SUFFIX_PATTERN, "")
    parted = F.regexp_replace(name, "_(yoy|bps|per_share)", " $1")
    spaced = F.regexp_replace(parted, r"[_\-]+", " ")
    return title_case(F.regexp_replace(spaced, r"^\s+|\s+$", ""))


def section_confidence(section: Column) -> Column:
    tables = [(F.startswith(section, F.lit(p)), F.lit(K.CONFIDENCE_TABLE)) for p in K.TABLE_SECTIONS]
    others = [
        (F.contains(section, F.lit("narrative")), F.lit(K.CONFIDENCE_NARRATIVE)),
        (
            F.contains(section, F.lit("market_data")) | F.contains(section, F.lit("shareholding")),
            F.lit(K.CONFIDENCE_MARKET),
        ),
    ]
    return _first_of(tables + others, F.lit(K.CONFIDENCE_OTHER))


def canonical_metric(name: Column) -> Column:
    """Struct (metric_key, score): the first canonical name with an alias in the text."""
    lowered = F.lower(name)

    def result(key: Column, score: float) -> Column:
        return F.struct(key.alias("metric_key"), F.lit(score).alias("score"))

    known = [
        (F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(lowered, a)), result(F.lit(key), 1.0))
        for key, aliases in K.HEADER_ALIASES.items()
    ]
    return _first_of(known, result(name, 0.0))


def number_from_text(text: Column) -> Column:
    """Text as a double where it is written as a number, else NULL."""
    plain = F.regexp_replace(text, r"[_\s]", "").try_cast("double")
    return F.when(text.rlike(NUMBER_TEXT) | text.rlike(NAMED_NUMBER_TEXT), plain)
