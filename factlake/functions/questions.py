"""Expressions that read the parts of a question."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factlake import constants as K
from factlake.functions.text import SPACE, strip_space


def question_metrics(text: Column) -> Column:
    """Canonical metrics with an alias in the text, in vocabulary order.

    Aliases match inside words too ("ebit" in "ebitda").
    """
    lowered = F.lower(text)
    named = [
        F.when(F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(lowered, a)), name)
        for name, aliases in K.QUESTION_ALIASES.items()
    ]
    return F.array_compact(F.array(*named))


def question_period(text: Column) -> Column:
    """First fiscal label of the text, upper-cased, else NULL."""
    return F.nullif(F.upper(F.regexp_extract(text, K.QUESTION_PERIOD_PATTERN, 1)), F.lit(""))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda word: word != ""))


def question_company(text: Column) -> Column:
    """Quoted name, else the capitalised phrase with most words (the first of equals)."""
    quoted = F.concat(
        F.regexp_extract(text, K.QUOTED_NAME_PATTERN, 1),
        F.regexp_extract(text, K.QUOTED_NAME_PATTERN, 2),
    )
    phrases = F.regexp_extract_all(text, F.lit(K.COMPANY_PATTERN), F.lit(1))
    ranked = F.transform(
        phrases,
        lambda phrase, i: F.struct(
            _word_count(phrase).alias("words"), (-i).alias("place"), strip_space(phrase).alias("name")
        ),
    )
    best = F.array_max(ranked)
    asks = (best["words"] <= 1) & F.lower(best["name"]).isin(*K.NOT_A_COMPANY)
    return F.when(quoted != "", strip_space(quoted)).when(~asks, best["name"])


def question_tool(metrics: Column) -> Column:
    return F.when(F.size(metrics) > 0, "facts_sql").otherwise("unknown")


def intent_class(text: Column) -> Column:
    """Store that a question is about: "facts" for finance words, else "vector"."""
    return F.when(text.rlike(K.FACT_INTENT_PATTERN), "facts").otherwise("vector")
