"""Searches by parts of names: facts by company, metric and period; pages by keyword."""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from factlake import constants as K
from factlake.functions.text import matches_like, matches_part
from factlake.operators.ranking import best_first, first_rows

# Parts are looked up by grams of so many characters, shorter parts by themselves.
GRAM = 3

FACT_COLUMNS = (
    "company",
    "metric_key",
    "metric_variant",
    "value",
    "unit",
    "period_type",
    "period_end",
    "source_page",
    "source_span",
    "confidence",
)
SPEC = ("company_part", "metrics", "period")

# Fixed value: up to so many different pairs of metric and period, facts are compared with them where they lie.
PAIRS = 100


# --- names that contain a part ------------------------------------------------


def _grams(text: Column, length: int) -> Column:
    """The distinct grams of the text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def names_containing(names: DataFrame, parts: DataFrame, name: str, part: str) -> DataFrame:
    """Pairs (part, name) where the name contains the part, without regard to case.

    A part is looked up by the one of its grams that the fewest names hold, and compared in full
    with those. So a name has at most as many keys as characters, for each length that a gram
    has: GRAM, and less if there are parts that short.
    """
    asked = parts.select(F.col(part).alias("__part")).where(F.col("__part") != "").distinct()
    asked = asked.withColumn("__length", F.least(F.length(F.lower("__part")), F.lit(GRAM)))
    held = names.select(F.col(name).alias("__name")).distinct()
    # at most GRAM rows
    lengths = F.broadcast(asked.select("__length").distinct())
    grams = F.coalesce(*[F.when(F.col("__length") == n, _grams(F.lower("__name"), n)) for n in range(1, GRAM + 1)])
    sized = held.select("__name", F.explode(F.array(*map(F.lit, range(1, GRAM + 1)))).alias("__length"))
    keyed = sized.join(lengths, "__length", "left_semi").select("__name", F.explode(grams).alias("__gram"))
    own = F.coalesce(*[F.when(F.col("__length") == n, _grams(F.lower("__part"), n)) for n in range(1, GRAM + 1)])
    spread = keyed.groupBy("__gram").agg(F.count("*").alias("__names"))
    rarest = (
        asked.select("__part", F.explode(own).alias("__gram"))
        .join(spread, "__gram", "left")
        .groupBy("__part")
        .agg(F.min(F.struct(F.coalesce("__names", F.lit(0)).alias("n"), "__gram")).alias("r"))
        .where("r.n > 0")
    )
    pairs = rarest.select("__part", F.col("r.__gram").alias("__gram")).join(keyed, "__gram")
    pairs = pairs.where(matches_part(F.col("__name"), F.col("__part")))
    return pairs.select(F.col("__part").alias(part), F.col("__name").alias(name))


# --- fact search --------------------------------------------------------------


def expanded_metrics(metric_keys: Column) -> Column:
    """Lower-cased metric names to look for, sorted, a general name by all it stands for."""

    def stored_names(key: Column) -> Column:
        names = F.array(F.lower(key))
        for general, stored in K.METRIC_EXPANSION.items():
            names = F.when(F.lower(key) == general, F.array(*[F.lit(n.lower()) for n in stored])).otherwise(names)
        return names

    return F.array_sort(F.array_distinct(F.flatten(F.transform(metric_keys, stored_names))))


def _with_spec(requests: DataFrame) -> DataFrame:
    """Add what the search depends on; equal searches share one."""
    return requests.withColumns(
        {
            "company_part": F.lower(F.coalesce("company_hint", F.lit(""))),
            "metrics": expanded_metrics(F.col("metric_keys")),
            "period": F.upper(F.coalesce("period_label", F.lit(""))),
        }
    )


def _period_labels(texts: list[Column]) -> Column:
    """All fiscal labels a period label could name inside the texts; '' stands for any period."""
    raised = [F.upper(text) for text in texts]
    named = F.concat_ws("\n", *[F.when(F.contains(text, F.lit("FY")), text) for text in raised])
    longest = F.regexp_extract_all(named, F.lit("(?=(Q[1-4]FY[0-9]{2}|FY[0-9]{2}[A-Z]?))"), F.lit(1))
    both = F.flatten(F.transform(longest, lambda label: F.array(label, F.rtrim(label, F.lit(ascii_uppercase)))))
    return F.array_distinct(F.concat(F.array(F.lit("")), both))


def _spec_companies(specs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per search, metric and company in question."""
    by_metric = specs.withColumn("metric", F.explode("metrics"))
    pairs = names_containing(facts.select("company"), specs.select("company_part"), "company", "company_part")
    return by_metric.join(pairs, "company_part")


def _unnamed(specs: DataFrame) -> DataFrame:
    """Searches without a hint, one row per metric."""
    return specs.where(F.col("company_part") == "").withColumn("metric", F.explode("metrics"))


def _names_period(period: Column) -> Column:
    """Whether the variant or the span of a fact contains the period; '' stands for any."""
    part = F.lower(period)
    held = [F.coalesce(F.contains(F.lower(text), part), F.lit(False)) for text in ("metric_variant", "source_span")]
    return (period == "") | held[0] | held[1]


def _asked_pairs(specs: DataFrame) -> tuple[dict, dict] | None:
    """The periods asked per metric, by all searches and by those without a hint; None for more than PAIRS pairs."""
    pairs = specs.select(F.explode("metrics").alias("metric"), "period", (F.col("company_part") == "").alias("unnamed"))
    found = pairs.where("metric IS NOT NULL").distinct().limit(2 * PAIRS + 1).collect()
    every, unnamed = {}, {}
    for row in found:
        every.setdefault(row.metric, set()).add(row.period)
        if row.unnamed:
            unnamed.setdefault(row.metric, set()).add(row.period)
    return (every, unnamed) if sum(map(len, every.values())) <= PAIRS else None


def _may_answer(pairs: dict) -> Column:
    """False for facts that no pair can find: one pattern per set of periods, over variant and span together."""
    together = F.lower(F.concat_ws("\n", "metric_variant", "source_span"))
    by_periods = {}
    for metric, periods in sorted(pairs.items()):
        by_periods.setdefault(frozenset(periods), []).append(metric)
    found = F.lit(False)
    for periods, metrics in by_periods.items():
        # lowered, so that no period can hold the mark that ends a literal part
        parts = [F.concat(F.lit(r"\Q"), F.lower(F.lit(period)), F.lit(r"\E")) for period in sorted(periods)]
        named = F.lit(True) if "" in periods else F.rlike(together, F.concat_ws("|", *parts))
        found = found | (F.col("metric").isin(*metrics) & named)
    return found


def _named_periods(pairs: dict) -> Column:
    """The periods of the fact's metric that the fact names."""
    none = F.array().cast("array<string>")
    if not pairs:
        return none
    entries = [c for metric, periods in sorted(pairs.items()) for c in (F.lit(metric), F.array(*map(F.lit, sorted(periods))))]
    return F.filter(F.coalesce(F.try_element_at(F.create_map(*entries), F.col("metric")), none), _names_period)


def _first_in_periods(facts: DataFrame, searches: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First facts per keys and asked period.

    The periods asked for the same keys are one array, so a fact meets one row however many
    searches there are, and only its matches are unfolded.
    """
    periods = searches.groupBy(*keys).agg(F.collect_set("period").alias("periods"))
    met = facts.join(periods, keys).withColumn("period", F.explode(F.filter("periods", _names_period))).drop("periods")
    return first_rows(met, [*keys, "period"], best_first(), n=limit)


def _give(asked: DataFrame, named: DataFrame, unnamed: DataFrame, limit: int) -> DataFrame:
    """The first facts of every search, given to each of its requests."""
    columns = [*SPEC, *FACT_COLUMNS, "doc_id"]
    found = named.select(columns).unionByName(unnamed.select(columns))
    top = first_rows(found, list(SPEC), best_first(), n=limit, rank="place")
    return asked.select("request_id", *SPEC).join(top, list(SPEC)).select("request_id", "place", *FACT_COLUMNS)


def facts_search(facts: DataFrame, requests: DataFrame, limit: int = K.FACT_ROWS) -> DataFrame:
    """First facts per request: requests(request_id, company_hint, metric_keys, period_label).

    A fact is found if its company contains the hint, its metric is one of the
    keys, and its variant or span contains the period label, all without regard
    to case; parts are literal text. No hint or no label means any.

    Hints become company names first, so facts and searches meet on company and
    metric. Facts shrink to the first ones per company, metric and asked period before
    they meet the single searches.

    The different pairs of metric and period are counted first. If they are few (PAIRS), only facts that
    some pair could find are moved, and for searches without a hint no more than the first ones
    per pair and task. Otherwise all facts move, and for searches without a hint they first
    shrink to the first ones per metric, variant and span, whatever the company.
    """
    asked = _with_spec(requests)
    specs = asked.select(*SPEC).where(F.size("metrics") > 0).distinct()
    keyed = facts.withColumn("metric", F.lower("metric_key"))
    by_company = _spec_companies(specs, facts)
    pairs = _asked_pairs(specs)
    if pairs:
        every, without_hint = pairs
        tagged = keyed.where(_may_answer(without_hint)).withColumn("period", F.explode(_named_periods(without_hint)))
        first = first_rows(tagged, ["metric", "period"], best_first(), n=limit)
        keyed = keyed.where(_may_answer(every))
    else:
        anywhere = first_rows(keyed, ["metric", "metric_variant", "source_span"], best_first(), n=limit)
        first = _first_in_periods(anywhere, _unnamed(specs), ["metric"], limit)
    heads = _first_in_periods(keyed, by_company, ["company", "metric"], limit)
    named = heads.join(by_company, ["company", "metric", "period"])
    unnamed = first.join(_unnamed(specs), ["metric", "period"])
    return _give(asked, named, unnamed, limit)


def facts_search_labelled(
    facts: DataFrame, requests: DataFrame, metrics: list[str], limit: int = K.FACT_ROWS
) -> DataFrame:
    """facts_search for requests that name metrics of a list and fiscal period labels.

    Facts shrink to the first ones per company, metric and label before they
    meet the searches, so the work per request does not grow with the facts.
    Metrics outside the list find nothing; a period that is no fiscal label is
    an error.
    """
    vocabulary = sorted({name.lower() for key in metrics for name in K.METRIC_EXPANSION.get(key.lower(), [key])})
    asked = _with_spec(requests)
    is_label = F.col("period").rlike("^(Q[1-4]FY[0-9]{2}|FY[0-9]{2}[A-Z]?)?$")
    complaint = F.raise_error(F.concat(F.lit("not a fiscal label: "), F.col("period"))).cast("string")
    specs = (
        asked.select(*SPEC)
        .where(F.size("metrics") > 0)
        .distinct()
        .withColumn("period", F.when(is_label, F.col("period")).otherwise(complaint))
    )
    tagged = (
        facts.withColumn("metric", F.lower("metric_key"))
        .where(F.col("metric").isin(*vocabulary))
        .withColumn("period", F.explode(_period_labels([F.col("metric_variant"), F.col("source_span")])))
    )
    # Asked pairs of metric and label: at most the vocabulary times the 3,101
    # forms a label can have, so they fit in every task however many requests.
    pairs = (
        specs.select(F.explode("metrics").alias("metric"), "period")
        .where(F.col("metric").isin(*vocabulary))
        .distinct()
    )
    wanted = tagged.join(F.broadcast(pairs), ["metric", "period"], "left_semi")
    heads = first_rows(wanted, ["company", "metric", "period"], best_first(), n=limit)
    # the names of more companies than can be found, but without making the heads once more
    by_company = _spec_companies(specs, facts.where(F.lower("metric_key").isin(*vocabulary)))
    named = heads.join(by_company, ["company", "metric", "period"])
    anywhere = first_rows(heads, ["metric", "period"], best_first(), n=limit)
    unnamed = anywhere.join(_unnamed(specs), ["metric", "period"])
    return _give(asked, named, unnamed, limit)


def facts_search_one(
    facts: DataFrame,
    metric_keys: list[str],
    company_hint: str | None = None,
    period_label: str | None = None,
    limit: int = K.FACT_ROWS,
) -> DataFrame:
    """First facts of one search; % and _ in the hint and label are wildcards."""
    names = [n for key in metric_keys for n in K.METRIC_EXPANSION.get(key.lower(), [key])]
    found = facts.where(F.lower("metric_key").isin(*[n.lower() for n in names]))
    if company_hint:
        found = found.where(matches_like(F.col("company"), company_hint))
    if period_label:
        found = found.where(
            matches_like(F.col("metric_variant"), period_label)
            | matches_like(F.col("source_span"), period_label)
        )
    return found.orderBy(*best_first()).limit(limit).select(*FACT_COLUMNS)


def period_equals(column: Column, label: str) -> Column:
    """Equality with a period label; a fiscal label matches as a part ("FY24" in "Q4FY24")."""
    return F.when(F.lit(label).rlike(K.FISCAL_LABEL_PATTERN), matches_like(column, label)).otherwise(
        column == label
    )


# --- page search --------------------------------------------------------------


def keyword_search(pages: DataFrame, company: str, keyword: str, limit: int = K.PAGE_ROWS) -> DataFrame:
    """First pages of matching companies that contain the keyword."""
    found = pages.where(matches_like(F.col("company"), company) & matches_like(F.col("text"), keyword))
    return found.orderBy("company", "doc_id", "page_num").limit(limit).select("doc_id", "page_num", "text")


# Fixed value: a word, as far as keywords are looked up by one.
WORD = r"[\p{L}\p{N}]+"


# Up to so many different searches, with so many different keywords, pages are compared with every keyword.
SEARCHES = 1_000
KEYWORDS = 32


def _few_keywords(asked: DataFrame) -> list[str] | None:
    """The different keywords, None if these or the different searches are many."""
    found = asked.select("company_part", "keyword").dropna().distinct().limit(SEARCHES + 1).collect()
    keywords = sorted({row.keyword for row in found})
    return keywords if len(found) <= SEARCHES and len(keywords) <= KEYWORDS else None


def _top_of_few(pages: DataFrame, searches: DataFrame, keywords: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first pages per search: each task keeps its first ones per company and keyword, without their texts."""
    lowered = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k)), F.lit(k)) for k in keywords]).cast("array<string>"))
    tagged = pages.select("company", "doc_id", "page_num", F.explode(held).alias("keyword"))
    heads = first_rows(tagged, ["company", "keyword"], order, n=limit).join(searches, ["company", "keyword"])
    return first_rows(heads, ["company_part", "keyword"], order, n=limit, rank="place")


def _longest_word(text: Column) -> Column:
    """The longest word of the text, null without one."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(words)["w"]


def _top_of_many(pages: DataFrame, searches: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first pages per search, by way of the distinct words of the pages."""
    searches = searches.withColumn("part", _longest_word(F.col("keyword")))
    page = ["company", "doc_id", "page_num"]
    in_question = pages.join(searches.select("company").distinct(), "company", "left_semi")
    words = in_question.select(*page, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    holding = names_containing(words.select("word"), searches.select("part"), "word", "part")
    may_hold = (
        words.join(holding, "word")
        .select(*page, "part").distinct()
        .join(searches.where(F.col("part").isNotNull()), ["company", "part"])
        .select(*page, "company_part", "keyword")
    )
    texts = pages.select(*page, F.lower("text").alias("lowered"))
    wordless = searches.where(F.col("part").isNull()).drop("part")
    hits = texts.join(may_hold, page).unionByName(texts.join(wordless, "company")).where(F.contains("lowered", F.col("keyword")))
    return first_rows(hits.drop("lowered"), ["company_part", "keyword"], order, n=limit, rank="place")


def keyword_search_batch(pages: DataFrame, requests: DataFrame, limit: int = K.PAGE_ROWS) -> DataFrame:
    """keyword_search per request: requests(request_id, company, keyword), both literal text.

    A page that holds a keyword has a word that contains the keyword's longest word. So these are
    looked up in the distinct words of the pages first, then pages meet by company and word the
    keywords they may hold, and only those are compared with the text. A page never meets the
    other keywords, however many there are. Keywords without a word, such as signs, are compared
    with all pages of their companies.

    The different searches are counted first. If there are few (SEARCHES, KEYWORDS), every page is
    compared with all keywords where it lies, and no text moves but those of the pages found.
    """
    asked = requests.withColumns({"company_part": F.lower("company"), "keyword": F.lower("keyword")})
    names = names_containing(pages.select("company"), asked.select("company_part"), "company", "company_part")
    searches = asked.select("company_part", "keyword").distinct().join(names, "company_part")
    page = ["company", "doc_id", "page_num"]
    order = [F.asc(c) for c in page]
    keywords = _few_keywords(asked)
    if keywords is not None:
        top = _top_of_few(pages, searches, keywords, order, limit)
        # at most limit times SEARCHES pages
        texts = pages.select(*page, "text").join(F.broadcast(top.select(page).distinct()), page)
        found = top.join(texts, page)
    else:
        found = _top_of_many(pages, searches, order, limit).join(pages.select(*page, "text"), page)
    return (
        asked.select("request_id", "company_part", "keyword")
        .join(found, ["company_part", "keyword"])
        .select("request_id", "place", "doc_id", "page_num", "text")
    )
