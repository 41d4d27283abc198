"""Questions to routes, and answers from the facts they route to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factlake import constants as K
from factlake.functions import questions as Q
from factlake.functions.text import float_text
from factlake.operators.conversations import chat_context, last_user_message
from factlake.operators.search import facts_search_labelled
from factlake.operators.terms import TermLists, search_terms
from factlake.operators.vectors import snippet_context
from factlake.session import stored


def route_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add tool, metric_keys, company_hint and period_label."""
    read = questions.withColumns(
        {
            "metric_keys": Q.question_metrics(F.col(text)),
            "company_hint": Q.question_company(F.col(text)),
            "period_label": Q.question_period(F.col(text)),
        }
    )
    return read.withColumn("tool", Q.question_tool(F.col("metric_keys")))


def classify_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add the store a question is about."""
    return questions.withColumn("intent", Q.intent_class(F.col(text)))


def conversation_questions(conversations: DataFrame) -> DataFrame:
    """The question to answer per conversation with its context, store and route.

    Conversations without a user message to answer give no row.
    """
    asked = last_user_message(conversations).where(F.col("query").isNotNull())
    in_context = asked.join(chat_context(conversations), "conv_id")
    routed = route_questions(classify_questions(in_context, "query"), "query")
    return routed.withColumnsRenamed({"conv_id": "question_id", "query": "text"})


# --- answers ------------------------------------------------------------------


def _variant() -> Column:
    return F.coalesce("metric_variant", F.lit("None"))


def _amount() -> Column:
    return F.concat_ws(" ", float_text(F.col("value")), F.col("unit"))


def _page() -> Column:
    return F.concat(F.lit("p."), F.col("source_page").cast("string"))


def _answer_texts(found: DataFrame) -> DataFrame:
    """row_count, answer and context of each request with facts."""
    period = F.coalesce(F.nullif("metric_variant", F.lit("")), F.nullif("period_type", F.lit("")))
    alone = F.concat(
        "company", F.lit(": "), "metric_key",
        F.when(period.isNull(), "").otherwise(F.concat(F.lit(" ("), period, F.lit(")"))),
        F.lit(" = "), _amount(), F.lit(" ("), _page(), F.lit(")"),
    )
    listed = F.concat(
        "metric_key", F.lit(" ("), _variant(), F.lit(") = "), _amount(), F.lit(" ("), _page(), F.lit(")")
    )
    lead = F.when(F.col("place") == 1, F.concat("company", F.lit(": "))).otherwise(F.lit("- "))
    piped = F.concat_ws(" | ", "company", "metric_key", _variant(), _amount(), _page())
    lines = found.select(
        "request_id",
        F.struct("place", alone.alias("alone"), F.concat(lead, listed).alias("line"), piped.alias("piped")).alias("l"),
    )
    per_request = lines.groupBy("request_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    several = F.size("ls") > 1
    return per_request.select(
        "request_id",
        F.size("ls").alias("row_count"),
        F.when(several, F.array_join("ls.line", "\n")).otherwise(F.col("ls")[0]["alone"]).alias("answer"),
        F.array_join("ls.piped", "\n").alias("context"),
    )


def fact_answer_lines(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Answer and context text per request from its ordered facts.

    found(request_id, place, ...) as a search gives it: a few rows per request.
    """
    return requests.select("request_id").join(_answer_texts(found), "request_id", "left").select(
        "request_id",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("answer", F.lit(K.MSG_NO_FACTS)).alias("answer"),
        F.coalesce("context", F.lit(K.MSG_NO_ROWS)).alias("context"),
    )


def _requests(routed: DataFrame) -> DataFrame:
    """Search requests of routed questions; a company column steps in for a missing hint."""
    given = F.col("company") if "company" in routed.columns else F.lit(None).cast("string")
    return routed.where(F.col("tool") == "facts_sql").select(
        F.col("question_id").alias("request_id"),
        F.coalesce(F.nullif("company_hint", F.lit("")), given).alias("company_hint"),
        "metric_keys",
        "period_label",
    )


def routed_requests(questions: DataFrame) -> DataFrame:
    """Search requests of the questions that are about facts."""
    return _requests(route_questions(questions))


def _search(facts: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    return facts_search_labelled(facts, requests, list(K.QUESTION_ALIASES), limit)


def search_questions(facts: DataFrame, questions: DataFrame, limit: int = K.FACT_ROWS) -> DataFrame:
    """First facts of every routed question, with request_id = question_id."""
    return _search(facts, routed_requests(questions), limit)


def answer_questions(facts: DataFrame, questions: DataFrame, limit: int = K.FACT_ROWS) -> DataFrame:
    """One answer per question: questions(question_id, text[, company])."""
    routed = route_questions(questions)
    answers = _answer_texts(_search(facts, _requests(routed), limit)).withColumnRenamed("request_id", "question_id")
    known = F.col("tool") == "facts_sql"
    return routed.select("question_id", "tool").join(answers, "question_id", "left").select(
        "question_id",
        F.when(known, "ok").otherwise("unknown").alias("status"),
        "tool",
        F.when(~known, K.MSG_NO_ROUTE).alias("message"),
        F.when(known, F.coalesce("row_count", F.lit(0))).alias("row_count"),
        F.when(known, F.coalesce("answer", F.lit(K.MSG_NO_FACTS))).alias("answer"),
    )


def answer_conversations(
    conversations: DataFrame,
    facts: DataFrame,
    index: DataFrame,
    lists: TermLists | None = None,
    limit: int = K.FACT_ROWS,
    k: int = K.ROUTED_HITS,
) -> DataFrame:
    """From whole conversations to what answers the last question of each.

    A question about facts is answered from the facts it names, if there are some; every other one
    from the nearest chunks. conv_id, question, context (the end of the conversation), tool
    (facts or vector), status (ok or no hits), row_count and answer: the fact lines, or the chunks
    with company and page. Conversations without a user message to answer give no row. The fact
    search is run once for all conversations; only questions without facts go to the chunks.
    """
    # read several times: computed once
    asked = stored(conversation_questions(conversations), "asked")
    found = _search(facts, _requests(asked.where(F.col("intent") == "facts")), limit)
    from_facts = _answer_texts(found).select(
        F.col("request_id").alias("question_id"), F.lit("facts").alias("tool"), "row_count", "answer"
    )
    from_facts = stored(from_facts, "answers")
    unanswered = asked.select("question_id", "text").join(from_facts.select("question_id"), "question_id", "left_anti")
    hits = search_terms(index, unanswered, k, lists=lists)
    counts = hits.groupBy("question_id").agg(F.count("*").cast("int").alias("row_count"))
    from_chunks = counts.join(snippet_context(hits, query_id="question_id"), "question_id").select(
        "question_id", F.lit("vector").alias("tool"), "row_count", F.col("context").alias("answer")
    )
    answers = from_facts.unionByName(from_chunks)
    return asked.select("question_id", "text", "context").join(answers, "question_id", "left").select(
        F.col("question_id").alias("conv_id"),
        F.col("text").alias("question"),
        "context",
        F.coalesce("tool", F.lit("vector")).alias("tool"),
        F.when(F.col("answer").isNull(), "no hits").otherwise("ok").alias("status"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("answer", F.lit(K.MSG_NO_HITS)).alias("answer"),
    )
