from factlake.functions import questions as Q
from factlake.operators import conversations as C, routing as R
from facts_data import facts


def test_metrics(values):
    texts = ["Revenue and EBITDA margin?", "operating profit of X", "patent risk", "", "adj eps", None]
    assert values(Q.question_metrics, texts) == [
        ["Revenue", "EBITDA", "EBIT", "EBITDA margin"], ["EBIT", "P/E"], ["PAT"], [], ["Adj. EPS", "EPS"], [],
    ]


def test_period(values):
    texts = ["in FY24?", "q4fy24 and fy25e", "xfy24", "FY2024", "Q5FY24", "fy25E."]
    assert values(Q.question_period, texts) == ["FY24", "Q4FY24", None, None, None, "FY25E"]


def test_company(values):
    texts = [
        'What is "Acme Ltd" revenue?', "the 'Beta' plan", "What is Acme revenue in FY24?", "what is it", "How", "Tell",
        "Acme & Zeta Corp rose", "Aa Bb, Cc Dd", '" Padded "', "no capitals", "Apple",
    ]
    assert values(Q.question_company, texts) == [
        "Acme Ltd", "Beta", "What is Acme revenue in FY", None, None, None,
        "Acme & Zeta Corp rose", "Aa Bb", "Padded", None, "Apple",
    ]


def test_intent(values):
    texts = ["Revenue?", "price target now", "marginal gains", "why so", "EV/EBITDA", "sotp"]
    assert values(Q.intent_class, texts) == ["facts", "facts", "vector", "vector", "facts", "facts"]


def test_answers(spark):
    df = facts(
        spark, {"company": "Acme", "value": 10000000.0, "confidence": 0.9},
        {"company": "Acme", "value": 12.5, "metric_key": "sales", "metric_variant": None, "confidence": 0.8, "source_page": 3},
        {"company": "Solo", "metric_key": "ROE", "metric_variant": None, "unit": "%", "value": 7.0},
    )
    questions = spark.createDataFrame(
        [(1, 'revenue of "Acme"', None), (2, 'roe of "Solo"', None), (3, 'roe of "None such"', None), (4, "why?", None),
         (5, "roe?", "Solo"), (6, "roe?", None)],
        "question_id int, text string, company string",
    )
    got = {r.question_id: r for r in R.answer_questions(df, questions).collect()}
    assert got[1].answer == "Acme: Revenue (Q1FY24) = 10000000.0 cr (p.1)\n- sales (None) = 12.5 cr (p.3)"
    assert got[2].answer == got[5].answer == got[6].answer == "Solo: ROE (quarter) = 7.0 % (p.1)"
    assert got[3].answer.startswith("No matching facts found") and got[3].row_count == 0
    assert (got[4].status, got[4].tool, got[4].answer) == ("unknown", "unknown", None)
    requests = R.routed_requests(questions)
    lines = {r.request_id: r.context for r in R.fact_answer_lines(requests, R.search_questions(df, questions)).collect()}
    assert lines[1] == "Acme | Revenue | Q1FY24 | 10000000.0 cr | p.1\nAcme | sales | None | 12.5 cr | p.3"
    assert lines[3] == "No rows."


def context(turns):
    lines = []
    for _, role, text in sorted(turns):
        body = (text or "").strip()
        if body:
            lines.append(f"{'user' if role is None else role}: {body}")
    return "\n".join(lines)[-1500:]


def test_conversations(spark):
    talks = {
        1: [(0, "user", " hi "), (1, None, "x"), (2, "assistant", "  "), (3, "USER", " last\n")],
        2: [(i, "u" if i % 3 else "", str(i % 7)) for i in range(3000)],
        3: [(0, "user", "a" * 4000), (1, "assistant", "b" * 700)],
        4: [(0, "system", None), (1, "user", "   ")],
        5: [(0, "assistant", "only")],
    }
    rows = [(c, t, role, text) for c, turns in talks.items() for t, role, text in turns]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(8)
    got = {r.conv_id: r.context for r in C.chat_context(df).collect()}
    assert got == {c: context(turns) for c, turns in talks.items()}
    asked = {r.conv_id: r.query for r in C.last_user_message(df).collect()}
    assert asked == {1: "last", 2: None, 3: "a" * 4000, 4: None, 5: None}


def test_answer_conversations(spark):
    from factlake.operators import terms

    stored = facts(spark, {"metric_key": "Roe", "company": "Acme", "value": 12.5, "unit": "%", "source_page": 4})
    pages = [("d", 3, 0, "Beta", "copper prices rose"), ("d", 4, 0, "Beta", "tin"), ("e", 1, 0, "Acme", "the roe of others")]
    index = terms.embed_terms(spark.createDataFrame(pages, "doc_id string, page_num int, chunk_idx int, company string, text string"))
    talk = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "yes?"), (1, 2, "User", 'What is the ROE of "Acme"?'),
        (2, 0, "user", "what is the roe of \"Gamma\"?"), (3, 0, "user", "copper prices"), (4, 0, "user", "zinc"),
        (5, 0, "assistant", "copper"), (6, 0, "user", "  "), (7, 0, None, "copper"),
    ]
    rows = R.answer_conversations(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), stored, index)
    got = {r.conv_id: (r.tool, r.status, r.row_count, r.answer) for r in rows.collect()}
    assert got.keys() == {1, 2, 3, 4}
    assert got[1][:3] == ("facts", "ok", 1) and got[1][3].startswith("Acme: Roe") and "12.5 % (p.4)" in got[1][3]
    # no such fact: nearest chunks instead
    assert got[2][:2] == ("vector", "ok") and "[Acme] (p.1) the roe of others" in got[2][3]
    assert got[3] == ("vector", "ok", 1, "[Beta] (p.3) copper prices rose")
    assert got[4] == ("vector", "no hits", 0, "No matching data found.")
