import math
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from factlake.functions.text import clean_text, float_text, normalize_lines, strip_space, title_case

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_clean_text(values):
    texts = ["a\x00b", "a \t\t b", "a\tb", "a\n\n\n\nb", "a\n \n\nb", "  x 　\n", "", "a\x00\x00 b", "\n\n\nx\n\n\n"]
    expected = [
        re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\x00", " "))).strip() for t in texts
    ]
    assert values(clean_text, texts) == expected


@LOOSE
@given(st.lists(st.text(alphabet=" \t\n\x00ab.é ", max_size=30), min_size=20, max_size=40))
def test_clean_text_like_python(values, texts):
    expected = [
        re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\x00", " "))).strip() for t in texts
    ]
    assert values(clean_text, texts) == expected


def test_strip_space(values):
    texts = ["  a ", "\t\na\x0b\x0c", "\x1ca\x1f", " a b ", "   ", ""]
    assert values(strip_space, texts) == [t.strip() for t in texts]


def test_normalize_lines(values):
    texts = ["a  \nb\t\n", "a\r\nb \rc", "a\n\n", "x", "", "a\x0cb\x85c", "  a  \n b"]
    assert values(normalize_lines, texts) == ["\n".join(p.rstrip() for p in t.splitlines()) for t in texts]


def test_title_case(values):
    names = ["avg 6m volume lacs", "absolute 1y", "fy25e revenue change", "it's a.b x-y", "EV ebitda", "q4fy24"]
    assert values(title_case, names) == [n.title() for n in names]


@LOOSE
@given(st.lists(st.text(alphabet="abz019 .'/", max_size=12), min_size=20, max_size=40))
def test_title_case_like_python(values, names):
    assert values(title_case, names) == [n.title() for n in names]


def test_float_text(values):
    numbers = [0.0, 1.0, -2.5, 100.0, 1234.56, 1e7, 12345678.9, 1e15, 9.87e15, 1e16, 1.5e22, 1e-4, 1e-5, 2.5e-7, 0.1 + 0.2, -1e300]
    assert values(float_text, numbers, "double") == [repr(n) for n in numbers]
    assert values(float_text, [math.nan, math.inf, -math.inf], "double") == ["nan", "inf", "-inf"]


@LOOSE
@given(st.lists(st.floats(allow_nan=False, min_value=-1e15, max_value=1e15).map(lambda x: round(x, 2)), min_size=30, max_size=60))
def test_float_text_like_python(values, numbers):
    assert [float(t) for t in values(float_text, numbers, "double")] == numbers
