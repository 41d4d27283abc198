"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: every character that counts as white space.
SPACE = (
    r"[ \t\n\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Fixed value: every character sequence that ends a line.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Fixed value: the same white space as plain characters.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# A character no pattern uses, so that a backslash in a pattern is plain text.
NO_ESCAPE = "\u0001"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends; reads the ends only."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize_lines(text: Column) -> Column:
    """One newline per line end, none after the last line, no space before it."""
    unified = F.regexp_replace(text, LINE_END, "\n")
    body = F.regexp_replace(unified, r"\n\z", "")
    return F.regexp_replace(body, f"(?m){SPACE.replace(chr(92) + 'n', '')}+$", "")


def clean_text(text: Column) -> Column:
    """Page text as it is cut into chunks: no NUL, single spaces, at most one blank line.

    Texts without anything to replace, found by plain substring search, skip the
    patterns.
    """
    marks = ("\x00", "\t", "  ", "\n\n\n")
    to_do = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        to_do = to_do | F.contains(text, F.lit(mark))
    spaced = F.regexp_replace(F.translate(text, "\x00", " "), r"[ \t]{2,}|\t", " ")
    return strip_space(F.when(to_do, F.regexp_replace(spaced, r"\n{3,}", "\n\n")).otherwise(text))


def matches_like(text: Column, part: str) -> Column:
    """Case-insensitive substring test; % and _ in the part are wildcards."""
    return F.call_function("ilike", text, F.lit(f"%{part}%"), F.lit(NO_ESCAPE))


def matches_part(text: Column, part: Column) -> Column:
    """Case-insensitive literal substring test against another column."""
    return F.contains(F.lower(text), F.lower(part))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere ("6M", "Fy25E")."""
    gap = NO_ESCAPE + " "
    parted = F.regexp_replace(F.lower(text), r"(?<=[^\p{L} ])(?=\p{L})", gap)
    return F.regexp_replace(F.initcap(parted), gap, "")


def float_text(number: Column) -> Column:
    """A double as shortest decimal text: 1234.5, 100.0, 12000000.0, 1e+16, nan."""
    size = F.abs(number)
    fixed = F.regexp_replace(
        F.regexp_replace(number.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    parts = F.split(number.cast("string"), "E")
    power = parts[1].cast("int")
    scientific = F.concat(
        F.regexp_replace(parts[0], r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(number), "nan")
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), fixed)
        .otherwise(scientific)
    )
