"""What a block of text on a page is: a heading, a table cell or neither, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import column

#: How a numbered section begins, quarters and dates as table cells, marks that end prose, and headings of one short word.
SECTION = r"(?i)^(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)]?\s+\S"
QUARTER_CELL = r"(?i)^(?:q[1-4]|[1-4]q)(?:[-_/ ]?(?:fy)?\d{2,4})?$"
DATE_CELL = r"(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?$"
PROSE_END = r"[.?!。？！;；,，]$"
ONE_WORD = ["conclusion", "financials", "liquidity", "operations", "outlook", "overview", "results", "revenue", "risks", "strategy"]
#: Characters, words and lines of a heading at most; characters of a cell at most; letters of a heading in capitals at least.
LONGEST, MOST_WORDS, MOST_LINES, CELL, CAPITALS = 140, 16, 2, 40, 6
HAN = r"[\x{3400}-\x{9fff}]"


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(column(text), r"[ \t\n\x0b\f\r]+", " "))


def table_cell(text: Column | str) -> Column:
    """Whether a text looks like a cell: a quarter, a day of a month, or up to 40 characters with a digit."""
    t = F.trim(column(text))
    return t.rlike(QUARTER_CELL) | t.rlike(DATE_CELL) | (F.length(t) <= CELL) & t.rlike("[0-9]")


def heading(text: Column | str) -> Column:
    """Whether a block looks like a heading. Null and blank blocks do not.

    It is short, of two lines at most and does not end like prose. A section number makes it one; else a cell is none, a colon at its end or
    capitals without digits make it one; else 4 to 30 characters with Han among them, or two or more words that all begin with a capital.
    """
    raw = F.coalesce(column(text), F.lit(""))
    t = one_line(raw)
    lines = F.size(F.filter(F.split(raw, r"\r\n|[\n\r\x0b\f]"), lambda x: one_line(x) != ""))
    words = F.split(t, " ")
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}|\p{Lt}") & ~t.rlike("[0-9]")
    enough = (F.length(F.regexp_replace(t, r"\P{L}", "")) >= CAPITALS) | F.lower(t).isin(ONE_WORD)
    titled = (F.size(lettered) >= 2) & F.forall(lettered, lambda w: w.rlike(r"^\p{Lu}"))
    out = (F.length(t) > LONGEST) | (lines > MOST_LINES) | t.rlike(PROSE_END) | (F.size(words) > MOST_WORDS) | (t == "")
    return F.when(out, False).when(t.rlike(SECTION), True).when(table_cell(t), False).when(t.rlike("[:：]$") | capitals & enough, True).when(t.rlike(HAN), F.length(t).between(4, 30)).otherwise(titled)
