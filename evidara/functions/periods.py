"""Reporting periods as column expressions: keys like Q1_2024, Q1_FY2027 and FY2024."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import column

#: Fixed forms: quarter before year, year before quarter, with or without FY.
QUARTER_FIRST = r"(?i)\bQ([1-4])[\s_,-]{0,3}(FY)?\s?((?:19|20)?[0-9]{2})\b"
YEAR_FIRST = r"(?i)(?<!Q[1-4][\s_,-]{0,3})(?<!Q[1-4][\s_,-]{0,3}FY\s?)\b(FY)?\s?((?:19|20)[0-9]{2})[\s_-]{0,3}Q([1-4])\b"


def full_year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)


def quarters(text: Column | str) -> Column:
    """Quarter keys in the order of the patterns, then of their place, each once."""
    t = column(text)
    mark = lambda fy: F.when(F.upper(fy) == "FY", "FY").otherwise("")

    def keys(pattern: str, quarter: int, fy: int, year: int) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        part = lambda m, g: F.regexp_extract(m, pattern, g)
        return F.transform(found, lambda m: F.concat(F.lit("Q"), part(m, quarter), F.lit("_"), mark(part(m, fy)), full_year(part(m, year))))

    return F.array_distinct(F.concat(keys(QUARTER_FIRST, 1, 2, 3), keys(YEAR_FIRST, 3, 1, 2)))


def normal_period(p: Column | str) -> Column:
    """Upper case, '-' as '_', without FY before a year: equal for equivalent periods."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(column(p))), "-", "_"), "_FY", "_")


def prior_period(p: Column | str) -> Column:
    """The comparable period a year before: FY2024 -> FY2023, Q1_FY2024 -> Q1_FY2023; null for other forms."""
    c = column(p)
    head, year = F.regexp_extract(c, r"^(FY|Q[1-4]_(?:FY)?)([0-9]{4})$", 1), F.regexp_extract(c, r"^(FY|Q[1-4]_(?:FY)?)([0-9]{4})$", 2)
    return F.when(head != "", F.concat(head, (F.try_to_number(year, F.lit("9999")) - 1).cast("int").cast("string")))


def explicit_year(text: Column | str) -> Column:
    """The only year from 1900 to 2099 that a text names, else null."""
    years = F.array_distinct(F.regexp_extract_all(column(text), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))
    return F.when(F.size(years) == 1, F.element_at(years, 1).cast("int"))
