"""Month and year text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations in calendar order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(name: Column) -> Column:
    """1..12 from the first three letters, 0 when unknown."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))


def month_text(raw: Column) -> Column:
    """"Jan 2020" or "2020" as ``YYYY-MM``; ongoing or unreadable text gives null."""
    text = F.lower(F.trim(raw))
    word = F.regexp_extract(text, r"^([a-z]+)\s+(\d{4})", 1)
    year = F.regexp_extract(text, r"^([a-z]+)\s+(\d{4})", 2)
    month = F.lpad(F.greatest(month_number(word), F.lit(1)).cast("string"), 2, "0")
    return (
        F.when(text.isin("present", "current", "now"), F.lit(None))
        .when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01")))
        .when(year != "", F.concat(year, F.lit("-"), month))
    )


def month_gap(a: Column, b: Column) -> Column:
    """Absolute distance in months of two ``YYYY-MM`` texts, null when either is unusable."""
    def months(c):
        return (
            F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int")
        )
    return F.abs(months(a) - months(b))
