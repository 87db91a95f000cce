"""Date expressions. Every time axis in the library is a DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date spellings accepted by the change-log reader.
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy",
                "yyyy/MM/dd")


def parse_date(text: str | Column) -> Column:
    """First format that parses; anything unparsable becomes null."""
    value = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[F.try_to_date(value, fmt) for fmt in DATE_FORMATS])


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(end, start)


def weekdays_between(start: Column, end: Column) -> Column:
    """Monday-to-Friday days in ``[start, end)``, in closed form.

    Counts the weekdays from a fixed Monday up to each end: five per full week
    plus up to five of the running week.
    """
    monday = F.lit("1900-01-01").cast("date")

    def since_monday(day: Column) -> Column:
        offset = F.datediff(day, monday)
        weeks = F.floor(offset / F.lit(7))
        return weeks * 5 + F.least(offset - weeks * 7, F.lit(5))

    return (since_monday(end) - since_monday(start)).cast("int")
