"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a regular-expression class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, in order.

    All white space becomes a blank first: splitting at one plain character is
    several times cheaper than splitting at a pattern.
    """
    spaced = whole(text)
    for space in SPACE_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def count_words(text: Column) -> Column:
    """The number of words, as a long."""
    return F.size(words(text)).cast("long")


def null_safe_key(*columns: Column) -> Column:
    """A 64-bit key in which null differs from every value and position counts."""
    return F.xxhash64(*[part for c in columns for part in (c.isNull(), c)])


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that the table doesn't already use (case ignored)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names
