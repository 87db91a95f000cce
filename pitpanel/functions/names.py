"""Company-name and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate-form words that carry no identity.
NOISE_WORDS = (
    "THE", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY",
    "COMPANIES", "PLC", "LTD", "LIMITED", "LLC", "LP", "HOLDING", "HOLDINGS",
    "GROUP", "SA", "NV", "AG", "CLASS", "COM", "CMN", "NEW", "DEL",
)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalise_name(name: str | Column) -> Column:
    """Upper-case core of a name: no punctuation, brackets or corporate form.

    A missing name gives the empty string, as an all-noise name does.
    """
    text = F.upper(_col(name))
    text = F.replace(text, F.lit("&"), F.lit(" AND "))
    text = F.replace(text, F.lit("/"), F.lit(" "))
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"[^A-Z0-9 ]", " ")
    words = F.split(text, " +")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def pad_id(value: str | Column, width: int = 10) -> Column:
    """Left-pad with zeros; longer ids are kept whole (``lpad`` would cut them)."""
    text = _col(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def symbol(value: str | Column) -> Column:
    return F.upper(F.trim(_col(value)))


def separator_variants(value: str | Column) -> Column:
    """The symbol, then its share-class spellings: dot->hyphen, hyphen->dot."""
    text = symbol(value)
    return F.array(text, F.translate(text, ".", "-"), F.translate(text, "-", "."))


def fiscal_label(year: str | Column, period: str | Column) -> Column:
    """``2024-Q3`` as tagged by the filing; reported, never used as a key."""
    return F.concat_ws("-", _col(year).cast("string"), _col(period))
