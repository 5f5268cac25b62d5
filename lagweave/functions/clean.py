"""Cleaning expressions. All of them return NULL instead of failing under ANSI mode."""

from pyspark.sql import Column, functions as F

from .fixed_values import MISSING_TEXTS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def present(text: Column) -> Column:
    """The text, or NULL where the cell stands for a missing value."""
    return F.when(~text.isin(MISSING_TEXTS), text)


def canonical_id(raw: Column) -> Column:
    """Site id as text without a float tail or leading zeros: 0970, 970 and 970.0 are one site."""
    text = F.trim(present(raw.cast("string")))
    return F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"^0+(?=.)", "")


def parse_day(raw: Column) -> Column:
    """Month/day/4-digit-year, padded or not."""
    return F.try_to_date(raw, "M/d/yyyy")


def parse_number(raw: Column) -> Column:
    """Plain decimal or exponent form; junk, 'inf' and '12d' give NULL."""
    return F.when(raw.rlike(_NUMBER), F.trim(raw).try_cast("double"))


def is_junk(raw: Column) -> Column:
    """Whether a cell holds something that is no number; false for missing cells."""
    return F.coalesce(present(raw).isNotNull() & ~raw.rlike(_NUMBER), F.lit(False))


def zero_fill(x: Column) -> Column:
    """NULL and NaN to 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
