"""String predicates and projections, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Unicode calls white space, plus U+001C to U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c) -> Column:
    """Remove Unicode white space at both ends; ``trim`` alone knows only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_empty_text(c) -> Column:
    """A string of nothing but white space; null is not a string. Reads up to the first other
    character only."""
    return F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) == "", F.lit(False))


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, or a string that is empty after stripping. Other types are blank only when null."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return c.isNull() | is_empty_text(c)
    return c.isNull()


def has_edge_whitespace(c) -> Column:
    return F.coalesce(F.col(c) != strip(c), F.lit(False))


def full_match(c, pattern: str) -> Column:
    """The whole string matches; a trailing newline does not slip through."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def contains_ci(c: str, needle: str) -> Column:
    """Case-insensitive literal substring; null never matches."""
    return F.coalesce(F.contains(F.upper(F.col(c)), F.upper(F.lit(needle))), F.lit(False))
