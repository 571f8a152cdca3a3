"""Calendar days from strict text or from typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import full_match

DAY_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def day(df: DataFrame, name: str) -> Column:
    """DATE of a column: strict ``YYYY-MM-DD`` text, or a date/timestamp cut to its day.

    Text that is not a real day gives null, never an error.
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(full_match(name, DAY_PATTERN), F.col(name).try_cast("date"))
    return F.col(name).cast("date")


def month_label(c) -> Column:
    return F.date_format(c, "yyyy-MM")


def year_number(c) -> Column:
    return F.year(c).cast("bigint")
