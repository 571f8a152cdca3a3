"""Offending rows: all of them are stored and counted, a message shows the first few."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rolecall.session import store

SHOWN = 20  # offenders that a message displays


def offenders(bad: DataFrame, name: str) -> tuple[list, dict]:
    """The first rows of ``bad`` for display; how many there are and the table that holds all.

    Without an offender nothing is stored and both are empty.
    """
    if bad.isEmpty():
        return [], {}
    path = store(bad, f"offenders-{name}")
    kept = bad.sparkSession.read.schema(bad.schema).parquet(path)
    return kept.limit(SHOWN).collect(), {"count": kept.count(), "stored": path}
