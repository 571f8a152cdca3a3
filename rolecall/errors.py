"""One exception per failure family; each carries a stable code, a message and a context."""

from __future__ import annotations


class CatalogError(Exception):
    code = "KEV-UNKNOWN-000"

    def __init__(self, message: str, **context):
        super().__init__(f"[{self.code}] {message}" + (f" {context}" if context else ""))
        self.message = message
        self.context = context


# The error codes callers match on.
class SourceNotFound(CatalogError):
    code = "KEV-IO-001"


class SourceMalformed(CatalogError):
    code = "KEV-IO-002"


class SourceEncoding(CatalogError):
    code = "KEV-IO-003"


class EnvelopeMismatch(CatalogError):
    code = "KEV-SCHEMA-001"


class RecordMismatch(CatalogError):
    code = "KEV-SCHEMA-002"


class BadDateRange(CatalogError):
    code = "KEV-QRY-001"


class BadStatus(CatalogError):
    code = "KEV-QRY-002"


class BadTag(CatalogError):
    code = "KEV-QRY-003"


class MissingColumns(CatalogError):
    code = "KEV-QRY-004"


class OutputMismatch(CatalogError):
    code = "KEV-OUT-001"


class OutputFailed(CatalogError):
    code = "KEV-OUT-002"


class ClusterConfig(CatalogError):
    code = "KEV-ML-001"


class ClusterData(CatalogError):
    code = "KEV-ML-002"


class StatisticsInput(ValueError):
    """Input a statistics operator cannot summarise."""


def require_columns(df, columns, error=MissingColumns, what="input"):
    """Fail before any job starts when a column is absent."""
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        if issubclass(error, CatalogError):
            raise error(f"{what} lacks columns", missing=missing)
        raise error(f"{what} lacks columns: {missing}")
