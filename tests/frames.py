"""Hand-written catalogs with known answers."""

from __future__ import annotations

from rolecall.operators.prepare import prepare
from rolecall.spec import VULNERABILITY_FEED as FEED

RAW_SCHEMA = (
    "cveID string, vendorProject string, product string, vulnerabilityName string, "
    "dateAdded string, shortDescription string, requiredAction string, dueDate string, "
    "knownRansomwareCampaignUse string, notes string, cwes array<string>"
)


def raw_row(cve, vendor="Vendor", product="Product", opened="2024-01-01", due="2024-01-22",
            status="Unknown", tags=(), title="Title", text="Description", action="Apply updates"):
    tags = list(tags) if tags is not None else None
    return (cve, vendor, product, title, opened, text, action, due, status, "", tags)


def raw_frame(spark, rows, index=True):
    if not index:
        return spark.createDataFrame(rows, RAW_SCHEMA)
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, RAW_SCHEMA + ", row_index bigint")


def prepared_frame(spark, rows):
    return prepare(raw_frame(spark, rows, index=False), FEED)[0]


FEW_ROWS = [
    raw_row("CVE-2022-4100", "Heron Labs", "Gate 2", "2022-03-30", "2022-04-13", "Unknown",
            ["CWE-22", "CWE-352"]),
    raw_row("CVE-2021-8200", "Quill", "Ledger", "2021-12-05", "2021-12-26", "Known"),
    raw_row("CVE-2022-4099", "Heron Labs", "gateway", "2022-03-30", "2022-04-29", "Known",
            ["CWE-22"]),
]

CATALOG_ROWS = [
    raw_row("CVE-2020-7002", "Heron Labs", "Gate Keeper Pro", "2020-04-02", "2020-05-02", "Known",
            ["CWE-22", "CWE-502"]),
    raw_row("CVE-2020-7001", "Heron Labs", "Gate Keeper", "2020-04-02", "2020-04-16", "Known",
            ["CWE-22"]),
    raw_row("CVE-2020-7003", "Quill", "Ledger", "2020-09-21", "2020-10-12", "Unknown", ["CWE-502"]),
    raw_row("CVE-2021-1500", "quill & Sons", "Ledger Lite", "2021-01-11", "2021-02-01", "Unknown"),
    raw_row("CVE-2021-1501", "Quill", "Ink.*", "2021-06-30", "2021-07-21", "Unknown",
            ["CWE-352", "CWE-22", "CWE-352"]),
    raw_row("CVE-2021-1502", " Osprey ", "Nest", "2021-06-30", "2021-06-30", "Known"),
    raw_row("CVE-2022-0044", "Osprey", "Nest", "2022-12-31", "2023-01-31", "Unknown", ["CWE-22"]),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ids_of(df, column="cveID"):
    return [r[column] for r in df.select(column).collect()]
