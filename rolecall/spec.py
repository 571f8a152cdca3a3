"""A catalog is any table whose columns play the roles below."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Bookkeeping columns a reader may add; never part of a catalog's field contract.
ROW_INDEX = "row_index"
MISTYPED = "mistyped"
SOURCE = "source_file"
BOOKKEEPING = (ROW_INDEX, MISTYPED, SOURCE)

# Derived columns whose names do not depend on the catalog.
VENDOR = "vendor_clean"
PRODUCT = "product_clean"
YEAR = "added_year"
MONTH = "added_month"
DAYS = "deadline_days"


def slug(value: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", value.lower()).strip("_")


@dataclass(frozen=True)
class CatalogSpec:
    """Role name -> column name, plus the value domains the checks need."""

    id: str
    vendor: str
    product: str
    opened: str
    status: str
    status_domain: tuple[str, ...]
    positive_status: str
    due: str | None = None
    tags: str | None = None
    title: str | None = None
    description: str | None = None
    action: str | None = None
    notes: str | None = None
    fields: tuple[str, ...] = ()
    id_pattern: str | None = None
    tag_pattern: str | None = None
    upper_tags: bool = False  # a searched tag is folded to upper case first
    id_label: str = "record"
    tag_label: str = "tag"
    status_label: str = "status"
    name: str = "catalog"
    period_start: str | None = None
    period_end: str | None = None
    incomplete_years: frozenset[int] = frozenset()
    comparison_months: tuple[int, int] = (1, 7)
    expected_rows: int | None = None
    expected_counters: Mapping[str, int] | None = field(default=None, hash=False)
    tag_denominators: Mapping[str, int] | None = field(default=None, hash=False)

    def __post_init__(self):
        if self.positive_status not in self.status_domain:
            raise ValueError("positive_status must belong to status_domain")

    def with_options(self, **changes) -> "CatalogSpec":
        return replace(self, **changes)

    @property
    def date_fields(self) -> tuple[str, ...]:
        return tuple(c for c in (self.opened, self.due) if c)

    @property
    def key_text(self) -> tuple[str, ...]:
        return tuple(
            c for c in (self.vendor, self.product, self.title, self.description, self.action) if c
        )

    @property
    def has_tags(self) -> str:
        return f"has_{self.tag_label}"

    @property
    def tag_count(self) -> str:
        return f"{self.tag_label}_count"

    @property
    def distinct_ids(self) -> str:
        return f"distinct_{self.id_label}_count"

    @property
    def representative(self) -> str:
        return f"representative_{self.id_label}"

    @property
    def other_statuses(self) -> tuple[str, ...]:
        return tuple(s for s in self.status_domain if s != self.positive_status)

    @property
    def positive_key(self) -> str:
        return slug(self.positive_status)

    @property
    def other_key(self) -> str:
        others = self.other_statuses
        return slug(others[0]) if len(others) == 1 else "other"

    @property
    def derived_fields(self) -> tuple[str, ...]:
        names = [label for role, label in ((self.vendor, VENDOR), (self.product, PRODUCT)) if role]
        names += [YEAR, MONTH]
        if self.due:
            names.append(DAYS)
        if self.tags:
            names += [self.has_tags, self.tag_count]
        return tuple(names)

    @property
    def raw_fields(self) -> tuple[str, ...]:
        if self.fields:
            return self.fields
        roles = (
            self.id, self.vendor, self.product, self.title, self.opened, self.description,
            self.action, self.due, self.status, self.notes, self.tags,
        )
        return tuple(c for c in roles if c)

    @property
    def prepared_fields(self) -> tuple[str, ...]:
        return self.raw_fields + self.derived_fields


# Field names, domains and patterns of the public vulnerability feed.
VULNERABILITY_FEED = CatalogSpec(
    id="cveID",
    vendor="vendorProject",
    product="product",
    title="vulnerabilityName",
    opened="dateAdded",
    description="shortDescription",
    action="requiredAction",
    due="dueDate",
    status="knownRansomwareCampaignUse",
    notes="notes",
    tags="cwes",
    fields=(
        "cveID",
        "vendorProject",
        "product",
        "vulnerabilityName",
        "dateAdded",
        "shortDescription",
        "requiredAction",
        "dueDate",
        "knownRansomwareCampaignUse",
        "notes",
        "cwes",
    ),
    status_domain=("Known", "Unknown"),
    positive_status="Known",
    id_pattern=r"CVE-[0-9]{4}-[0-9]{4,19}",
    tag_pattern=r"CWE-[0-9]+",
    upper_tags=True,
    id_label="cve",
    tag_label="cwe",
    status_label="ransomware",
    name="kev",
)

# The dated snapshot whose counts are known in advance.
VULNERABILITY_SNAPSHOT = VULNERABILITY_FEED.with_options(
    period_start="2021-11",
    period_end="2026-07",
    incomplete_years=frozenset({2021, 2026}),
    expected_rows=1656,
    expected_counters={
        "empty_cwe": 171,
        "with_cwe": 1485,
        "known_with_cwe": 294,
        "unknown_with_cwe": 1191,
        "vendor_whitespace": 6,
        "product_whitespace": 10,
    },
    tag_denominators={"overall": 1485, "Known": 294, "Unknown": 1191},
)
DEFAULT_SEED = 20260806
