"""Catalog analytics on Spark: ingest, quality, statistics, search, clustering, publishing."""

from rolecall.spec import VULNERABILITY_FEED, CatalogSpec

__all__ = ["CatalogSpec", "VULNERABILITY_FEED"]
