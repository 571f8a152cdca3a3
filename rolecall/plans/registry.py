"""The published tables: name, place, columns and row order, as a function of the catalog spec."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators.quality import PROFILE_COLUMNS, SEVERITIES, SUMMARY_COLUMNS, issue_columns
from rolecall.operators.tags import long_columns
from rolecall.spec import DAYS, MONTH, PRODUCT, SOURCE, VENDOR, YEAR, CatalogSpec, slug

CONTRACT_VERSION = "1.0.0"
FEWEST_CASE_OUTPUTS = 3


@dataclass(frozen=True)
class OutputTable:
    """``sort`` holds SQL order expressions; columns used only there are not published."""

    name: str
    path: str
    columns: tuple[str, ...]
    sort: tuple[str, ...]
    needs: str = "always"  # or "due", "tags", "clustering"
    partition_by: tuple[str, ...] = ()
    format: str | None = None  # None: the run's own


def registry(spec: CatalogSpec) -> dict[str, OutputTable]:
    """The outputs of a catalog by name; tables of roles that the spec lacks are left out."""
    tag, status, ids = spec.tag_label, spec.status_label, spec.distinct_ids
    pos, other = spec.positive_key, spec.other_key
    keys = [slug(s) for s in spec.status_domain]
    severity = "array_position(array(" + ",".join(f"'{s}'" for s in SEVERITIES) + "), severity)"
    by_count = f"{ids} DESC"
    prepared = spec.prepared_fields
    tables = [
        # Output names, places, columns and orders.
        OutputTable("validation_summary", "validation/validation_summary",
                    tuple(SUMMARY_COLUMNS), ("check_id",)),
        OutputTable("validation_details", "validation/validation_details",
                    tuple(issue_columns(spec)),
                    (severity, "issue_code", "row_index ASC NULLS LAST")),
        OutputTable("field_profile", "validation/field_profile",
                    tuple(PROFILE_COLUMNS), ("field",)),
        OutputTable(f"{spec.name}_prepared", f"prepared/{spec.name}_prepared",
                    prepared, (spec.opened, spec.id), partition_by=(YEAR,)),
        OutputTable("monthly_added_counts", "tables/monthly_added_counts",
                    (MONTH, "record_count"), (MONTH,)),
        OutputTable("annual_added_summary", "tables/annual_added_summary",
                    (YEAR, "record_count", "first_month", "last_month", "covered_months",
                     "is_complete_year"), (YEAR,)),
        OutputTable("same_period_comparison", "tables/same_period_comparison",
                    (YEAR, "period_start_month", "period_end_month", "record_count"), (YEAR,)),
        OutputTable("deadline_descriptive", "tables/deadline_descriptive",
                    ("metric", "value"), ("metric_order",), needs="due"),
        OutputTable("deadline_frequency", "tables/deadline_frequency",
                    (DAYS, "record_count", "share"), (DAYS,), needs="due"),
        OutputTable("deadline_by_year", "tables/deadline_by_year",
                    (YEAR, "record_count", "min_days", "q1_days", "median_days", "mean_days",
                     "q3_days", "max_days"), (YEAR,), needs="due"),
        OutputTable(f"{status}_summary", f"tables/{status}_summary",
                    ("status", "record_count", "share"), ("status_order",)),
        OutputTable(f"{status}_by_year", f"tables/{status}_by_year",
                    (YEAR, *[f"{k}_count" for k in keys], "total_count",
                     *[f"{k}_share" for k in keys]), (YEAR,)),
        OutputTable("vendor_summary", "tables/vendor_summary",
                    (VENDOR, "record_count", "share", "cumulative_share", "product_count"),
                    ("record_count DESC", VENDOR)),
        OutputTable("vendor_product_summary", "tables/vendor_product_summary",
                    (VENDOR, PRODUCT, "record_count", "share"),
                    ("record_count DESC", VENDOR, PRODUCT)),
        OutputTable("vendor_product_top30", "tables/vendor_product_top30",
                    ("rank", VENDOR, PRODUCT, "record_count", "share"), ("rank",)),
        OutputTable("concentration_metrics", "tables/concentration_metrics",
                    ("metric", "value", "interpretation_scope"), ("metric_order",)),
        OutputTable(f"{spec.id_label}_{tag}_long", f"tables/{spec.id_label}_{tag}_long",
                    tuple(long_columns(spec)), (spec.id, tag), needs="tags"),
        OutputTable(f"{tag}_overall_summary", f"tables/{tag}_overall_summary",
                    (tag, ids, "denominator", "share"), (by_count, tag), needs="tags"),
        OutputTable(f"{tag}_{pos}_summary", f"tables/{tag}_{pos}_summary",
                    (tag, ids, "denominator", f"{pos}_share"), (by_count, tag), needs="tags"),
        OutputTable(f"{tag}_{other}_summary", f"tables/{tag}_{other}_summary",
                    (tag, ids, "denominator", f"{other}_share"), (by_count, tag), needs="tags"),
        OutputTable("query_cases_summary", "queries/query_cases_summary",
                    ("case_id", "start_date", "end_date", "vendor", status, tag, "record_count",
                     "vendor_count", "max_date", f"{pos}_count", "output_file"), ("case_id",),
                    needs="tags"),
        # One output per case, under the file name that the summary states.
        OutputTable("query_case", "queries/query_case_*.csv", prepared,
                    (f"{spec.opened} DESC", spec.id), needs="tags", format="csv"),
        OutputTable("ml_cluster_results", "ml/ml_cluster_results",
                    (spec.id, "cluster_id", "distance_to_centroid",
                     *([spec.title] if spec.title else []), VENDOR, spec.status),
                    ("cluster_id", "distance_to_centroid", spec.id), needs="clustering"),
        OutputTable("ml_cluster_selection", "ml/ml_cluster_selection",
                    ("k", "silhouette_score", "inertia", "selected"), ("k",),
                    needs="clustering"),
        OutputTable("ml_cluster_summary", "ml/ml_cluster_summary",
                    ("cluster_id", "record_count", "share", f"{pos}_count", f"{pos}_share",
                     spec.representative), ("cluster_id",), needs="clustering"),
        OutputTable("ml_cluster_keywords", "ml/ml_cluster_keywords",
                    ("cluster_id", "keyword_rank", "keyword", "tfidf_weight"),
                    ("cluster_id", "keyword_rank"), needs="clustering"),
    ]
    absent = {need for need, role in (("due", spec.due), ("tags", spec.tags)) if not role}
    return {t.name: t for t in tables if t.needs not in absent}


def case_output(spec: CatalogSpec, case_id: int) -> OutputTable:
    table = registry(spec)["query_case"]
    return replace(table, name=f"query_case_{case_id}", path=table.path.replace("*", str(case_id)))


def metadata_output(columns) -> OutputTable:
    """What the envelopes state of themselves."""
    return OutputTable(
        "metadata", "validation/metadata", tuple(columns), (SOURCE,), format="json"
    )


def required_outputs(spark: SparkSession, spec: CatalogSpec, clustering: bool) -> DataFrame:
    """(name, path, fewest): outputs a complete run must have, with the fewest parts of each."""
    rows = [
        (t.name, t.path, FEWEST_CASE_OUTPUTS if t.name == "query_case" else 1)
        for t in registry(spec).values()
        if t.needs != "clustering" or clustering
    ]
    return spark.createDataFrame(rows, "name string, path string, fewest int")


def missing_outputs(required: DataFrame, stored: DataFrame) -> DataFrame:
    """Required outputs of which storage holds too few parts, or none."""
    enough = stored.select("name", F.col("parts").alias("_parts"))
    return required.join(
        enough, (required.name == enough.name) & (F.col("_parts") >= F.col("fewest")), "left_anti"
    )
