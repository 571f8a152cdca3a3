"""The batch run: ingest, check, gate, prepare, analyse, publish.

Each stage hands a stored table to the next, so a lost executor repeats a stage's tasks and
never the whole chain: the landed records, the prepared table and one small count table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.errors import OutputMismatch
from rolecall.operators import (
    cases,
    concentration,
    durations,
    guards,
    prepare,
    quality,
    status,
    tags,
    textcluster,
    timeline,
)
from rolecall.plans.publish import Publisher, fingerprint, source_digest
from rolecall.plans.registry import (
    metadata_output,
    missing_outputs,
    registry,
    required_outputs,
)
from rolecall.session import checkpoint_root, cut_lineage
from rolecall.sources import envelope, records
from rolecall.spec import DAYS, DEFAULT_SEED, MONTH, VULNERABILITY_FEED, YEAR, CatalogSpec

INPUT_KINDS = ("envelope", "envelope_lines", "record_lines", "parquet")


@dataclass(frozen=True)
class RunConfig:
    source: str
    output_root: str
    spec: CatalogSpec = VULNERABILITY_FEED
    input_kind: str = "envelope"
    format: str = "parquet"
    clustering: bool = True
    seed: int = DEFAULT_SEED
    n_init: int = textcluster.N_INIT
    candidate_k: tuple[int, ...] = textcluster.CANDIDATE_K
    cases: tuple[dict, ...] | None = None
    run_id: str | None = None
    digest_input: bool = True  # one more pass over the input
    file_digests: bool = False  # one more pass over the outputs


@dataclass(frozen=True)
class RunResult:
    status: str
    root: str
    manifest: DataFrame


def _digest(spark: SparkSession, config: RunConfig, raw: DataFrame) -> str:
    """SHA-256 of a single document; an order-insensitive sum over many documents or over rows."""
    if not config.digest_input:
        return ""
    if config.input_kind != "envelope":
        return fingerprint(raw).first()["fingerprint"]
    files = source_digest(spark, config.source)
    row = files.agg(
        F.count("*").alias("n"),
        F.min("sha256").alias("only"),
        F.sum(F.xxhash64("sha256").cast("decimal(38,0)")).cast("string").alias("combined"),
    ).first()
    return row.only if row.n == 1 else row.combined


def _ingest(spark: SparkSession, config: RunConfig, landing: str):
    """(metadata or None, raw records, stored in ``landing`` unless they are Parquet already)."""
    if config.input_kind == "parquet":
        return None, records.read_record_parquet(spark, config.source)
    if config.input_kind == "record_lines":
        return None, records.read_record_lines(spark, config.source, config.spec, landing)
    by_line = config.input_kind == "envelope_lines"
    read = envelope.read_envelope(spark, config.source, config.spec, by_line, landing)
    return read.metadata, read.records


def _publish_quality(out: Publisher, raw, spec: CatalogSpec, metadata) -> bool:
    """Write the three quality tables; the verdict comes from the stored summary."""
    tables = registry(spec)
    summary = cut_lineage(quality.check_summary(raw, spec, metadata))
    failed = summary.filter(~F.col("passed")).select("check_id", "severity").collect()
    out.write(summary, tables["validation_summary"])
    # Only checks that failed are searched for rows; what they find is stored before it is sorted.
    found = quality.issues(raw, spec, summary, [r.check_id for r in failed])
    out.write(cut_lineage(found), tables["validation_details"])
    out.write(quality.field_profile(raw), tables["field_profile"])
    return not any(r.severity in quality.BLOCKING for r in failed)


def _analyses(prepared: DataFrame, config: RunConfig):
    """(output name, table) of every analysis, all reading the stored prepared table."""
    spec = config.spec
    # Time, window and status statistics share one count table, so one scan serves the three.
    keys = [YEAR, MONTH, spec.status] + ([DAYS] if spec.due else [])
    counts = cut_lineage(prepared.groupBy(*keys).agg(F.count("*").alias("n")))

    months = counts.groupBy(MONTH).agg(F.sum("n").alias("record_count"))
    timeline.check_months(months, spec.period_start, spec.period_end)
    monthly = timeline.monthly_counts(months, spec.period_start, spec.period_end)
    yield "monthly_added_counts", monthly
    yield "annual_added_summary", timeline.annual_summary(monthly, spec.incomplete_years)
    yield "same_period_comparison", timeline.same_period(monthly, spec.comparison_months)

    if spec.due:
        days = counts.groupBy(YEAR, DAYS).agg(F.sum("n").alias("n"))
        durations.check_counts(days)
        yield "deadline_descriptive", durations.descriptive(days)
        yield "deadline_frequency", durations.frequency(days)
        yield "deadline_by_year", durations.by_year(days)

    states = counts.groupBy(YEAR, F.col(spec.status).alias("status")).agg(F.sum("n").alias("n"))
    status.check_counts(states, spec)
    yield f"{spec.status_label}_summary", status.totals(states, spec)
    yield f"{spec.status_label}_by_year", status.by_year(states, spec)

    pairs = cut_lineage(concentration.pair_counts(prepared))
    concentration.check_pairs(pairs)
    yield "vendor_summary", concentration.vendor_summary(pairs)
    yield "vendor_product_summary", concentration.product_summary(pairs)
    yield "vendor_product_top30", concentration.top_products(pairs)
    yield "concentration_metrics", concentration.metrics(pairs)

    if spec.tags:
        # The gate has shown that ids are unique, so the long table needs no shuffle.
        long = tags.long_table(prepared, spec, unique_ids=True)
        yield f"{spec.id_label}_{spec.tag_label}_long", long
        yield f"{spec.tag_label}_overall_summary", tags.overall(prepared, long, spec)
        yield f"{spec.tag_label}_{spec.positive_key}_summary", tags.positive(prepared, long, spec)
        yield f"{spec.tag_label}_{spec.other_key}_summary", tags.other(prepared, long, spec)
    if config.clustering:
        result = textcluster.analyze(
            prepared, spec, config.candidate_k, config.seed, config.n_init
        )
        yield "ml_cluster_results", result.records
        yield "ml_cluster_selection", result.selection
        yield "ml_cluster_summary", result.summary
        yield "ml_cluster_keywords", result.keywords
        result.release()


def _finish(out: Publisher, state: str, config: RunConfig, digest: str) -> DataFrame:
    return out.finish(state, config.source, digest, config.spec, config.file_digests)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_core(spark: SparkSession, config: RunConfig) -> tuple[Publisher, DataFrame | None, str]:
    """Ingest, check and, if the input is valid, publish the prepared table and return it.

    Everything is staged: what an earlier run of the same id has published stays until this one is
    finished. The landed records go at the end.
    """
    if config.input_kind not in INPUT_KINDS:
        raise ValueError(f"input_kind must be one of {INPUT_KINDS}")
    run_id = config.run_id or uuid.uuid4().hex[:12]
    out = Publisher(spark, f"{config.output_root.rstrip('/')}/run-{run_id}", config.format)
    out.recover(config.spec)
    landing = f"{checkpoint_root(spark)}/landed-{run_id}-{uuid.uuid4().hex}"
    try:
        metadata, raw = _ingest(spark, config, landing)
        digest = _digest(spark, config, raw)
        if metadata is not None:
            out.write(metadata, metadata_output(metadata.columns))
        if not _publish_quality(out, raw, config.spec, metadata):
            return out, None, digest
        prepared, _ = prepare.prepare(raw, config.spec, mode="fail")
        table = registry(config.spec)[f"{config.spec.name}_prepared"]
        # The guards of all analyses, counted by the write itself.
        target = out.write(prepared, table, guards.counts(config.spec), guards.require)
        if config.format == "parquet":
            stored = spark.read.schema(prepared.schema).parquet(target).select(*prepared.columns)
        else:
            stored = cut_lineage(prepared)
        return out, stored, digest
    finally:
        _remove(spark, landing)


def run_data_core(spark: SparkSession, config: RunConfig) -> RunResult:
    """The run up to the prepared table, with a manifest of its own."""
    out, prepared, digest = run_core(spark, config)
    state = "validation_failed" if prepared is None else "data_core_complete"
    return RunResult(state, out.root, _finish(out, state, config, digest))


def run(spark: SparkSession, config: RunConfig) -> RunResult:
    """Publish every registered table, or only the quality tables when the input is invalid."""
    out, prepared, digest = run_core(spark, config)
    if prepared is None:
        return RunResult(
            "validation_failed", out.root, _finish(out, "validation_failed", config, digest)
        )
    spec, tables = config.spec, registry(config.spec)
    for name, table in _analyses(prepared, config):
        out.write(table, tables[name])
    if spec.tags:
        found = cases.run_cases(
            prepared, spec, config.cases, unique_ids=True, checked=True, store=True
        )
        out.write_cases(found, spec)
    check_complete(out, spec, config.clustering)
    return RunResult("complete", out.root, _finish(out, "complete", config, digest))


def check_complete(out: Publisher, spec: CatalogSpec, clustering: bool) -> None:
    """Refuse a run of which storage lacks a required output."""
    required = required_outputs(out.spark, spec, clustering)
    lacking = missing_outputs(required, out.stored(spec)).select("path")
    missing = sorted(r.path for r in lacking.collect())
    if missing:
        raise OutputMismatch("required outputs are missing", missing=missing)
