"""The one-call cleaning run: names, types, ranges, missing data, filters, duplicates, outliers, checks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import profile
from ..operators.cells import nan_to_null
from ..operators.dedupe import remove_duplicates
from ..operators.filters import FilterPlan, compile_filters
from ..operators.missing import (
    MissingAnalysis,
    MissingPlan,
    analyze_missing,
    apply_missing,
    fit_missing,
    handling_report,
    missing_report,
)
from ..operators.names import renamed_count, standardize_columns
from ..operators.outliers import fit_outliers, apply_outliers
from ..operators.quality import QualityScore, measure_quality
from ..operators.ranges import VIOLATION_SCHEMA, apply_ranges, count_range_violations
from ..operators.rowid import ROW_ID, with_row_id
from ..operators.types import TypePlan, apply_types, fit_types, type_report
from ..operators.validate import quality_issue_rows, validation_errors
from ..session import materialize
from ..sources import read_any
from ..sources.sinks import write, write_report
from .history import append_manifest

ERROR_SCHEMA = "step string, action string, row long, column string, rule string, message string, value string"


@dataclass(frozen=True)
class CleanConfig:
    """What a run does. Every option can come from a JSON document through ``from_dict``."""

    normalize: bool = True
    enforce_types: bool = True
    type_map: Mapping[str, str] | None = None
    auto_detect_types: bool = True
    range_rules: Mapping[str, Mapping[str, Any]] | None = None
    handle_missing_data: bool = True
    missing_data_strategy: Mapping[str, str] | str | None = None
    default_missing_strategy: str = "fill_mean"
    fill_value: Any = None
    flag_missing_data: bool = False
    filters: Any = None
    remove_duplicates: bool = True
    remove_outliers: bool = False
    detect_data_quality_issues: bool = True
    validation_rules: Mapping[str, Mapping[str, Any]] | None = None
    profile: bool = True
    output_format: str = "csv"
    source_options: Mapping[str, Any] | None = None  # for the reader: format, sep, encoding, multi_line and others
    order_by: str | None = None  # key of the input rows when they have no position of their own

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]) -> CleanConfig:
        known = {f.name for f in fields(cls)}
        options = dict(options)
        handling = options.pop("handle_missing", None)
        if isinstance(handling, str):
            options["missing_data_strategy"] = handling
        elif handling is not None:
            options["handle_missing_data"] = handling
        unknown = set(options) - known
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**options)


@dataclass
class CleanResult:
    """The cleaned table, its reports, the error rows and a one-row summary."""

    df: DataFrame
    reports: dict[str, DataFrame]
    errors: DataFrame
    summary: DataFrame
    quality: QualityScore
    counters: dict[str, Any] = field(default_factory=dict)


def clean(source: DataFrame | str | list[str], config: CleanConfig | Mapping[str, Any] | None = None, *,
          spark: SparkSession | None = None) -> CleanResult:
    """Clean a table, a file, a folder or a list of files.

    The type decisions need one aggregate over the raw data. The typed table is then written once to
    the shared folder; missing-data statistics, filters and duplicates start from that copy.
    The rows that remain after duplicate removal are written once as well, and outliers, scores and
    profiles start from those.
    """
    started = time.time()
    config = config if isinstance(config, CleanConfig) else CleanConfig.from_dict(config or {})
    if isinstance(source, (str, list, tuple)):
        raw = read_any(spark or SparkSession.getActiveSession(), source, **(config.source_options or {}))
    else:
        raw = nan_to_null(source)
    spark = raw.sparkSession
    errors: list[tuple] = []
    reports: dict[str, DataFrame] = {}

    # Names and types: one aggregate decides normalisation and enforcement together.
    named = standardize_columns(raw) if config.normalize else raw
    renamed = renamed_count(raw.columns, named.columns)
    plan = fit_types(
        named.drop(ROW_ID),
        normalize=config.normalize,
        enforce=config.enforce_types,
        type_map=config.type_map,
        auto_detect=config.auto_detect_types,
    )
    typed = apply_types(named, plan)
    positioned = config.order_by is not None or ROW_ID in typed.columns
    typed = materialize(typed) if positioned else with_row_id(typed)
    initial_rows = typed.count()  # from the footers of the written files
    order = config.order_by or ROW_ID
    if config.enforce_types:
        reports["types"] = type_report(named, typed, plan)
        errors += [("types", "ignored", None, c, "type", message, None) for c, message in plan.errors]

    current = typed
    if config.range_rules:
        reports["ranges"] = count_range_violations(current, config.range_rules)
        current = apply_ranges(current, config.range_rules)

    data = [c for c in current.columns if c != ROW_ID]
    before = analyze_missing(current, data)
    handled = MissingPlan(final_rows=before.rows)
    rows = before.rows
    if config.handle_missing_data and before.total:
        strategy = config.missing_data_strategy
        if config.flag_missing_data and isinstance(strategy, Mapping):
            strategy = {**{c: "flag" for c in before.affected}, **strategy}
        handled = fit_missing(
            current, strategy, config.default_missing_strategy, config.fill_value, data, before
        )
        reports["missing"] = missing_report(current, before)
        reports["missing_handling"] = handling_report(current, handled)
        current = apply_missing(current, handled, order_by=order)
        if not handled.row_local:
            current = materialize(current)  # ordered fills shuffle; the following jobs should not repeat it
        rows = handled.final_rows

    rows_before_filters = rows
    if config.filters:
        compiled = compile_filters(current.drop(ROW_ID), config.filters)
        errors += [("filters", "ignored", None, c, "filter", why, None) for c, why in compiled.ignored]
        current = compiled.apply(current)
        rows = current.count()
    rows_before_cleaning = rows

    if config.remove_duplicates:
        current = materialize(remove_duplicates(current, "auto", order_by=order))
        rows = current.count()
    duplicates = rows_before_cleaning - rows
    rows_before_outliers = rows
    if config.remove_outliers:
        bounds = fit_outliers(current.drop(ROW_ID))
        current = apply_outliers(current, bounds)
        rows = current.count() if bounds else rows
    outliers = rows_before_outliers - rows

    after = analyze_missing(current, [c for c in current.columns if c != ROW_ID])
    if config.detect_data_quality_issues:
        errors += [
            ("quality", "reported", None, name, issue, message, None)
            for name, issue, _, _, message in quality_issue_rows(after)
        ]
    error_rows = spark.createDataFrame(errors, ERROR_SCHEMA)
    error_count, schema_errors = len(errors), 0
    if config.validation_rules:
        broken = validation_errors(current, config.validation_rules, order)
        schema_errors = broken.count()
        error_count += schema_errors
        error_rows = error_rows.unionByName(
            broken.select(
                F.lit("validation").alias("step"),
                F.lit("reported").alias("action"),
                F.col("row").cast("bigint").alias("row"),
                "column",
                "rule",
                "message",
                "value",
            )
        )
    cleaned = current.drop(ROW_ID) if ROW_ID not in raw.columns else current
    score = measure_quality(
        cleaned,
        before=before,
        type_errors=len(plan.errors),
        validation_error_count=schema_errors,
        schema=config.validation_rules,
        duplicates=0 if config.remove_duplicates else None,  # none are left, and dropping rows makes none
    )
    reports["quality"] = score.to_df(spark)
    if config.profile:
        reports["profile"] = profile.profile_columns(cleaned, _without_row_id(after))
    counters = {
        "rows_initial": initial_rows,
        "rows_before_cleaning": rows_before_cleaning,
        "rows_after": rows,
        "rows_filtered": rows_before_filters - rows_before_cleaning,
        "rows_removed": rows_before_cleaning - rows,
        "duplicates_removed": duplicates,
        "outliers_removed": outliers,
        "total_rows_removed": initial_rows - rows,
        "columns": len(cleaned.columns),
        "columns_renamed": renamed,
        "data_normalized": config.normalize,
        "types_enforced": len(plan.targets),
        "missing_data_handled": len(handled.steps),
        "output_format": config.output_format,
        "processing_time_seconds": round(time.time() - started, 2),
        "error_count": error_count,
        "quality_score": score.overall_score,
    }
    summary = spark.createDataFrame([tuple(counters.values())], SUMMARY_SCHEMA)
    return CleanResult(cleaned, reports, error_rows, summary, score, counters)


SUMMARY_SCHEMA = (
    "rows_initial long, rows_before_cleaning long, rows_after long, rows_filtered long, rows_removed long, "
    "duplicates_removed long, outliers_removed long, total_rows_removed long, columns int, "
    "columns_renamed int, data_normalized boolean, types_enforced int, missing_data_handled int, "
    "output_format string, processing_time_seconds double, error_count long, quality_score double"
)


def _without_row_id(found: MissingAnalysis) -> MissingAnalysis:
    counts = {c: n for c, n in found.counts.items() if c != ROW_ID}
    return MissingAnalysis(found.rows, counts, found.types)


def run(
    spark: SparkSession,
    source: DataFrame | str | list[str],
    output: str,
    config: CleanConfig | Mapping[str, Any] | None = None,
    *,
    manifest: str | None = None,
    run_id: str | None = None,
) -> CleanResult:
    """Clean, write the table to ``output``/data and the errors to ``output``/errors, keep the manifest.

    A run that fails is recorded as failed before the error is raised again.
    """
    run_id = run_id or uuid.uuid4().hex
    config = config if isinstance(config, CleanConfig) else CleanConfig.from_dict(config or {})
    started = datetime.now(timezone.utc)
    if manifest:
        append_manifest(spark, manifest, run_id, "processing", started)
    try:
        result = clean(source, config, spark=spark)
        write(result.df, f"{output}/data", config.output_format)
        write_report(result.errors, f"{output}/errors")
        for name, report in result.reports.items():
            write(report, f"{output}/reports/{name}", "parquet")
    except Exception as error:
        if manifest:
            append_manifest(spark, manifest, run_id, "failed", started, message=str(error))
        raise
    if manifest:
        append_manifest(spark, manifest, run_id, "completed", started, result.counters)
    return result


@dataclass(frozen=True)
class RowPlan:
    """The row-local part of a fitted run: what can be applied to further batches and to streams."""

    normalize: bool
    types: TypePlan
    ranges: Mapping[str, Mapping[str, Any]]
    missing: MissingPlan
    filters: FilterPlan | None
    rules: Mapping[str, Mapping[str, Any]]


def fit_rows(source: DataFrame, config: CleanConfig | Mapping[str, Any] | None = None) -> RowPlan:
    """Fit names, types, fill values and filters on a batch; ordered fills cannot be part of such a plan."""
    config = config if isinstance(config, CleanConfig) else CleanConfig.from_dict(config or {})
    source = nan_to_null(source)
    named = standardize_columns(source) if config.normalize else source
    types = fit_types(
        named,
        normalize=config.normalize,
        enforce=config.enforce_types,
        type_map=config.type_map,
        auto_detect=config.auto_detect_types,
    )
    typed = apply_ranges(apply_types(named, types), config.range_rules or {})
    missing = MissingPlan()
    if config.handle_missing_data:
        missing = fit_missing(
            typed, config.missing_data_strategy, config.default_missing_strategy, config.fill_value
        )
    if not missing.row_local:
        raise ValueError("forward and backward fills need the whole table; choose another strategy")
    filters = compile_filters(apply_missing(typed, missing), config.filters) if config.filters else None
    return RowPlan(config.normalize, types, config.range_rules or {}, missing, filters, config.validation_rules or {})


def apply_rows(df: DataFrame, plan: RowPlan) -> DataFrame:
    """Names, types, ranges, constant fills, flags, row drops and filters of a fitted plan; lazy, no shuffle."""
    named = standardize_columns(nan_to_null(df)) if plan.normalize else nan_to_null(df)
    handled = apply_missing(apply_ranges(apply_types(named, plan.types), plan.ranges), plan.missing)
    return plan.filters.apply(handled) if plan.filters else handled
