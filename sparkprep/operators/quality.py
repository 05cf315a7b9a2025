"""Data quality score: completeness, validity, consistency, accuracy, overall and grade."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.parsing import is_lower, is_upper, kind_of, trim_text
from .cells import nan_to_null, quoted
from .dedupe import count_duplicates
from .missing import MissingAnalysis
from .outliers import outlier_rows
from .rowid import ROW_ID
from .validate import error_array

# The weights of the four parts and the lower limits of the grades.
WEIGHTS = {"completeness": 0.30, "validity": 0.30, "consistency": 0.20, "accuracy": 0.20}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


@dataclass(frozen=True)
class QualityScore:
    overall_score: float = 0.0
    completeness_score: float = 0.0
    validity_score: float = 0.0
    consistency_score: float = 0.0
    accuracy_score: float = 0.0
    grade: str = "F"

    def to_df(self, spark) -> DataFrame:
        schema = (
            "overall_score double, completeness_score double, validity_score double, "
            "consistency_score double, accuracy_score double, grade string"
        )
        return spark.createDataFrame([tuple(asdict(self).values())], schema)


def _clamp(score: float) -> float:
    return max(0.0, min(100.0, score))


def grade_of(score: float) -> str:
    return next((grade for limit, grade in GRADES if score >= limit), "F")


def measure_quality(
    df: DataFrame,
    *,
    before: MissingAnalysis | None = None,
    type_errors: int = 0,
    validation_error_count: int | None = None,
    schema: Mapping[str, Mapping[str, Any]] | None = None,
    duplicates: int | None = None,
) -> QualityScore:
    """Score a table.

    ``before`` is the missing-data analysis made before handling; ``duplicates`` are not counted again where they are known. One aggregate gives everything about
    completeness, consistency and schema errors; duplicates and quartiles need their own jobs.
    """
    df = nan_to_null(df.drop(ROW_ID))
    names = df.columns
    text = [f.name for f in df.schema if kind_of(f.dataType) == "text"]
    numeric = [f.name for f in df.schema if kind_of(f.dataType) == "numeric"]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [F.count(quoted(c)).alias(f"present_{i}") for i, c in enumerate(names)]
    for i, c in enumerate(text):
        col = quoted(c)
        aggregates += [
            F.bool_or(is_upper(col)).alias(f"upper_{i}"),
            F.bool_or(is_lower(col)).alias(f"lower_{i}"),
            F.bool_or(~is_upper(col) & ~is_lower(col)).alias(f"mixed_{i}"),
            F.bool_or(col != trim_text(col)).alias(f"padded_{i}"),
        ]
    for i, c in enumerate(numeric):
        aggregates += [
            F.avg(quoted(c)).alias(f"mean_{i}"),
            F.stddev_samp(quoted(c)).alias(f"std_{i}"),
        ]
    if schema:
        aggregates.append(F.sum(F.size(error_array(df, schema))).alias("schema_errors"))
    row = df.agg(*aggregates).first()
    rows = row["rows"]
    if rows == 0 or not names:
        return QualityScore()
    present = {c: row[f"present_{i}"] for i, c in enumerate(names)}

    completeness = 100 * sum(present.values()) / (rows * len(names))
    if before is not None:
        completeness -= min(20, 5 * len(before.high_missing))
    completeness = _clamp(completeness)

    schema_errors = row["schema_errors"] if schema else 0
    counted = schema_errors if validation_error_count is None else validation_error_count
    validity = 100 - min(40, 5 * type_errors) - min(40, 100 * counted / rows)
    if schema and schema_errors == 0:
        validity = min(100, validity + 10)
    validity = _clamp(validity)

    column_scores = []
    for c in names:
        if not present[c]:
            continue
        score = 100.0
        if c in text:
            i = text.index(c)
            styles = sum(bool(row[f"{style}_{i}"]) for style in ("upper", "lower", "mixed"))
            score -= 15 if styles > 1 else 0
            score -= 10 if row[f"padded_{i}"] else 0
        elif c in numeric and present[c] > 1:
            i = numeric.index(c)
            if row[f"mean_{i}"]:
                spread = row[f"std_{i}"] / abs(row[f"mean_{i}"])
                score -= 20 if spread > 2 else 10 if spread > 1 else 0
        column_scores.append(score)
    consistency = _clamp(sum(column_scores) / len(column_scores)) if column_scores else 100.0

    if duplicates is None:
        duplicates = count_duplicates(df).first()["duplicate_rows"]
    ratios = [r[5] for r in outlier_rows(df, numeric)] if numeric else []
    accuracy = 100 - min(30, 100 * duplicates / rows)
    if ratios:
        accuracy -= min(30, 100 * sum(ratios) / len(ratios))
    accuracy = _clamp(accuracy)

    parts = {
        "completeness": completeness, "validity": validity, "consistency": consistency, "accuracy": accuracy,
    }
    overall = sum(WEIGHTS[name] * value for name, value in parts.items())
    return QualityScore(
        overall_score=round(overall, 2),
        grade=grade_of(overall),
        **{f"{name}_score": round(value, 2) for name, value in parts.items()},
    )


def quality_score(df: DataFrame, **options) -> DataFrame:
    """The score as a one-row table; see ``measure_quality`` for the options."""
    return measure_quality(df, **options).to_df(df.sparkSession)


def error_rate_score(df: DataFrame, errors: DataFrame) -> DataFrame:
    """Score from the number of error rows alone, with its band."""
    marks = df.select(F.lit(1).alias("row"), F.lit(0).alias("error")).unionAll(
        errors.select(F.lit(0), F.lit(1))
    )
    counts = marks.agg(
        F.coalesce(F.sum("row"), F.lit(0)).alias("rows"), F.coalesce(F.sum("error"), F.lit(0)).alias("errors")
    )
    share = F.try_divide(100 * F.col("errors"), F.col("rows"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - share)))
    score = F.when(F.col("rows") > 0, inside).otherwise(0.0)
    band = F.when(score >= 90, "excellent").when(score >= 70, "good").otherwise("needs review")
    return counts.select("rows", "errors", score.alias("score"), band.alias("band"))
