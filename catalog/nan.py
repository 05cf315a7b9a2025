"""NaN is a missing value in every operator: the same results as with NULL in its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import (
    apply_filters,
    flag_outliers,
    handle_missing,
    missing_report,
    profile_numeric,
    quality_score,
    remove_outliers,
    standardize,
    validate_ranges,
    validation_errors,
)

from .missing import COUNTS
from .registry import query


@query(f"""
SELECT *, CASE WHEN missing_percentage > 50 THEN 'drop_columns' ELSE 'fill_median' END AS recommendation FROM ({COUNTS})""")
def nan_missing(t):
    return missing_report(t.nan_events)


@query("SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {dirty_events})), 6)::DOUBLE AS value FROM {dirty_events}")
def nan_fill_mean(t):
    events = handle_missing(t.nan_events, {"value": "fill_mean", "sparse_col": "flag"})[0]
    return events.select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {dirty_events})) AS value FROM {dirty_events}")
def nan_fill_median(t):
    return handle_missing(t.nan_events, {"value": "fill_median", "sparse_col": "flag"})[0].select("event_id", "value")


@query("""
SELECT event_id, coalesce(round(value), (SELECT round(value) FROM {dirty_events} WHERE value IS NOT NULL
  GROUP BY round(value) ORDER BY count(*) DESC, round(value) LIMIT 1)) AS value FROM {dirty_events}""")
def nan_fill_mode(t):
    events = t.nan_events.select("event_id", F.round("value").alias("value"))
    return handle_missing(events, {"value": "fill_mode"})[0]


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {dirty_events})
SELECT event_id, value FROM {dirty_events}, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def nan_outliers(t):
    return remove_outliers(t.nan_events, ["value"]).select("event_id", "value")


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {dirty_events})
SELECT event_id, coalesce(value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false) AS value_outlier
FROM {dirty_events}, b""")
def nan_outlier_flags(t):
    return flag_outliers(t.nan_events, ["value"]).select("event_id", "value_outlier")


@query("""
SELECT 'value' AS column, 'max' AS rule, 50.0::DOUBLE AS expected, count(*) AS violations_count FROM {dirty_events} WHERE value > 50""")
def nan_ranges(t):
    return validate_ranges(t.nan_events, {"value": {"max": 50, "action": "flag"}})[1]


@query("SELECT event_id, CASE WHEN value IS NULL THEN -1 WHEN value > 50 THEN 50 ELSE value END AS value FROM {dirty_events} WHERE value IS NULL OR value >= 1")
def nan_range_drop_and_clip(t):
    """Missing values neither leave with a dropping rule nor become the bound of a clipping one."""
    events = t.nan_events.select("event_id", "value")
    kept = validate_ranges(events, {"value": {"min": 1, "action": "drop"}})[0]
    clipped = validate_ranges(kept, {"value": {"max": 50, "action": "clip"}})[0]
    return clipped.select("event_id", F.when(~F.isnan("value"), F.col("value")).alias("value")).na.fill(-1.0)


@query("SELECT event_id, value FROM {dirty_events} WHERE value > 20 AND value <> 30")
def nan_filter(t):
    spec = [{"column": "value", "op": ">", "value": 20}, {"column": "value", "op": "!=", "value": 30}]
    return apply_filters(t.nan_events, spec).select("event_id", "value")


@query("""
SELECT event_id AS row, 'required' AS rule FROM {dirty_events} WHERE value IS NULL
UNION ALL SELECT event_id, 'max' FROM {dirty_events} WHERE value > 60""")
def nan_validate(t):
    rules = {"value": {"type": "number", "required": True, "max": 60}}
    return validation_errors(t.nan_events, rules, "event_id").select("row", "rule")


@query("SELECT round(100.0::DOUBLE * count(value) / count(*), 2)::DOUBLE AS completeness_score FROM {dirty_events}")
def nan_quality(t):
    return quality_score(t.nan_events.select("value")).select("completeness_score")


@query("""
SELECT count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6)::DOUBLE AS mean,
  quantile_cont(value, 0.5) AS median, max(value) AS max FROM {dirty_events}""")
def nan_profile(t):
    found = profile_numeric(t.nan_events, ["value"])
    return found.select(F.col("values").alias("n"), "missing", F.round("mean", 6).alias("mean"), "median", "max")


@query("""
WITH f AS (SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {dirty_events})) AS v FROM {dirty_events})
SELECT event_id, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f), 6)::DOUBLE AS scaled FROM f""")
def nan_standardize(t):
    return standardize(t.nan_events, ["value"]).select("event_id", F.round("value_normalized", 6).alias("scaled"))


@query("""
SELECT event_id, user_id FROM {dirty_events} WHERE user_id IN (3, 5) OR CAST(user_id AS VARCHAR) LIKE '%7%'""")
def filter_number_text(t):
    """Lists and text operators on numeric columns."""
    listed = apply_filters(t.dirty_events, {"user_id": {"op": "in", "value": "3, 5"}})
    held = apply_filters(t.dirty_events, {"user_id": {"op": "contains", "value": "7"}})
    return listed.union(held).distinct().select("event_id", "user_id")
