"""Whole cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import clean, run, run_history
from sparkprep.functions.parsing import format_datetime, parse_datetime
from sparkprep.operators.types import first_row_types
from sparkprep.plans.clean import ERROR_SCHEMA
from sparkprep.plans.history import read_manifest

from .registry import query

EVENT_CONFIG = {
    "filters": {"value": {"op": ">=", "value": 2}, "event_type": {"op": "!=", "value": "signup"}},
    "range_rules": {"value": {"max": 300, "action": "clip"}},
    "missing_data_strategy": {"value": "fill_median", "event_type": "fill_mode", "sparse_col": "drop_columns"},
    "remove_outliers": True,
    "order_by": "event_id",
}


def _bounds(column: str, source: str) -> str:
    return f"""(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"""


# The steps one by one: types and null tokens, ranges, missing data, filters, outliers of the three numbers.
CLEANED = f"""
WITH typed AS (SELECT event_id, ts, user_id, nullif(nullif(trim(event_type), 'N/A'), '') AS event_type, value, sparse_col FROM {{dirty_events}}),
ranged AS (SELECT event_id, ts, user_id, event_type, CASE WHEN value > 300 THEN 300.0::DOUBLE ELSE value END AS value FROM typed),
filled AS (SELECT event_id, ts, user_id,
    coalesce(event_type, (SELECT event_type FROM ranged WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
    coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ranged)) AS value FROM ranged),
filtered AS (SELECT * FROM filled WHERE value >= 2 AND lower(event_type) <> 'signup'),
s1 AS (SELECT f.* FROM filtered f, {_bounds('event_id', 'filtered')} WHERE event_id BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
s2 AS (SELECT s1.* FROM s1, {_bounds('user_id', 's1')} WHERE user_id BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
s3 AS (SELECT s2.* FROM s2, {_bounds('value', 's2')} WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
"""


@query(CLEANED + "SELECT * FROM s3")
def clean_events(t):
    return clean(t.dirty_events, EVENT_CONFIG).df


@query(CLEANED + """
SELECT (SELECT count(*) FROM typed) AS rows_initial, (SELECT count(*) FROM filtered) AS rows_before_cleaning,
  (SELECT count(*) FROM s3) AS rows_after, (SELECT count(*) FROM filled) - (SELECT count(*) FROM filtered) AS rows_filtered,
  (SELECT count(*) FROM filtered) - (SELECT count(*) FROM s3) AS outliers_removed, 0::BIGINT AS duplicates_removed,
  CAST(5 AS INTEGER) AS columns, CAST(3 AS INTEGER) AS missing_data_handled""")
def clean_events_summary(t):
    return clean(t.dirty_events, EVENT_CONFIG).summary.select(
        "rows_initial", "rows_before_cleaning", "rows_after", "rows_filtered", "outliers_removed",
        "duplicates_removed", "columns", "missing_data_handled",
    )


@query("""
WITH typed AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, TRY_CAST(o_totalprice AS BIGINT) AS o_totalprice,
  try_strptime(o_orderdate, '%m/%d/%Y') AS o_orderdate, nullif(o_orderpriority, 'null') AS o_orderpriority FROM {dirty_orders})
SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM typed))::DOUBLE AS o_totalprice, o_orderdate,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM typed WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
    ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM typed""")
def clean_orders(t):
    """Text only: every type is inferred, gaps are filled as recommended."""
    cleaned = clean(t.dirty_orders, {"order_by": "o_orderkey"}).df
    return cleaned.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("""
SELECT c_name, c_mktsegment, c_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(c_name)) ORDER BY c_name) AS rn FROM (
    SELECT trim(c_name) AS c_name, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM {near_dup_customers})) WHERE rn = 1""")
def clean_customers(t):
    """Two spellings of every row: after trimming, the normalised comparison finds them."""
    return clean(t.near_dup_customers, {"order_by": "c_name"}).df


ORDER_ERRORS = """
SELECT 'validation' AS step, 'reported' AS action, CAST(o_orderkey AS BIGINT) AS row, 'o_totalprice' AS column, 'max' AS rule FROM {dirty_orders}
WHERE TRY_CAST(o_totalprice AS DOUBLE) > 300000
UNION ALL SELECT 'filters', 'ignored', NULL, 'no_such_column', 'filter'
UNION ALL SELECT 'types', 'ignored', NULL, 'gone', 'type'
UNION ALL SELECT 'quality', 'reported', NULL, 'o_totalprice', 'missing'"""

ORDER_CONFIG = {
    "order_by": "o_orderkey",
    "type_map": {"gone": "int"},
    "filters": {"no_such_column": {"op": ">", "value": 1}},
    "validation_rules": {"o_totalprice": {"type": "number", "max": 300000}},
    "missing_data_strategy": {"o_orderpriority": "fill_mode", "o_totalprice": "flag"},
}


@query(ORDER_ERRORS)
def clean_error_rows(t):
    """Errors of all steps in one table."""
    return clean(t.dirty_orders, ORDER_CONFIG).errors.select("step", "action", "row", "column", "rule")


@query(ORDER_ERRORS)
def run_error_file(t):
    """The same errors, read back from the report that a run writes, one line per error."""
    run(t.spark, t.dirty_orders, t.scratch, {**ORDER_CONFIG, "profile": False})
    return t.spark.read.schema(ERROR_SCHEMA).json(f"{t.scratch}/errors").select("step", "action", "row", "column", "rule")


@query(CLEANED + """
SELECT 'completed' AS status, (SELECT count(*) FROM typed) AS rows_initial, (SELECT count(*) FROM filtered) AS rows_before_cleaning,
  (SELECT count(*) FROM s3) AS rows_after, (SELECT count(*) FROM filled) - (SELECT count(*) FROM filtered) AS rows_filtered,
  (SELECT count(*) FROM filtered) - (SELECT count(*) FROM s3) AS rows_removed, 0::BIGINT AS duplicates_removed,
  (SELECT count(*) FROM filtered) - (SELECT count(*) FROM s3) AS outliers_removed,
  (SELECT count(*) FROM typed) - (SELECT count(*) FROM s3) AS total_rows_removed, 5::BIGINT AS columns, 0::BIGINT AS columns_renamed,
  3::BIGINT AS missing_data_handled, 'True' AS data_normalized, 'parquet' AS output_format, true AS timed, true AS scored,
  (SELECT count(*) FROM s3) AS rows_written""")
def run_manifest(t):
    """What the manifest tells about a run, next to the rows that it wrote."""
    options = {**EVENT_CONFIG, "output_format": "parquet", "profile": False}
    run(t.spark, t.dirty_events, f"{t.scratch}/out", options, manifest=f"{t.scratch}/manifest")
    history = run_history(read_manifest(t.spark, f"{t.scratch}/manifest"))
    written = t.spark.read.parquet(f"{t.scratch}/out/data").count()
    numbers = [
        "rows_initial", "rows_before_cleaning", "rows_after", "rows_filtered", "rows_removed", "duplicates_removed",
        "outliers_removed", "total_rows_removed", "columns", "columns_renamed", "missing_data_handled",
    ]
    counter = lambda name: F.col("counters")[name]
    return history.select(
        "status", *[counter(n).cast("bigint").alias(n) for n in numbers],
        counter("data_normalized").alias("data_normalized"), counter("output_format").alias("output_format"),
        (counter("processing_time_seconds").cast("double") > 0).alias("timed"),
        counter("quality_score").cast("double").between(0, 100).alias("scored"),
        F.lit(written).cast("bigint").alias("rows_written"),
    )


@query("""
SELECT 'o_orderkey' AS column, 'numeric' AS kind UNION ALL SELECT 'o_custkey', 'text' UNION ALL SELECT 'open', 'boolean'
UNION ALL SELECT 'o_orderdate', CASE WHEN try_strptime(o_orderdate, '%m/%d/%Y') IS NULL THEN 'text' ELSE 'datetime' END
  FROM (SELECT * FROM {dirty_orders} ORDER BY CAST(o_orderkey AS BIGINT) LIMIT 1)
UNION ALL SELECT 'o_orderpriority', 'text' UNION ALL SELECT 'gone', 'text'""", name="first_row_types")
def preview_types(t):
    """Types told from the first record alone, as a preview does."""
    records = t.dirty_orders.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_custkey", (F.length("o_orderdate") > 0).alias("open"),
        "o_orderdate", "o_orderpriority", F.lit(None).cast("double").alias("gone"),
    ).orderBy("o_orderkey")
    return t.spark.createDataFrame(list(first_row_types(records).items()), "column string, kind string")


@query("""
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%d.%m.%Y %H:%M') AS local, try_strptime(o_orderpriority, '%m/%d/%Y') AS no_date
FROM (SELECT *, try_strptime(o_orderdate, '%m/%d/%Y') AS d FROM {dirty_orders})""")
def date_helpers(t):
    """Dates parsed by a layout, or null, and written in others."""
    day = parse_datetime(F.col("o_orderdate"), "%m/%d/%Y")
    return t.dirty_orders.select(
        "o_orderkey", format_datetime(day).alias("day"), format_datetime(day, "dd.MM.yyyy HH:mm").alias("local"),
        parse_datetime(F.col("o_orderpriority"), "%m/%d/%Y").alias("no_date"),
    )
