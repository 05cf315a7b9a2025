"""Missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import handle_missing, missing_report, missing_summary
from sparkprep.operators.missing import apply_missing, fit_missing, handling_report

from .registry import query

COUNTS = """
SELECT "column", dtype, missing_count, round(100.0::DOUBLE * missing_count / n, 2)::DOUBLE AS missing_percentage FROM (
  SELECT 'value' AS column, 'double' AS dtype, count(*) FILTER (WHERE value IS NULL) AS missing_count, count(*) AS n FROM {dirty_events}
  UNION ALL SELECT 'sparse_col', 'bigint', count(*) FILTER (WHERE sparse_col IS NULL), count(*) FROM {dirty_events})"""


@query(f"""
SELECT *, CASE WHEN missing_percentage > 50 THEN 'drop_columns' ELSE 'fill_median' END AS recommendation
FROM ({COUNTS})""")
def missing_by_column(t):
    return missing_report(t.dirty_events)


@query("""
SELECT o_orderkey,
  coalesce(last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o_orderdate,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {gappy_orders})) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM {gappy_orders} WHERE o_orderpriority IS NOT NULL
    GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
FROM {gappy_orders}""")
def missing_recommended(t):
    """The automatic path: dates forward by key, numbers by the median, text by the mode."""
    return handle_missing(t.gappy_orders, order_by="o_orderkey")[0]


@query("""
WITH counts AS (
  SELECT "column", missing_count, 100.0::DOUBLE * missing_count / n AS share FROM (
  SELECT 'value' AS column, count(*) FILTER (WHERE value IS NULL) AS missing_count, count(*) AS n FROM {dirty_events}
  UNION ALL SELECT 'sparse_col', count(*) FILTER (WHERE sparse_col IS NULL), count(*) FROM {dirty_events}))
SELECT CAST(row_number() OVER (ORDER BY share DESC) AS INTEGER) AS position, 'column' AS level, "column", missing_count,
  round(share, 2)::DOUBLE AS missing_percentage, NULL::INTEGER AS affected_columns, NULL::INTEGER AS total_columns FROM counts
UNION ALL
SELECT 0, 'table', NULL, CAST(sum(missing_count) AS BIGINT), round(sum(share) / 6, 2)::DOUBLE, 2, 6 FROM counts""")
def missing_overview(t):
    return missing_summary(t.dirty_events).drop("recommendation")


def _fill(table, columns, strategy, **options):
    return handle_missing(table, dict.fromkeys(columns, strategy), **options)[0]


@query("""
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {dirty_lineitem})), 6)::DOUBLE AS l_quantity
FROM {dirty_lineitem}""")
def fill_mean(t):
    lines = _fill(t.dirty_lineitem, ["l_quantity"], "fill_mean")
    return lines.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"))


@query("""
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {dirty_events})) AS value,
  coalesce(sparse_col, (SELECT quantile_cont(sparse_col, 0.5) FROM {dirty_events}))::DOUBLE AS sparse_col
FROM {dirty_events}""")
def fill_median(t):
    events = _fill(t.dirty_events, ["value", "sparse_col"], "fill_median")
    return events.select("event_id", "value", F.col("sparse_col").cast("double").alias("sparse_col"))


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderpriority, 'null'), (
  SELECT o_orderpriority FROM {dirty_orders} WHERE o_orderpriority <> 'null'
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
FROM {dirty_orders}""")
def fill_mode(t):
    orders = t.dirty_orders.select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("null")).alias("o_orderpriority")
    )
    return _fill(orders, ["o_orderpriority"], "fill_mode")


@query("SELECT event_id, coalesce(value, 0) AS value FROM {dirty_events}")
def fill_value(t):
    return _fill(t.dirty_events.select("event_id", "value"), ["value"], "fill_value", fill_value=0)


FORWARD = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
BACKWARD = """coalesce(first_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "SELECT event_id, " + FORWARD.format(c="value", o="event_id") + " AS value, "
    + FORWARD.format(c="sparse_col", o="event_id") + " AS sparse_col FROM {dirty_events}"
)
def fill_forward(t):
    events = t.dirty_events.select("event_id", "value", "sparse_col")
    return _fill(events, ["value", "sparse_col"], "fill_forward", order_by="event_id")


@query(
    "SELECT event_id, " + BACKWARD.format(c="value", o="ts, event_id") + " AS value, "
    + BACKWARD.format(c="sparse_col", o="ts, event_id") + " AS sparse_col FROM {dirty_events}"
)
def fill_backward(t):
    """A compound order: rows get positions from a range partitioning first."""
    events = t.dirty_events.select("event_id", "ts", "value", "sparse_col")
    return _fill(events, ["value", "sparse_col"], "fill_backward", order_by=["ts", "event_id"]).drop("ts")


@query("""
SELECT o_orderkey, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
FROM (SELECT *, CASE WHEN day(o_orderdate) % 3 = 0 THEN NULL ELSE CAST(day(o_orderdate) AS INTEGER) END AS v FROM orders)""")
def fill_forward_ties(t):
    """Many orders share a day, and all of a day have the same value or none."""
    day = F.day("o_orderdate")
    orders = t.orders.select("o_orderkey", "o_orderdate", F.when(day % 3 != 0, day).alias("v"))
    return _fill(orders, ["v"], "fill_forward", order_by="o_orderdate").drop("o_orderdate")


@query("""
SELECT event_id, user_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM {dirty_events}""")
def fill_forward_by_user(t):
    """Each user's gaps take that user's own values."""
    events = t.dirty_events.select("event_id", "user_id", "value")
    return _fill(events, ["value"], "fill_forward", order_by="event_id", by=["user_id"])


@query("""
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {dirty_events} WHERE sparse_col IS NOT NULL)), 6)::DOUBLE AS value, sparse_col
FROM {dirty_events} WHERE sparse_col IS NOT NULL""")
def drop_rows(t):
    """A mean that is taken after the rows of an earlier column are dropped."""
    events = t.dirty_events.select("event_id", "sparse_col", "value")
    kept, _ = handle_missing(events, {"sparse_col": "drop_rows", "value": "fill_mean"})
    return kept.select("event_id", F.round("value", 6).alias("value"), "sparse_col")


@query("SELECT event_id, ts, user_id, event_type, value FROM {dirty_events} WHERE value IS NOT NULL")
def drop_columns(t):
    return handle_missing(t.dirty_events, {"sparse_col": "drop_columns", "value": "drop_rows"})[0]


@query("SELECT *, value IS NULL AS value_missing, sparse_col IS NULL AS sparse_col_missing FROM {dirty_events}")
def missing_flags(t):
    return handle_missing(t.dirty_events, "flag")[0]


@query("""
SELECT 'sparse_col' AS column, 'drop_rows' AS strategy,
  'Dropped ' || count(*) FILTER (WHERE sparse_col IS NULL) || ' rows with missing values' AS action,
  count(*) FILTER (WHERE sparse_col IS NOT NULL) AS final_rows FROM {dirty_events}
UNION ALL
SELECT 'value', 'flag', 'Created flag column', count(*) FILTER (WHERE sparse_col IS NOT NULL) FROM {dirty_events}""")
def missing_handling(t):
    events = t.dirty_events.select("event_id", "sparse_col", "value")
    plan = fit_missing(events, {"sparse_col": "drop_rows", "value": "flag"})
    left = apply_missing(events, plan).agg(F.count(F.lit(1)).alias("final_rows")).first()[0]
    return handling_report(events, plan).withColumn("final_rows", F.lit(left).cast("bigint"))
