"""Validation and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import (
    error_rate_score,
    quality_issues,
    quality_score,
    split_valid,
    type_ok,
    validate_schema,
    validation_errors,
)

from .registry import query

ORDER_RULES = {
    "o_totalprice": {"type": "number", "required": True, "min": 20000, "max": 300000},
    "o_orderdate": {"type": "datetime", "required": True},
    "o_orderpriority": {"type": "string"},
    "o_custkey": {"type": "boolean"},
}
# Rules without the impossible one, so that both sides of the split have rows.
SPLIT_RULES = {k: v for k, v in ORDER_RULES.items() if k != "o_custkey"}


@query("""
SELECT o_orderkey AS row, 'o_totalprice' AS column, 'type' AS rule,
  '''o_totalprice'' holds string where number is wanted' AS message, o_totalprice AS value
FROM {dirty_orders} WHERE o_totalprice = 'abc'
UNION ALL SELECT o_orderkey, 'o_totalprice', 'min', '''o_totalprice'' is below its min of 20000', o_totalprice
FROM {dirty_orders} WHERE TRY_CAST(o_totalprice AS DOUBLE) < 20000
UNION ALL SELECT o_orderkey, 'o_totalprice', 'max', '''o_totalprice'' is above its max of 300000', o_totalprice
FROM {dirty_orders} WHERE TRY_CAST(o_totalprice AS DOUBLE) > 300000
UNION ALL SELECT o_orderkey, 'o_custkey', 'type', '''o_custkey'' holds string where boolean is wanted', o_custkey
FROM {dirty_orders}""")
def validate_errors(t):
    return validation_errors(t.dirty_orders, ORDER_RULES, "o_orderkey")


@query("""
SELECT event_id AS row, 'value' AS column, 'required' AS rule, '''value'' is required but has no value' AS message,
  CAST(NULL AS VARCHAR) AS value FROM {dirty_events} WHERE value IS NULL
UNION ALL SELECT event_id, 'gone', 'required', '''gone'' is required but has no value', NULL FROM {dirty_events}""")
def validate_required(t):
    rules = {"value": {"required": True, "type": "number"}, "gone": {"required": True}}
    return validation_errors(t.dirty_events, rules, "event_id")


@query("""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, 'value' AS column, 'max' AS rule FROM events
QUALIFY value > 200""")
def validate_by_position(t):
    """Positions are assigned by the order of the key."""
    from sparkprep import with_row_id

    numbered = with_row_id(t.events, order_by="event_id")
    return validation_errors(numbered, {"value": {"type": "number", "max": 200}}).select("row", "column", "rule")


VALID = "TRY_CAST(o_totalprice AS DOUBLE) BETWEEN 20000 AND 300000"


@query(f"SELECT * FROM {{dirty_orders}} WHERE {VALID}")
def validate_accepted(t):
    return split_valid(t.dirty_orders, SPLIT_RULES)[0]


@query(f"""
SELECT o_orderkey, CAST(1 AS INTEGER) AS broken FROM {{dirty_orders}} WHERE ({VALID}) IS DISTINCT FROM true""")
def validate_rejected(t):
    rejected = split_valid(t.dirty_orders, SPLIT_RULES)[1]
    return rejected.select("o_orderkey", F.size("_errors").alias("broken"))


@query("""
SELECT count(*) AS rows, count(*) FILTER (WHERE p_retailprice < 0) = 0 AS all_valid,
  count(*) FILTER (WHERE p_size > 10) = 0 AS small_only FROM part""")
def validate_yes_no(t):
    return t.part.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(validate_schema(t.part, {"p_retailprice": {"type": "number", "min": 0}})).alias("all_valid"),
        F.lit(validate_schema(t.part, {"p_size": {"type": "number", "max": 10}})).alias("small_only"),
    )


@query("""
SELECT o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) IS NOT NULL AS price_ok,
  try_strptime(o_orderdate, '%m/%d/%Y') IS NOT NULL AS date_ok, false AS flag_ok FROM {dirty_orders}""")
def cell_types(t):
    orders = t.dirty_orders
    check = lambda c, kind: type_ok(F.col(c), orders.schema[c].dataType, kind)
    return orders.select(
        "o_orderkey",
        check("o_totalprice", "number").alias("price_ok"),
        check("o_orderdate", "datetime").alias("date_ok"),
        check("o_custkey", "boolean").alias("flag_ok"),
    )


@query("""
SELECT 'value' AS column, 'missing' AS issue, count(*) FILTER (WHERE value IS NULL) AS missing_count,
  round(100.0::DOUBLE * count(*) FILTER (WHERE value IS NULL) / count(*), 1)::DOUBLE AS percentage FROM {dirty_events}
UNION ALL SELECT 'sparse_col', 'missing', count(*) FILTER (WHERE sparse_col IS NULL),
  round(100.0::DOUBLE * count(*) FILTER (WHERE sparse_col IS NULL) / count(*), 1)::DOUBLE FROM {dirty_events}
UNION ALL SELECT 'nothing', 'missing', count(*), 100.0::DOUBLE FROM {dirty_events}
UNION ALL SELECT 'nothing', 'empty', count(*), 100.0::DOUBLE FROM {dirty_events}""")
def issues(t):
    return quality_issues(t.dirty_events.withColumn("nothing", F.lit(None).cast("string"))).drop("message")


def _cv(column: str) -> str:
    return f"""(SELECT CASE WHEN stddev_samp({column}) / abs(avg({column})) > 2 THEN 80.0
  WHEN stddev_samp({column}) / abs(avg({column})) > 1 THEN 90.0 ELSE 100.0 END FROM {{dirty_events}})"""


def _outlier_share(column: str) -> str:
    return f"""(SELECT 1.0::DOUBLE * count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) / count({column})
  FROM {{dirty_events}}, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {{dirty_events}}))"""


@query(f"""
WITH counts AS (SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS value_missing,
    count(*) FILTER (WHERE sparse_col IS NULL) AS sparse_missing, count(*) FILTER (WHERE value < 1) AS low FROM {{dirty_events}}),
parts AS (SELECT
    100.0::DOUBLE * (1 - (value_missing + sparse_missing)::DOUBLE / (6 * n)) AS completeness,
    100.0::DOUBLE - least(40, 100.0::DOUBLE * (value_missing + low) / n) AS validity,
    (100.0 + 100.0 + 75.0 + {_cv('event_id')} + {_cv('value')} + {_cv('sparse_col')} - 100.0 + {_cv('user_id')})::DOUBLE / 6 AS consistency,
    100.0::DOUBLE - least(30, 100.0::DOUBLE * ({_outlier_share('event_id')} + {_outlier_share('user_id')}
      + {_outlier_share('value')} + {_outlier_share('sparse_col')}) / 4) AS accuracy FROM counts)
SELECT round(0.3 * completeness + 0.3 * validity + 0.2 * consistency + 0.2 * accuracy, 2)::DOUBLE AS overall_score,
  round(completeness, 2)::DOUBLE AS completeness_score, round(validity, 2)::DOUBLE AS validity_score,
  round(consistency, 2)::DOUBLE AS consistency_score, round(accuracy, 2)::DOUBLE AS accuracy_score,
  CASE WHEN 0.3 * completeness + 0.3 * validity + 0.2 * consistency + 0.2 * accuracy >= 90 THEN 'A'
    WHEN 0.3 * completeness + 0.3 * validity + 0.2 * consistency + 0.2 * accuracy >= 80 THEN 'B'
    WHEN 0.3 * completeness + 0.3 * validity + 0.2 * consistency + 0.2 * accuracy >= 70 THEN 'C'
    WHEN 0.3 * completeness + 0.3 * validity + 0.2 * consistency + 0.2 * accuracy >= 60 THEN 'D' ELSE 'F' END AS grade
FROM parts""")
def quality(t):
    return quality_score(t.dirty_events, schema={"value": {"type": "number", "required": True, "min": 1}})


@query("""
SELECT round(100.0::DOUBLE - least(30, 100.0::DOUBLE * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {dup_lineitem}))) / count(*)), 2)::DOUBLE AS accuracy_score,
  100.0::DOUBLE AS completeness_score FROM {dup_lineitem}""")
def quality_of_duplicates(t):
    return quality_score(t.dup_lineitem).select("accuracy_score", "completeness_score")


@query("""
WITH e AS (SELECT count(*) AS errors FROM {dirty_orders} WHERE TRY_CAST(o_totalprice AS DOUBLE) IS NULL
    OR TRY_CAST(o_totalprice AS DOUBLE) NOT BETWEEN 20000 AND 300000),
r AS (SELECT count(*) AS rows FROM {dirty_orders}),
s AS (SELECT rows, errors, round(100 - 100.0::DOUBLE * errors / rows)::DOUBLE AS score FROM r, e)
SELECT rows, errors, greatest(0.0::DOUBLE, least(100.0::DOUBLE, score)) AS score,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' ELSE 'needs review' END AS band FROM s""")
def error_rate(t):
    orders = t.dirty_orders
    return error_rate_score(orders, validation_errors(orders, SPLIT_RULES, "o_orderkey"))
