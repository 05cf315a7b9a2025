"""Profile tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparkprep import (
    compare_profiles,
    correlations,
    histogram,
    interactions,
    missing_patterns,
    normalize_types,
    preview,
    profile_alerts,
    profile_columns,
    profile_dates,
    profile_numeric,
    profile_overview,
    profile_text,
    top_values,
)

from .registry import query


def _counts(view: str, columns: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{dtype}' AS dtype, '{kind}' AS kind, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
  round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6)::DOUBLE AS missing_percentage FROM {{{view}}}"""
        for c, (dtype, kind) in columns.items()
    )


@query(_counts("dirty_events", {
    "event_id": ("bigint", "numeric"), "ts": ("timestamp_ntz", "datetime"), "user_id": ("bigint", "numeric"),
    "event_type": ("string", "text"), "value": ("double", "numeric"), "sparse_col": ("bigint", "numeric"),
}))
def profile_summary(t):
    found = profile_columns(t.dirty_events)
    return found.withColumn("missing_percentage", F.round("missing_percentage", 6))


@query("""
SELECT n AS total_rows, CAST(6 AS INTEGER) AS total_columns, 6 * n AS total_cells, CAST(4 AS INTEGER) AS numeric_columns,
  CAST(1 AS INTEGER) AS text_columns, missing AS missing_cells,
  round(100.0::DOUBLE * missing / (6 * n), 6)::DOUBLE AS missing_cells_percentage, 0::BIGINT AS duplicate_rows,
  0::DOUBLE AS duplicate_percentage
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE sparse_col IS NULL) AS missing FROM {dirty_events})""")
def profile_table(t):
    found = profile_overview(t.dirty_events)
    return found.withColumn("missing_cells_percentage", F.round("missing_cells_percentage", 6))


def _numeric(view: str, c: str) -> str:
    r = lambda e: f"round({e}, 4)::DOUBLE"
    return f"""SELECT '{c}' AS column, count({c}) AS values, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct,
  count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives,
  {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'var_samp({c})')} AS variance,
  min({c})::DOUBLE AS min, {r(f'quantile_cont({c}, 0.05)')} AS q05, {r(f'quantile_cont({c}, 0.25)')} AS q25,
  {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'quantile_cont({c}, 0.95)')} AS q95,
  max({c})::DOUBLE AS max, {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr,
  {r(f'stddev_samp({c}) / avg({c})')} AS cv, {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis,
  {r(f'mad({c}::DOUBLE)')} AS mad, {r(f'sum({c})')} AS sum FROM {view}"""


@query(" UNION ALL ".join(
    [_numeric("(SELECT l_linenumber, l_quantity, l_extendedprice, l_discount FROM {dirty_lineitem})", c)
     for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]
))
def profile_numbers(t):
    lines = t.dirty_lineitem.select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    found = profile_numeric(lines)
    return found.select(
        *[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes]
    )


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS values, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct,
  count(*) FILTER (WHERE {c} = '') AS empty, CAST(min(length({c})) AS INTEGER) AS min_length,
  round(avg(length({c})), 6)::DOUBLE AS mean_length, CAST(max(length({c})) AS INTEGER) AS max_length FROM documents"""
    for c in ("text", "lang", "source")
))
def profile_texts(t):
    found = profile_text(t.documents)
    return found.withColumn("mean_length", F.round("mean_length", 6))


@query("""
SELECT 'l_shipdate' AS column, count(l_shipdate) AS values, count(*) - count(l_shipdate) AS missing,
  min(l_shipdate) AS earliest, max(l_shipdate) AS latest,
  epoch(max(l_shipdate))::DOUBLE - epoch(min(l_shipdate))::DOUBLE AS range_seconds FROM {flagged_lineitem}""")
def profile_days(t):
    return profile_dates(t.flagged_lineitem)


def _histogram(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS column, CAST(b AS INTEGER) AS bin, round(lo + b * w, 6)::DOUBLE AS lower, round(lo + (b + 1) * w, 6)::DOUBLE AS upper,
  (SELECT count(*) FROM {table} WHERE least(floor(({c} - lo) / w), 9) = b) AS count
FROM (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 10 AS w FROM {table}), range(10) r(b)"""


@query(" UNION ALL ".join([_histogram("orders", "o_totalprice"), _histogram("orders", "o_custkey")]))
def profile_histogram(t):
    found = histogram(t.orders, ["o_totalprice", "o_custkey"])
    return found.select(
        "column", "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count"
    )


def _top(view: str, c: str, k: int) -> str:
    return f"""SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {view}), 6)::DOUBLE AS percentage
FROM {view} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= {k}"""


@query(" UNION ALL ".join(_top("{dirty_events}", c, 3) for c in ("event_type", "user_id", "sparse_col")))
def profile_frequent(t):
    found = top_values(t.dirty_events, ["event_type", "user_id", "sparse_col"], 3)
    return found.withColumn("percentage", F.round("percentage", 6))


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6)::DOUBLE AS correlation FROM {{dirty_lineitem}}"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
))
def profile_correlation(t):
    found = correlations(t.dirty_lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return found.withColumn("correlation", F.round("correlation", 6))


# Sixty columns made from a row, each with other gaps; the last one is constant.
WIDE = {
    f"c{i}": f"CASE WHEN (l_partkey + {i}) % {i + 3} <> 0 THEN CAST(l_quantity * {i % 5} + l_extendedprice * {i % 3} "
    f"+ (l_orderkey * {i + 1}) % {11 + i} * 100 + 1 AS DOUBLE) END"
    for i in range(59)
} | {"c59": "CAST(0.1 AS DOUBLE)"}
_WIDE_PAIRS = ", ".join(
    f"{{'column_a': '{a}', 'column_b': '{b}', 'correlation': "
    + ("NULL::DOUBLE" if b == "c59" else f"round(corr({a}, {b}), 6)::DOUBLE") + "}"
    for a, b in combinations(WIDE, 2)
)


@query(
    f"SELECT r.column_a, r.column_b, r.correlation FROM (SELECT unnest([{_WIDE_PAIRS}]) AS r FROM (SELECT "
    + ", ".join(f"{text} AS {name}" for name, text in WIDE.items()) + " FROM lineitem))"
)
def profile_correlation_wide(t):
    """1,770 pairs, each over the rows where both columns are known, in one pass of matrix products."""
    found = correlations(t.lineitem.select(*[F.expr(text).alias(name) for name, text in WIDE.items()]))
    return found.withColumn("correlation", F.round("correlation", 6))


@query("""
SELECT * FROM (
  SELECT 'event_id' AS column, 'unique' AS alert, count(*)::DOUBLE AS value, true AS raised FROM {dirty_events}
  UNION ALL SELECT 'kind', 'constant', 1.0, true
  UNION ALL SELECT 'sparse_col', 'high_missing', round(100.0::DOUBLE * count(*) FILTER (WHERE sparse_col IS NULL) / count(*), 6),
    100.0::DOUBLE * count(*) FILTER (WHERE sparse_col IS NULL) / count(*) > 50 FROM {dirty_events}
  UNION ALL SELECT 'is_late', 'zeros', round(100.0::DOUBLE * count(*) FILTER (WHERE hour(ts) < 20) / count(*), 6), true FROM {dirty_events}
  UNION ALL SELECT 'user_id,user_id_2', 'high_correlation', 1.0, true
  UNION ALL SELECT 'user_id,sparse_col', 'high_correlation', 1.0, true
  UNION ALL SELECT 'user_id_2,sparse_col', 'high_correlation', 1.0, true
  UNION ALL SELECT 'text_id', 'high_cardinality', count(DISTINCT user_id)::DOUBLE, count(DISTINCT user_id) > 50 FROM {dirty_events}
) WHERE raised""")
def profile_warnings(t):
    events = t.dirty_events.select(
        "event_id",
        F.lit("event").alias("kind"),
        "user_id",
        (F.col("user_id") * 2 + 1).alias("user_id_2"),
        "sparse_col",
        F.when(F.hour("ts") < 20, 0).otherwise(1).alias("is_late"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("text_id"),
    )
    found = profile_alerts(events)
    return found.select("column", "alert", F.round("value", 6).alias("value"), F.lit(True).alias("raised"))


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column, 'string' AS type_before, '{after}' AS type_after, count(*) AS rows_before, count(*) AS rows_after,
  count(*) FILTER (WHERE {c} IS NULL) AS missing_before, count(*) FILTER (WHERE {test}) AS missing_after FROM {{dirty_orders}}"""
    for c, after, test in (
        ("o_orderkey", "bigint", "false"),
        ("o_custkey", "bigint", "false"),
        ("o_totalprice", "double", "o_totalprice = 'abc'"),
        ("o_orderdate", "timestamp_ntz", "false"),
        ("o_orderpriority", "string", "o_orderpriority = 'null'"),
    )
))
def profile_compare(t):
    return compare_profiles(t.dirty_orders, normalize_types(t.dirty_orders))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_rows(t):
    return preview(t.orders, 20, "o_orderkey")[0]


@query("SELECT least(count(*), 20) AS shown, count(*) AS total FROM orders")
def preview_totals(t):
    return preview(t.orders, 20)[1]


@query("""
SELECT concat_ws(',', CASE WHEN l_shipdate IS NULL THEN 'l_shipdate' END, CASE WHEN l_tax IS NULL THEN 'l_tax' END) AS missing_columns,
  count(*) AS rows FROM {flagged_lineitem} GROUP BY 1""")
def profile_missing_patterns(t):
    return missing_patterns(t.flagged_lineitem)


@query("""
WITH e AS (SELECT min(l_quantity) AS ql, (max(l_quantity) - min(l_quantity)) / 5 AS qw, min(l_extendedprice) AS pl,
  (max(l_extendedprice) - min(l_extendedprice)) / 5 AS pw FROM {dirty_lineitem})
SELECT CAST(least(floor((l_quantity - ql) / qw), 4) AS INTEGER) AS x_bin,
  CAST(least(floor((l_extendedprice - pl) / pw), 4) AS INTEGER) AS y_bin, count(*) AS count
FROM {dirty_lineitem}, e WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2""")
def profile_interactions(t):
    return interactions(t.dirty_lineitem, "l_quantity", "l_extendedprice", 5)
