"""Duplicates and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import count_duplicates, flag_outliers, outlier_report, remove_duplicates, remove_outliers
from sparkprep.functions.parsing import WHITESPACE

from .registry import query


@query("SELECT DISTINCT * FROM {dup_lineitem}")
def dedupe_exact(t):
    return remove_duplicates(t.dup_lineitem, "exact")


@query("SELECT DISTINCT * FROM {dup_lineitem}")
def dedupe_auto_exact(t):
    """There are exact duplicates, so the normalised comparison is not made."""
    return remove_duplicates(t.dup_lineitem, "auto")


# The upper-case spelling with a leading blank sorts before the original one.
FIRST_CUSTOMER = """
SELECT c_name, c_mktsegment, c_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(c_name)), lower(trim(c_mktsegment)), c_nationkey
    ORDER BY c_name, c_mktsegment, c_nationkey) AS rn FROM {near_dup_customers}) WHERE rn = 1"""


@query(FIRST_CUSTOMER)
def dedupe_normalized(t):
    return remove_duplicates(t.near_dup_customers, "normalized")


@query(FIRST_CUSTOMER)
def dedupe_auto_normalized(t):
    """There is no exact duplicate, so spellings are compared."""
    return remove_duplicates(t.near_dup_customers, "auto")


@query(f"""
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(text, '{WHITESPACE}')) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedupe_documents(t):
    """Whole texts as keys, the first document of each spelling kept."""
    kept = remove_duplicates(t.documents, "normalized", subset=["text"], order_by="doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars")


@query("""
SELECT o_orderkey, o_custkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_subset(t):
    """The first order of every customer."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return remove_duplicates(orders, "exact", subset=["o_custkey"], order_by=["o_orderdate", "o_orderkey"])


@query("""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {dup_lineitem})) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {dup_lineitem})) AS duplicate_rows FROM {dup_lineitem}""")
def duplicate_count(t):
    return count_duplicates(t.dup_lineitem)


@query("""
SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicate_rows FROM documents""")
def duplicate_texts(t):
    return count_duplicates(t.documents, ["text"])


def _step(number: int, source: str, column: str) -> str:
    """One link of the outlier chain: the bounds of a column on what the links before have kept."""
    return f"""b{number} AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}),
s{number} AS (SELECT s.* FROM {source} s, b{number} WHERE {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query(f"WITH {_step(1, 'events', 'event_id')}, {_step(2, 's1', 'user_id')}, {_step(3, 's2', 'value')} SELECT * FROM s3")
def outliers_iqr(t):
    """All numeric columns, one after the other."""
    return remove_outliers(t.events)


@query(
    "WITH d AS (SELECT * FROM {dirty_lineitem}), "
    + f"{_step(1, 'd', 'l_discount')}, {_step(2, 's1', 'l_quantity')}, {_step(3, 's2', 'l_extendedprice')} SELECT * FROM s3"
)
def outliers_iqr_with_gaps(t):
    """Rows that miss a processed value are removed as well."""
    return remove_outliers(t.dirty_lineitem, ["l_discount", "l_quantity", "l_extendedprice"])


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
  quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM {dirty_events})
SELECT event_id FROM {dirty_events}, b
WHERE (value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
  AND user_id BETWEEN u1 - 1.5 * (u3 - u1) AND u3 + 1.5 * (u3 - u1)""")
def outliers_iqr_one_pass(t):
    """All bounds from the full table; missing values stay."""
    kept = remove_outliers(t.dirty_events, ["value", "user_id"], sequential=False, drop_nulls=False)
    return kept.select("event_id")


@query("""
WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT events.* FROM events, b WHERE value BETWEEN m - 3 * s AND m + 3 * s""")
def outliers_zscore(t):
    return remove_outliers(t.events, ["value"], method="zscore")


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {dirty_events})
SELECT event_id, value, coalesce(value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false) AS value_outlier
FROM {dirty_events}, b""")
def outliers_flagged(t):
    return flag_outliers(t.dirty_events, ["value"]).select("event_id", "value", "value_outlier")


def _share(column: str) -> str:
    return f"""SELECT '{column}' AS column, count({column}) AS values, round(any_value(lower), 4)::DOUBLE AS lower,
  round(any_value(upper), 4)::DOUBLE AS upper, count(*) FILTER (WHERE {column} < lower OR {column} > upper) AS outliers,
  round(count(*) FILTER (WHERE {column} < lower OR {column} > upper)::DOUBLE / count({column}), 8)::DOUBLE AS outlier_ratio
FROM {{dirty_events}}, (SELECT quantile_cont({column}, 0.25) - 1.5 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS lower,
  quantile_cont({column}, 0.75) + 1.5 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS upper FROM {{dirty_events}})"""


@query(" UNION ALL ".join(_share(c) for c in ("event_id", "user_id", "value", "sparse_col")))
def outlier_shares(t):
    found = outlier_report(t.dirty_events)
    return found.select(
        "column", "values", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
        "outliers", F.round("outlier_ratio", 8).alias("outlier_ratio"),
    )
