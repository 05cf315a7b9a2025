"""Dirty tables derived from the given ones, in SQL that Spark and DuckDB both take.

The given tables have no missing cells and no exact duplicates; these projections add both, depending
only on the rows' own values.
"""

from __future__ import annotations

import re

INPUTS = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    # missing values, a null token, padding and upper case, one column that is mostly missing
    "dirty_events": """
        SELECT event_id, ts, user_id,
          CASE WHEN event_type = 'error' AND minute(ts) < 30 THEN 'N/A'
               WHEN event_type = 'click' THEN concat('  ', upper(event_type), ' ')
               ELSE event_type END AS event_type,
          CASE WHEN minute(ts) < 8 THEN NULL ELSE value END AS value,
          CASE WHEN hour(ts) < 14 THEN NULL ELSE user_id END AS sparse_col
        FROM {events}""",
    # NaN where half of the missing values of dirty_events are
    "nan_events": """
        SELECT event_id, ts, user_id, event_type,
          CASE WHEN minute(ts) < 4 THEN NULL WHEN minute(ts) < 8 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
          CASE WHEN hour(ts) < 14 THEN NULL ELSE user_id END AS sparse_col
        FROM {events}""",
    # all text, US dates, bad numbers, a null token
    "dirty_orders": """
        SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey,
          CASE WHEN day(o_orderdate) = 13 THEN 'abc'
               ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) END AS o_totalprice,
          concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/',
                 lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
                 CAST(year(o_orderdate) AS STRING)) AS o_orderdate,
          CASE WHEN month(o_orderdate) = 2 THEN 'null' ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # missing quantities, discounts out of range
    "dirty_lineitem": """
        SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag,
          CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
          CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN l_discount * 100 ELSE l_discount END
            AS l_discount
        FROM {lineitem}""",
    # dates, prices and priorities missing here and there, one key
    "gappy_orders": """
        SELECT o_orderkey, CASE WHEN month(o_orderdate) = 3 THEN NULL ELSE o_orderdate END AS o_orderdate,
          CASE WHEN day(o_orderdate) = 13 THEN NULL ELSE o_totalprice END AS o_totalprice,
          CASE WHEN day(o_orderdate) = 20 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # few distinct rows
    "dup_lineitem": "SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
    # every customer twice, the second time in another spelling
    "near_dup_customers": """
        SELECT c_name, c_mktsegment, c_nationkey FROM {customer}
        UNION ALL
        SELECT concat(' ', upper(c_name), '  ') AS c_name, lower(c_mktsegment) AS c_mktsegment, c_nationkey
        FROM {customer}""",
    # a boolean, rows with several missing columns
    "flagged_lineitem": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_quantity > 25 AS is_bulk,
          CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_shipdate END AS l_shipdate,
          CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END AS l_tax
        FROM {lineitem}""",
}


def expand(sql: str) -> str:
    """Replace ``{view}`` by the view's text as a subquery over the tables."""
    def text(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return "(" + re.sub(r"\{(\w+)\}", text, VIEWS[name]) + ")"
        return name

    return re.sub(r"\{([a-z_]+)\}", text, sql)
