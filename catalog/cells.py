"""Names, cells, types, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep import (
    apply_types,
    coerce_numeric,
    conversion_errors,
    detect_column_types,
    drop_empty_rows,
    enforce_types,
    fit_types,
    normalize_nulls,
    normalize_types,
    standardize_columns,
    trim_cells,
    validate_ranges,
    with_row_id,
)
from sparkprep.functions import parse_bool, parse_datetime, parse_number

from .registry import query


@query("""
SELECT c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS customer_name_1, c_acctbal AS column
FROM customer""")
def standardize_names(t):
    odd = t.customer.select(
        F.col("c_custkey").alias(" Customer@Key "),
        F.col("c_name").alias("customer__name"),
        F.col("c_mktsegment").alias("Customer Name!"),
        F.col("c_acctbal").alias("##"),
    )
    return standardize_columns(odd)


@query("""
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _row_id, o_orderkey FROM orders""")
def row_ids(t):
    return with_row_id(t.orders.select("o_orderkey", "o_orderdate"), order_by=["o_orderdate", "o_orderkey"]).select(
        "_row_id", "o_orderkey"
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('', ' ', 'null', 'none', 'nan', 'na', 'n/a', 'N/A', 'undefined')
  THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {dirty_orders}""")
def null_tokens(t):
    return normalize_nulls(t.dirty_orders.select("o_orderkey", "o_orderpriority"))


@query("""
SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('', 'none', 'null', 'nan', 'na', 'n/a', 'undefined')
  THEN NULL ELSE event_type END AS event_type FROM {dirty_events}""")
def null_tokens_any_case(t):
    return normalize_nulls(
        t.dirty_events.select("event_id", "event_type"),
        ["", "none", "null", "nan", "na", "n/a", "undefined"],
        trim=True,
        ignore_case=True,
    )


@query("SELECT event_id, trim(event_type) AS event_type FROM {dirty_events}")
def trimmed_cells(t):
    return trim_cells(t.dirty_events.select("event_id", "event_type"))


@query("SELECT value, sparse_col FROM {dirty_events} WHERE value IS NOT NULL OR sparse_col IS NOT NULL")
def without_empty_rows(t):
    return drop_empty_rows(t.dirty_events.select("value", "sparse_col"))


TYPED_ORDERS = """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
  {number} AS o_totalprice, try_strptime(o_orderdate, '%m/%d/%Y') AS o_orderdate,
  nullif(o_orderpriority, 'null') AS o_orderpriority FROM {{dirty_orders}}"""


@query(TYPED_ORDERS.format(number="TRY_CAST(o_totalprice AS DOUBLE)"))
def infer_types(t):
    """Shares of all rows decide; a numeric column with gaps is a double."""
    return normalize_types(t.dirty_orders)


@query(TYPED_ORDERS.format(number="TRY_CAST(o_totalprice AS BIGINT)"))
def infer_and_enforce_types(t):
    """Normalisation and enforcement from one aggregate: whole numbers become longs."""
    return apply_types(t.dirty_orders, fit_types(t.dirty_orders))


@query("""
SELECT 'o_orderkey' AS column, 'int' AS type, count(*) AS rows FROM orders
UNION ALL SELECT 'o_custkey', 'int', count(*) FROM orders
UNION ALL SELECT 'o_totalprice', CASE WHEN count(TRY_CAST(o_totalprice AS DOUBLE)) >= 0.8 * count(o_totalprice)
  THEN 'int' ELSE 'string' END, count(*) FROM {dirty_orders}
UNION ALL SELECT 'o_orderdate', CASE WHEN count(try_strptime(o_orderdate, '%m/%d/%Y')) >= 0.8 * count(o_orderdate)
  THEN 'datetime' ELSE 'string' END, count(*) FROM {dirty_orders}
UNION ALL SELECT 'o_orderpriority', 'string', count(*) FROM orders""")
def detect_types(t):
    found = detect_column_types(t.dirty_orders)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type")) for c, k in found.items()])
    return t.dirty_orders.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(pairs), "rows")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(l_quantity AS BIGINT) AS l_quantity, l_shipdate FROM lineitem""")
def enforce_given_types(t):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"), "l_shipdate"
    )
    typed, _ = enforce_types(
        lines, {"l_orderkey": "string", "l_linenumber": "number", "l_quantity": "int"}, auto_detect=False
    )
    return typed.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query("""
SELECT 'l_discount' AS column, 'double' AS original, 'int' AS target, CAST(NULL AS VARCHAR) AS final,
  count(*) FILTER (WHERE l_discount <> floor(l_discount)) > 0 AS failed FROM lineitem
UNION ALL SELECT 'no_such_column', NULL, 'int', NULL, true
UNION ALL SELECT 'l_quantity', 'double', 'int', 'bigint', false""")
def enforcement_report(t):
    """Fractions cannot become int, and an unknown column is an error; the rest goes on."""
    lines = t.lineitem.select("l_quantity", "l_discount")
    _, report = enforce_types(
        lines, {"l_quantity": "int", "l_discount": "int", "no_such_column": "int"}, auto_detect=False
    )
    return report.select("column", "original", "target", "final", F.col("error").isNotNull().alias("failed"))


@query("SELECT o_orderkey, try_strptime(o_orderdate, '%m/%d/%Y') AS day FROM {dirty_orders}")
def parse_dates(t):
    return t.dirty_orders.select("o_orderkey", parse_datetime(F.col("o_orderdate"), "%m/%d/%Y").alias("day"))


@query("""
SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS brand_number,
  TRY_CAST(p_name AS DOUBLE) AS name_number,
  CASE WHEN p_size % 2 = 0 THEN true ELSE false END AS even FROM part""")
def parse_cells(t):
    """Numbers and booleans from text."""
    return t.part.select(
        "p_partkey",
        parse_number(F.regexp_extract("p_brand", "[0-9]+", 0)).alias("brand_number"),
        parse_number(F.col("p_name")).alias("name_number"),
        parse_bool(F.when(F.col("p_size") % 2 == 0, " YES ").otherwise("n"), True).alias("even"),
    )


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice,
  o_orderdate, o_orderpriority FROM {dirty_orders}""")
def numeric_text(t):
    """Text columns become numbers only when every cell is one."""
    return coerce_numeric(t.dirty_orders)


@query("SELECT o_orderkey AS row, 'o_totalprice' AS column, o_totalprice AS value, 'int' AS target FROM {dirty_orders} WHERE o_totalprice = 'abc'")
def lost_cells(t):
    orders = t.dirty_orders
    return conversion_errors(orders, fit_types(orders), "o_orderkey")


RULES = {"l_discount": {"min": 0.01, "max": 0.09}, "l_quantity": {"max": 45}}


def _rules(action: str):
    return {column: {**rule, "action": action} for column, rule in RULES.items()}


@query("""
SELECT 'l_discount' AS column, 'min' AS rule, 0.01::DOUBLE AS expected, count(*) AS violations_count FROM {dirty_lineitem} WHERE l_discount < 0.01
UNION ALL SELECT 'l_discount', 'max', 0.09::DOUBLE, count(*) FROM {dirty_lineitem} WHERE l_discount > 0.09
UNION ALL SELECT 'l_quantity', 'max', 45::DOUBLE, count(*) FROM {dirty_lineitem} WHERE l_quantity > 45""")
def range_flag(t):
    return validate_ranges(t.dirty_lineitem, _rules("flag"))[1]


@query("""
SELECT * FROM {dirty_lineitem} WHERE (l_discount IS NULL OR l_discount BETWEEN 0.01 AND 0.09)
  AND (l_quantity IS NULL OR l_quantity <= 45)""")
def range_drop(t):
    return validate_ranges(t.dirty_lineitem, _rules("drop"))[0]


@query("""
SELECT 'l_discount' AS column, 'min' AS rule, 0.01::DOUBLE AS expected, count(*) AS violations_count FROM {dirty_lineitem} WHERE l_discount < 0.01
UNION ALL SELECT 'l_discount', 'max', 0.09::DOUBLE, count(*) FROM {dirty_lineitem} WHERE l_discount > 0.09
UNION ALL SELECT 'l_quantity', 'max', 45::DOUBLE, count(*) FROM {dirty_lineitem} WHERE l_quantity > 45 AND l_discount BETWEEN 0.01 AND 0.09""")
def range_drop_counts(t):
    """Later rules count only rows that earlier rules have kept."""
    return validate_ranges(t.dirty_lineitem, _rules("drop"))[1]


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag,
  CASE WHEN l_quantity > 45 THEN 45.0::DOUBLE ELSE l_quantity END AS l_quantity,
  CASE WHEN l_discount < 0.01 THEN 0.01::DOUBLE WHEN l_discount > 0.09 THEN 0.09::DOUBLE ELSE l_discount END AS l_discount
FROM {dirty_lineitem}""")
def range_clip(t):
    return validate_ranges(t.dirty_lineitem, _rules("clip"))[0]


def _spread_orders(t):
    """Keys and dates dealt to all cores: a few columns of a file make few splits, of which each is long work here."""
    return t.orders.select("o_orderkey", "o_orderdate").repartition(4 * t.spark.sparkContext.defaultParallelism, "o_orderkey")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS named, CAST(o_orderdate AS TIMESTAMP) AS long_name,
  CAST(o_orderdate AS TIMESTAMP) AS dashed, CAST(o_orderdate AS TIMESTAMP) AS dotted,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 1 MINUTE * (o_orderkey % 60) AS half,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 24 - 2) AS offset_time FROM orders""")
def infer_date_layouts(t):
    """Month names, dashes and points with the day first, AM and PM, and offsets, each found for its column."""
    day, key = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey")
    clock = day + F.make_dt_interval(F.lit(0), (key % 24).cast("int"), (key % 60).cast("int"))
    hour = day + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
    orders = _spread_orders(t).select(
        "o_orderkey", F.date_format(day, "d MMM yyyy").alias("named"), F.date_format(day, "MMMM d, yyyy").alias("long_name"),
        F.date_format(day, "dd-MM-yyyy").alias("dashed"), F.date_format(day, "dd.MM.yyyy").alias("dotted"),
        F.date_format(clock, "MM/dd/yyyy h:mm a").alias("half"),
        F.concat(F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("offset_time"),
    )
    return normalize_types(orders)


# Layouts of one date and what is left of it: the day, the month, or the moment. The moment is made from the key.
RENDERINGS = [
    ("MM/dd/yyyy", "day"), ("dd/MM/yyyy", "day"), ("yyyy/MM/dd", "day"), ("yyyy.MM.dd", "day"), ("M/d/yy", "day"), ("dd/MM/yy", "day"),
    ("MM-dd-yy", "day"), ("dd-MM-yy", "day"), ("d-MMM-yy", "day"), ("dd.MM.yyyy", "day"), ("EEEE, MMMM d, yyyy", "day"),
    ("EEE d MMM yyyy", "day"), ("MMM yyyy", "month"), ("MMMM, yyyy", "month"), ("yyyy-MM", "month"), ("yyyy/MM", "month"),
    ("M/yyyy", "month"), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "moment"), ("dd/MM/yyyy HH:mm:ss", "moment"),
    ("yyyy/MM/dd HH:mm", "moment"), ("dd.MM.yyyy HH:mm", "moment"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "moment"),
]
LEFT_OF_DATES = {
    "day": "CAST(o_orderdate AS TIMESTAMP)",
    "month": "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)",
    "moment": "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 1 MINUTE * (o_orderkey % 60)",
}


@query("SELECT o_orderkey, " + ", ".join(f"{LEFT_OF_DATES[left]} AS r{i}" for i, (_, left) in enumerate(RENDERINGS)) + " FROM orders")
def infer_date_renderings(t):
    """Twenty-two layouts, each found for its column: years of two digits, names of days, months alone, times."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    moment = day + F.make_dt_interval(F.lit(0), (key % 24).cast("int"), (key % 60).cast("int"))
    rendered = [F.date_format(moment, layout).alias(f"r{i}") for i, (layout, _) in enumerate(RENDERINGS)]
    return normalize_types(_spread_orders(t).select("o_orderkey", *rendered))
