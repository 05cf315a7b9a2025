"""Filters."""

from __future__ import annotations

from sparkprep import apply_filters, compile_filters, filter_by_date_range

from .registry import query


@query("SELECT * FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 200000.5 AND o_custkey >= 100 AND o_custkey < 900")
def filter_numeric_ops(t):
    spec = {
        "o_totalprice": [{"op": ">", "value": "50000"}, {"op": "<=", "value": 200000.5}],
        "o_custkey": [{"op": ">=", "value": "99.5"}, {"op": "<", "value": 900}],
    }
    return apply_filters(t.orders, spec)


@query("SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_between(t):
    return apply_filters(t.lineitem, {"l_quantity": {"op": "between", "min": "10", "max": 20}})


@query("SELECT * FROM lineitem WHERE l_linenumber = 4")
def filter_equals(t):
    return apply_filters(t.lineitem, {"linenumber": {"op": "equals", "value": " 4 "}})


@query("SELECT * FROM part WHERE p_size <> 7")
def filter_numeric_not_equals(t):
    return apply_filters(t.part, {"p_size": {"op": "!=", "value": 7}})


@query("SELECT * FROM part WHERE p_size NOT IN (1, 2, 3)")
def filter_numeric_not_in(t):
    return apply_filters(t.part, {"p_size": {"op": "not_in", "value": [1, "2", 3.0]}})


@query("SELECT * FROM part WHERE p_size > 20")
def filter_bad_operand(t):
    """A comparison with something that is no number is ignored."""
    return apply_filters(t.part, {"p_retailprice": {"op": ">", "value": "abc"}, "p_size": 
                                  {"op": ">", "value": 20}})


@query("SELECT * FROM part WHERE false")
def filter_bad_equality(t):
    """An equality with something that is no number finds nothing."""
    return apply_filters(t.part, {"p_size": {"op": "equals", "value": "abc"}})


@query("SELECT * FROM customer WHERE lower(trim(c_mktsegment)) = 'machinery'")
def filter_text_equals(t):
    return apply_filters(t.customer, {"c_mktsegment": {"op": "equals", "value": "Machinery"}})


@query("SELECT * FROM customer WHERE lower(trim(c_mktsegment)) <> 'machinery'")
def filter_text_not_equals(t):
    return apply_filters(t.customer, {"c_mktsegment": {"op": "!=", "value": "MACHINERY"}})


@query("SELECT * FROM part WHERE contains(lower(p_name), 'widget')")
def filter_text_contains(t):
    return apply_filters(t.part, {"p_name": {"op": "contains", "value": "WIDGET"}})


@query("SELECT * FROM part WHERE regexp_matches(lower(p_name), '^(red|blue) ')")
def filter_text_regex(t):
    return apply_filters(t.part, {"p_name": {"op": "contains", "value": "^(red|blue) ", "regex": True}})


@query("SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1')")
def filter_text_starts_with(t):
    return apply_filters(t.part, {"p_brand": {"op": "starts_with", "value": "Brand#1"}})


@query("SELECT * FROM part WHERE starts_with(lower(p_brand), 'brand#1')")
def filter_text_starts_with_any_case(t):
    return apply_filters(t.part, {"p_brand": {"op": "starts_with", "value": "BRAND#1"}}, ignore_case=True)


@query("SELECT * FROM part WHERE ends_with(p_name, 'ring')")
def filter_text_ends_with(t):
    return apply_filters(t.part, {"p_name": {"op": "ends_with", "value": "ring"}})


@query("SELECT * FROM part WHERE lower(trim(p_type)) IN ('economy', 'small')")
def filter_text_in(t):
    return apply_filters(t.part, {"p_type": {"op": "in", "value": "Economy,SMALL"}})


@query("SELECT * FROM part WHERE lower(trim(p_type)) NOT IN ('economy', 'small')")
def filter_text_not_in(t):
    return apply_filters(t.part, {"p_type": {"op": "not_in", "value": ["Economy", "SMALL"]}})


@query("SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
def filter_date_range(t):
    return apply_filters(t.orders, {"o_orderdate": {"op": "range", "start": "1996-01-01", "end": "06/30/1997"}})


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def filter_date_open(t):
    return apply_filters(t.orders, {"o_orderdate": {"op": "range", "start": "1997-01-01", "end": ""}})


@query("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def filter_date_compare(t):
    spec = {"o_orderdate": [{"op": ">", "value": "1995-03-01"}, {"op": "<", "value": "1998-01-01T00:00:00Z"}]}
    return apply_filters(t.orders, spec)


@query("SELECT * FROM lineitem WHERE l_shipdate = TIMESTAMP '1997-05-05'")
def filter_date_equals(t):
    return apply_filters(t.lineitem, {"l_shipdate": {"op": "equals", "value": "1997/05/05"}})


@query("SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05 12:00:00'")
def filter_first_date_column(t):
    return filter_by_date_range(t.events, "2024-01-02", "2024-01-05 12:00:00")


@query("SELECT * FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 9000")
def filter_first_numeric_column(t):
    return apply_filters(t.lineitem, {"_numericRange": {"op": "between", "min": 1000, "max": "9000"}})


@query("SELECT * FROM {flagged_lineitem} WHERE is_bulk = false")
def filter_boolean(t):
    return apply_filters(t.flagged_lineitem, {"is_bulk": {"op": "equals", "value": "false"}})


@query("""
SELECT * FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), '17') OR contains(lower(p_name), '17')
  OR contains(lower(p_brand), '17') OR contains(lower(p_type), '17') OR contains(CAST(p_size AS VARCHAR), '17')
  OR contains(CAST(p_retailprice AS VARCHAR), '17')""")
def filter_text_search(t):
    return apply_filters(t.part, {"_textSearch": {"op": "contains", "value": "17 "}})


@query("SELECT * FROM documents WHERE contains(lower(text), 'the ') AND n_chars > 200 AND lower(trim(lang)) = 'en'")
def filter_documents(t):
    spec = {
        "text": {"op": "contains", "value": "The "},
        "n_chars": {"op": ">", "value": 200},
        "lang": "EN",
    }
    return apply_filters(t.documents, spec)


@query("""
SELECT * FROM orders WHERE o_totalprice >= 100000 AND contains(lower(o_orderpriority), 'high')
  AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def filter_list_form(t):
    """The list form with long operator names."""
    spec = [
        {"column": "o_totalprice", "operator": "greater_than_or_equal", "value": 100000},
        {"column": "O_ORDERPRIORITY", "op": "contains", "value": "high"},
        {"column": "o_orderdate", "op": "range", "start": "1995-01-01"},
        {"column": "no_such_column", "op": ">", "value": 1},
        {"column": "o_custkey", "op": "sounds_like", "value": 1},
    ]
    return apply_filters(t.orders, spec)


@query("""
SELECT * FROM {dirty_orders} WHERE TRY_CAST(o_totalprice AS DOUBLE) BETWEEN 50000 AND 150000
  AND try_strptime(o_orderdate, '%m/%d/%Y') >= TIMESTAMP '1996-01-01' AND lower(trim(o_orderpriority)) <> 'null'""")
def filter_text_content(t):
    """Text columns whose content is numbers or dates are compared as such."""
    spec = {
        "o_totalprice": {"op": "between", "min": 50000, "max": 150000},
        "o_orderdate": {"op": "range", "start": "1996-01-01"},
        "o_orderpriority": {"op": "!=", "value": "NULL"},
    }
    return apply_filters(t.dirty_orders, spec)


@query("""
SELECT * FROM {dirty_events} WHERE contains(lower(CAST(event_id AS VARCHAR) || '|' || CAST(ts AS VARCHAR) || '|' ||
  CAST(user_id AS VARCHAR) || '|' || event_type), 'click') AND value BETWEEN 5 AND 80
  AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20'""")
def filter_multi(t):
    """Search, date range and a column rule together; missing values never match."""
    spec = {
        "value": {"op": "between", "min": 5, "max": 80},
        "_dateRange": {"op": "between", "start": "2024-01-01", "end": "2024-01-20"},
        "_textSearch": {"op": "contains", "value": "click"},
    }
    return apply_filters(t.dirty_events, spec)


@query("""
SELECT 'no_such_column' AS key, 'no such column' AS reason, count(*) AS orders FROM orders
UNION ALL SELECT 'o_totalprice', 'operator ''like'' does not apply to numbers', count(*) FROM orders""")
def filter_ignored_rules(t):
    """Rules that cannot be used leave the table alone and are reported."""
    from pyspark.sql import functions as F

    spec = {"no_such_column": {"op": ">", "value": 1}, "o_totalprice": {"op": "like", "value": 2}}
    plan = compile_filters(t.orders, spec)
    reasons = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(r).alias("reason")) for k, r in plan.ignored])
    counted = plan.apply(t.orders).agg(F.count(F.lit(1)).alias("orders"))
    return counted.select(F.inline(reasons), "orders")
