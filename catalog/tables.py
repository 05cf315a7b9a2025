"""Sources, sinks, conversion, text, run history, streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sparkprep import (
    clean,
    flatten,
    normalize_text_docs,
    read_any,
    read_csv,
    read_json,
    run_history,
    run_status_counts,
    with_row_id,
    write,
    write_split,
)
from sparkprep.functions.parsing import WHITESPACE
from sparkprep.operators.convert import csv_to_json, json_to_csv
from sparkprep.plans import fit_rows
from sparkprep.sources.text import markdown_rows, markdown_table

from .registry import query


@query("""
SELECT event_id, ts, user_id, nullif(trim(event_type), 'N/A') AS event_type, value, sparse_col FROM {dirty_events}""")
def csv_scan(t):
    """Written as CSV and read back as text: null tokens gone, cells trimmed."""
    events = t.dirty_events
    write(events, f"{t.scratch}/events", "csv")
    return _typed(read_csv(t.spark, f"{t.scratch}/events"), events)


def _typed(text, like):
    """Text columns cast to the types of another table."""
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema])


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part WHERE p_size > 20")
def csv_scan_long_lines(t):
    """Lines with 1 to 20 surplus fields, some of them empty, are skipped."""
    blank = F.repeat(F.lit(","), F.col("p_size"))
    more = F.when(F.col("p_size") <= 20, F.concat(blank, F.when(F.col("p_size") % 3 == 0, "").otherwise("x")))
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(","), "p_name", F.coalesce(more, F.lit("")))
    t.part.select(line.alias("value")).write.text(f"{t.scratch}/lines")
    return read_csv(t.spark, f"{t.scratch}/lines", header=["key", "name"])


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text, lang, source, n_chars FROM documents""")
def csv_scan_line_breaks(t):
    """Whole documents with quotes, separators and line breaks, written as CSV and read back."""
    write(t.documents, f"{t.scratch}/documents", "csv")
    return _typed(read_csv(t.spark, f"{t.scratch}/documents"), t.documents)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_scan_separator(t):
    """The separator is found in the header."""
    t.orders.write.option("header", True).option("sep", ";").csv(f"{t.scratch}/orders.csv")
    return _typed(read_any(t.spark, f"{t.scratch}/orders.csv"), t.orders)


@query("SELECT c_custkey, c_name || ' Ærøskøbing é' AS c_name, c_mktsegment FROM customer")
def csv_scan_encodings(t):
    """One folder of files in UTF-8, UTF-16 and ISO-8859-1, each read in its own encoding."""
    key = F.col("c_custkey")
    named = t.customer.select("c_custkey", F.concat("c_name", F.lit(" Ærøskøbing é")).alias("c_name"), "c_mktsegment")
    for i, encoding in enumerate(["UTF-8", "UTF-16", "ISO-8859-1"]):
        part = named.where(key % 3 == i)
        part.write.mode("append").options(header=True, encoding=encoding).csv(f"{t.scratch}/customer")
    return read_csv(t.spark, f"{t.scratch}/customer", encoding=None).withColumn("c_custkey", key.cast("bigint"))


@query("SELECT count(*) AS rows_initial, CAST(0 AS BIGINT) AS duplicates_removed, CAST(6 AS INTEGER) AS columns FROM orders")
def clean_folder(t):
    """A whole run over a folder of CSV files with another separator."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    orders.repartition(3).write.option("header", True).option("sep", "|").csv(f"{t.scratch}/folder")
    result = clean(f"{t.scratch}/folder", {"profile": False}, spark=t.spark)
    return result.summary.select("rows_initial", "duplicates_removed", "columns")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part WHERE p_size <= 25")
def csv_scan_damaged(t):
    """Lines with a surplus field are skipped, the others are kept."""
    line = F.concat_ws(
        ",", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") > 25, F.lit("surplus"))
    )
    t.part.select(line.alias("value")).write.text(f"{t.scratch}/lines")
    return read_csv(t.spark, f"{t.scratch}/lines", header=["key", "name"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part WHERE p_size > 25")
def csv_scan_strict(t):
    """Lines of any other length than the header are left out."""
    line = F.concat_ws(
        ";",
        F.col("p_partkey").cast("string"),
        F.when(F.col("p_size") > 10, F.col("p_name")),
        F.when((F.col("p_size") > 10) & (F.col("p_size") <= 25), F.lit("surplus")),
    )
    t.part.select(line.alias("value")).write.text(f"{t.scratch}/lines")
    return read_csv(t.spark, f"{t.scratch}/lines", on_bad_lines="strict", sep=";", header=["key", "name"])


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders""")
def csv_row_positions(t):
    """Positions follow the order of the lines in the scan."""
    ordered = t.orders.select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    write(ordered, f"{t.scratch}/orders", "csv")
    numbered = with_row_id(read_csv(t.spark, f"{t.scratch}/orders"), order_by=F.col("o_orderkey").cast("bigint"))
    return numbered.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "_row_id")


@query("SELECT event_id, ts, user_id, event_type, value, sparse_col FROM {dirty_events}")
def json_scan(t):
    """Written as JSON lines and read back with inferred types."""
    write(t.dirty_events, f"{t.scratch}/events", "json")
    return read_json(t.spark, f"{t.scratch}/events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def csv_scan_column_orders(t):
    """A folder whose files order their columns in three ways."""
    orders = [["event_id", "event_type", "user_id"], ["user_id", "event_id", "event_type"], ["event_type", "user_id", "event_id"]]
    for k, order in enumerate(orders):
        part = t.events.where(F.col("event_id") % 3 == k).select(*order)
        part.write.mode("append").option("header", True).csv(f"{t.scratch}/events")
    return read_csv(t.spark, f"{t.scratch}/events").select("event_id", "event_type", "user_id")


def _events_json(t, begin, between, line_end, end, pretty=False):
    """All events as JSON records in files of one list or row of objects each, a record to a line.

    Lines end as ``line_end`` says; if that is a brace, it is the record's own. A file holds no more than an eighth of a
    million keys, so that no task has a growing share of the events.
    """
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"), {"pretty": str(pretty).lower()})
    if line_end == "}":
        record = F.left(record, F.length(record) - 1)
    of_file = Window.partitionBy("million", "eighth").orderBy("event_id")
    first, last = F.row_number().over(of_file) == 1, F.lead(F.lit(True)).over(of_file).isNull()
    split = t.events.withColumn("million", F.floor(F.col("event_id") / 1_000_000)).withColumn("eighth", F.col("user_id") % 8)
    placed = split.select("million", "eighth", "event_id", record.alias("record"), first.alias("first"), last.alias("last"))
    opened = F.concat(F.when(F.col("first"), begin).otherwise(""), "record", F.when(F.col("last"), end).otherwise(between))
    lines = placed.sortWithinPartitions("million", "eighth", "event_id").select("million", "eighth", opened.alias("value"))
    lines.write.partitionBy("million", "eighth").option("lineSep", line_end).text(f"{t.scratch}/events")
    return read_json(t.spark, f"{t.scratch}/events").select("event_id", "user_id", "event_type", "value", "props")


EVENTS_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"


@query(EVENTS_SQL)
def json_lists(t):
    """Lists of objects, pretty-printed."""
    return _events_json(t, "[", ",", "\n", "]", pretty=True)


@query(EVENTS_SQL)
def json_wrapped(t):
    """Lists under a wrapper key, behind other keys."""
    return _events_json(t, '{"page": 1, "name": "a}b", "items": [', ",", " ", "]}")


@query(EVENTS_SQL)
def json_concatenated(t):
    """Pretty-printed objects, one right after the other."""
    return _events_json(t, "", "", "}", "", pretty=True)


@query("""
SELECT event_id % 10 AS kind, count(*) AS n_events, event_id % 10 IN (3, 7) AS refused FROM events GROUP BY event_id % 10""")
def json_damaged(t):
    """Ten files, two of them with a damaged record in the middle: those are refused, of the others all rows are read."""
    record = F.to_json(F.struct("event_id", "user_id", "event_type"))
    damaged = F.when(F.col("event_id") % 10 == 3, F.replace(record, F.lit('"user_id":'), F.lit('"user_id"')))
    damaged = damaged.when(F.col("event_id") % 10 == 7, F.replace(record, F.lit("}"), F.lit(""))).otherwise(record)
    lines = t.events.select(damaged.alias("value"), (F.col("event_id") % 10).alias("kind"))
    lines.repartition("kind").write.partitionBy("kind").text(f"{t.scratch}/events")
    counts = []
    for kind in range(10):
        path = f"{t.scratch}/events/kind={kind}"
        try:
            counts.append((kind, read_json(t.spark, path).count(), False))
        except ValueError:
            counts.append((kind, t.spark.read.text(path).count(), True))
    return t.spark.createDataFrame(counts, "kind long, n_events long, refused boolean")


@query("SELECT * FROM orders")
def parquet_scan(t):
    write(t.orders, f"{t.scratch}/orders.parquet", "parquet")
    return read_any(t.spark, f"{t.scratch}/orders.parquet")


@query("""
SELECT event_id, user_id AS who_user_id, event_type AS who_event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k,
  CAST(json_extract(props, '$.k') AS BIGINT) AS deep_inner_k FROM events""")
def json_flatten(t):
    props = F.from_json("props", "k bigint")
    nested = t.events.select(
        "event_id",
        F.struct("user_id", "event_type").alias("who"),
        props.alias("props"),
        F.struct(props.alias("inner")).alias("deep"),
    )
    return flatten(nested)


@query("""
SELECT CAST(event_id AS BIGINT) AS event_id, nullif(trim(event_type), 'N/A') AS event_type, sparse_col FROM {dirty_events}""")
def convert_csv_to_json(t):
    renamed = t.dirty_events.select(
        F.col("event_id").alias("Event ID"), F.col("event_type").alias("event-type"), "sparse_col"
    )
    write(renamed, f"{t.scratch}/in", "csv")
    csv_to_json(t.spark, f"{t.scratch}/in", f"{t.scratch}/out")
    return read_json(t.spark, f"{t.scratch}/out")


@query("""
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'N/A' THEN NULL ELSE trim(event_type) END AS who_event_type,
  '[' || user_id || ',' || event_id || ']' AS ids FROM {dirty_events}""")
def convert_json_to_csv(t):
    nested = t.dirty_events.select(
        "event_id",
        F.struct(F.col("event_type").alias("Event Type")).alias("who"),
        F.array("user_id", "event_id").alias("ids"),
    )
    write(nested, f"{t.scratch}/in", "json")
    json_to_csv(t.spark, f"{t.scratch}/in", f"{t.scratch}/out")
    return read_csv(t.spark, f"{t.scratch}/out")


TIDY = r"regexp_replace(replace(text || chr(13) || chr(10) || repeat(chr(10), 4) || lang, chr(13) || chr(10), chr(10)), '\n\n\n+', chr(10) || chr(10), 'g')"


@query(f"""
SELECT doc_id, trim({TIDY}, '{WHITESPACE}') AS text,
  CAST(len(string_split(trim({TIDY}, '{WHITESPACE}'), chr(10))) AS INTEGER) AS lines FROM documents""")
def text_documents(t):
    """Line ends and blank lines of whole texts are tidied."""
    messy = t.documents.select("doc_id", F.concat("text", F.lit("\r\n\n\n\n\n"), "lang").alias("text"))
    return normalize_text_docs(messy, "text", lines="lines")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders""")
def markdown_tables(t):
    """Pipe tables inside texts become rows."""
    text = F.concat(
        F.lit("# Order\n\n| key | status |\n|---|:-:|\n| "), F.col("o_orderkey").cast("string"), F.lit(" | "),
        "o_orderstatus", F.lit(" |\n| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority",
        F.lit(" |\n\nEnd | of it\n"),
    )
    docs = t.orders.select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))
    return markdown_table(markdown_rows(docs), ["key", "status"])


STATES = """
SELECT CAST(user_id AS STRING) AS run_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, ts AS created_at, ts AS updated_at
FROM {events}"""
LATEST = "SELECT run_id, max_by(status, updated_at) AS status, max(updated_at) AS updated_at FROM (" + STATES + ") GROUP BY run_id"


@query(LATEST)
def runs(t):
    manifest = t.spark.sql(STATES, events=t.events)
    return run_history(manifest).select("run_id", "status", "updated_at")


@query(f"""
WITH latest AS ({LATEST})
SELECT s.status, count(latest.run_id) AS runs FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('cancelled')) s(status)
LEFT JOIN latest ON latest.status = s.status GROUP BY s.status UNION ALL SELECT 'total', count(*) FROM latest""")
def run_statuses(t):
    return run_status_counts(t.spark.sql(STATES, events=t.events))


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_totalprice AS BIGINT) AS o_totalprice,
  coalesce(TRY_CAST(o_totalprice AS BIGINT) BETWEEN 20000 AND 300000, false) AS valid FROM {dirty_orders}""")
def stream_split(t):
    """A plan fitted on the table runs on a stream of the same rows and splits it."""
    orders = t.dirty_orders.select("o_orderkey", "o_totalprice")
    rules = {"o_totalprice": {"type": "number", "required": True, "min": 20000, "max": 300000}}
    plan = fit_rows(orders, {"validation_rules": rules, "handle_missing_data": False})
    write(orders, f"{t.scratch}/in", "parquet")
    stream = t.spark.readStream.schema(orders.schema).parquet(f"{t.scratch}/in")
    done = write_split(
        stream, plan, f"{t.scratch}/valid", f"{t.scratch}/rejected", f"{t.scratch}/progress"
    )
    done.awaitTermination()
    read = lambda name: t.spark.read.parquet(f"{t.scratch}/{name}").select("o_orderkey", "o_totalprice")
    return read("valid").withColumn("valid", F.lit(True)).unionAll(
        read("rejected").withColumn("valid", F.lit(False))
    )


@query("""
SELECT o_orderkey, o_totalprice, o_totalprice <= 300000 AS valid FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_totalprice AS BIGINT) AS o_totalprice FROM {dirty_orders})
WHERE o_totalprice > 100000""")
def stream_filtered_split(t):
    """Filters of a fitted plan leave out rows of the stream before it is split."""
    orders = t.dirty_orders.select("o_orderkey", "o_totalprice")
    plan = fit_rows(orders, {
        "validation_rules": {"o_totalprice": {"type": "number", "max": 300000}}, "handle_missing_data": False,
        "filters": {"o_totalprice": {"op": ">", "value": 100000}},
    })
    write(orders, f"{t.scratch}/in", "parquet")
    stream = t.spark.readStream.schema(orders.schema).parquet(f"{t.scratch}/in")
    write_split(stream, plan, f"{t.scratch}/valid", f"{t.scratch}/rejected", f"{t.scratch}/progress").awaitTermination()
    read = lambda name: t.spark.read.parquet(f"{t.scratch}/{name}").select("o_orderkey", "o_totalprice")
    return read("valid").withColumn("valid", F.lit(True)).unionAll(read("rejected").withColumn("valid", F.lit(False)))
