"""Text and Markdown documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parsing import trim_text
from ..operators.cells import quoted


def normalized_text(col: Column) -> Column:
    """Unix line ends, at most one blank line in a row, nothing around the text."""
    unix = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    return trim_text(F.regexp_replace(unix, "\n{3,}", "\n\n"))


def normalize_text_docs(df: DataFrame, column: str, lines: str | None = None) -> DataFrame:
    """Normalise a text column; ``lines`` names a column for the number of lines."""
    result = df.withColumn(column, normalized_text(quoted(column)))
    if lines:
        result = result.withColumn(lines, F.size(F.split(quoted(column), "\n")))
    return result


def read_text_docs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per file: path, normalised text, number of lines."""
    files = spark.read.text(path, wholetext=True)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return normalize_text_docs(docs, "text", "lines")


def read_markdown_tables(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of the pipe tables in Markdown files."""
    files = spark.read.text(path, wholetext=True)
    return markdown_rows(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


RULE_LINE = r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$"


def markdown_rows(docs: DataFrame) -> DataFrame:
    """Rows of the pipe tables in documents (path, text): path, table, row, header, cells.

    ``table`` counts the tables of a document that have rows. A table is a header line, a line of dashes and the pipe
    lines that follow. All work stays in the document's own row, each line is looked at a fixed number of times, and
    nothing is shuffled. A null text has no tables.
    """
    pipe = lambda line: F.contains(line, F.lit("|"))
    rule = lambda line: pipe(line) & F.trim(line).rlike(RULE_LINE)
    read = lambda line: F.struct(line.alias("text"), pipe(line).alias("pipe"), rule(line).alias("rule"))
    lines = _settled(docs, F.transform(F.split("text", "\r?\n"), read), "lines")
    following = F.slice("lines", F.lit(2), F.size("lines"))
    # A new block starts at a header line and wherever a line has no pipe.
    starts = F.zip_with("lines", following, lambda a, b: a["pipe"] & ~a["rule"] & F.coalesce(b["rule"], F.lit(False)))
    cuts = F.zip_with(
        F.transform("lines", lambda line, i: F.struct(i.alias("at"), line["pipe"].alias("pipe"))), starts,
        lambda line, begins: F.struct(line["at"].alias("at"), begins.alias("begins"), (begins | ~line["pipe"]).alias("cut")),
    )
    blocks = _settled(lines, F.filter(cuts, lambda c: c["cut"]), "blocks", "lines")
    ends = F.slice("blocks", F.lit(2), F.size("blocks"))
    spans = F.zip_with(
        "blocks", ends, lambda a, b: F.struct(a["begins"].alias("begins"), a["at"].alias("at"), b["at"].alias("end"))
    )
    spans = _settled(blocks, F.filter(spans, lambda x: x["begins"]), "spans", "lines")
    found = F.transform("spans", lambda x: F.slice(
        "lines", x["at"] + 1, F.coalesce(x["end"], F.size("lines")) - x["at"]))
    cells = lambda line: F.transform(
        F.split(F.regexp_replace(F.trim(line["text"]), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)
    )
    tables = F.transform(found, lambda block: F.struct(
        cells(F.get(block, F.lit(0))).alias("header"),
        F.transform(F.filter(F.slice(block, F.lit(2), F.size(block)), lambda line: ~line["rule"]), cells).alias("rows"),
    ))
    tables = spans.select("path", F.posexplode(F.filter(tables, lambda x: F.size(x["rows"]) > 0)).alias("table", "found"))
    return tables.select(
        "path", "table", F.col("found.header").alias("header"), F.posexplode("found.rows").alias("row", "cells")
    ).select("path", "table", "row", "header", "cells")


def _settled(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """``path``, the columns to keep and a value that is computed once: as the one item of an exploded array, so that
    the optimiser does not write its expression into the functions that run for every line."""
    return df.select("path", *keep, F.explode(F.array(value)).alias(name))


def markdown_table(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """The rows of all tables with the given header, as text columns."""
    wanted = rows.where(F.col("header") == F.array(*[F.lit(h) for h in header]))
    return wanted.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)])
