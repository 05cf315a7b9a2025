"""Sources: CSV, JSON, Excel, text, Markdown, Parquet and tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..operators.cells import nan_to_null
from .csv import read_csv, read_header, sniff_separator
from .excel import read_excel
from .json import WRAPPER_KEYS, flatten, read_json
from .text import markdown_table, normalize_text_docs, read_markdown_tables, read_text_docs


def kind_of_files(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The extension that a file, the files of a list or those of a folder share."""
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {PurePosixPath(p).suffix.lower().lstrip(".") for p in paths}
    if kinds == {""}:  # folders; only their files are listed
        kinds = {PurePosixPath(p).suffix.lower().lstrip(".") for p in spark.read.text(paths).inputFiles()}
    if len(kinds) != 1:
        raise ValueError(f"Unsupported file type: {sorted(kinds) or path}; name one with format=")
    return kinds.pop()


def read_any(spark: SparkSession, path: str | Sequence[str], format: str | None = None, **options) -> DataFrame:
    """Choose the source by file extension or by ``format``; ``table`` reads a catalog table.

    ``path`` is a file, a folder or a list of files. The separator of CSV files is looked for in the header
    unless given.
    """
    kind = format or kind_of_files(spark, path)
    many = path if isinstance(path, str) else list(path)
    if kind == "csv":
        return read_csv(spark, many, **{"sep": None, **options})
    if kind in ("json", "jsonl", "ndjson"):
        return nan_to_null(read_json(spark, many, **options))
    if kind == "xlsx":
        return read_excel(spark, many, **options)
    if kind in ("md", "txt"):
        return read_text_docs(spark, many, **options)
    if kind == "parquet":
        return nan_to_null(spark.read.parquet(*([many] if isinstance(many, str) else many)))
    if kind == "table":
        return nan_to_null(spark.table(path))
    raise ValueError(f"Unsupported file type: {kind or path}")


__all__ = [
    "WRAPPER_KEYS",
    "flatten",
    "markdown_table",
    "normalize_text_docs",
    "read_any",
    "read_csv",
    "read_excel",
    "read_header",
    "read_json",
    "read_markdown_tables",
    "read_text_docs",
    "sniff_separator",
]
