"""Format conversion: CSV to JSON and JSON to CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.parsing import CONVERSION_NULL_TOKENS, READER_NULL_TOKENS
from ..sources.csv import read_csv
from ..sources.json import flatten, read_json
from ..sources.sinks import _plain, write
from .cells import normalize_nulls_for_conversion, trim_cells
from .names import standardize_columns
from .types import coerce_numeric

META_SCHEMA = "source string, rows long, columns array<string>"


def conversion_names(df: DataFrame) -> DataFrame:
    """Names as conversions write them; numbered only where two columns would share a name."""
    named = standardize_columns(df, dedupe=False)
    return named if len(set(named.columns)) == len(named.columns) else standardize_columns(df)


def csv_records(df: DataFrame) -> DataFrame:
    """Text columns as they go into JSON: standard names, null tokens gone, numbers as numbers."""
    named = conversion_names(df)
    return coerce_numeric(normalize_nulls_for_conversion(trim_cells(named)))


def csv_to_json(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> DataFrame:
    """Convert CSV files to JSON lines; returns the one-row description of the output."""
    records = csv_records(read_csv(spark, source, null_tokens=READER_NULL_TOKENS))
    write(records, target, "json", mode)
    written = spark.read.schema(records.schema).json(target)
    return spark.createDataFrame([("csv", written.count(), records.columns)], META_SCHEMA)


def flat_records(df: DataFrame, sep: str = "_", max_level: int = 10) -> DataFrame:
    """Nested records as flat columns with standard names; arrays become JSON text."""
    flat = conversion_names(flatten(df, sep, max_level))
    return normalize_nulls_for_conversion(_plain(flat), ignore_case=True)


def json_to_csv(
    spark: SparkSession, source: str, target: str, sep: str = "_", max_level: int = 10, mode: str = "errorifexists"
) -> DataFrame:
    """Convert JSON records to CSV; returns the flat table that was written."""
    records = read_json(spark, source, wrapper_keys=["records"], single_object=False)
    if not records.columns or records.isEmpty():
        raise ValueError("No records available for CSV conversion")
    flat = flat_records(records, sep, max_level)
    write(flat, target, "csv", mode)
    return flat
