"""Sinks: cleaned tables, error reports, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.cells import quoted

FORMATS = ("csv", "json", "parquet")

#: Spark's text formats keep milliseconds only unless told otherwise.
TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that cannot hold them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name)
            for f in df.schema
        ]
    )


def write(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a table as CSV with header, JSON lines or Parquet."""
    if format not in FORMATS:
        raise ValueError(f"Unsupported output format: {format}")
    if format == "csv":
        _plain(df).write.mode(mode).options(**TIMES).csv(path, header=True, escape='"')
    elif format == "json":
        df.write.mode(mode).options(**TIMES).option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode(mode).parquet(path)


def write_report(errors: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Write an error table, one line per error."""
    write(errors, path, format, mode)


def write_vectors(vectors: DataFrame, meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors and their metadata side by side."""
    write(vectors, f"{path}/vectors", "parquet", mode)
    write(meta, f"{path}/meta", "parquet", mode)


def read_vectors(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta")
