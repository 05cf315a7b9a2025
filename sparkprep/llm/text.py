"""Column expressions and frame helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkprep.session import shared_folder

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables, by Spark's reader only."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(text, SPACE), "")


def total(items: Column, kind: str = "bigint") -> Column:
    """Sum of an array."""
    return F.aggregate(items, F.lit(0).cast(kind), lambda acc, x: acc + x)


def if_small(df: DataFrame, most: int) -> DataFrame:
    """A kept table, to be broadcast if it has at most ``most`` rows; else the optimiser joins it as it likes."""
    return F.broadcast(df) if df.count() <= most else df


def settled(value: Column) -> Column:
    """``value`` as the only item of an exploded array: the optimiser moves no filter on it below this place.

    A filter that moves takes the expression along, into the lambdas where it would be computed for every item.
    """
    return F.explode_outer(F.array(value))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder under a new name and go on from the files.

    Later steps then neither repeat the work nor depend on executors that may be lost.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_keys(key: str, text: str) -> list[Column]:
    """What a document is found again by: 128 bits of its id and text, in _k1 and _k2."""
    return [F.xxhash64(column(key)).alias("_k1"), F.xxhash64(whole(column(text))).alias("_k2")]


def attach(docs: DataFrame, found: DataFrame, key: str, text: str, columns: list[str], into: str, most: int) -> DataFrame:
    """``columns`` of ``docs`` and the struct ``into`` of what ``found`` (a kept table with one row for each
    _k1, _k2) has for the document, null if nothing. ``found`` is broadcast up to ``most`` rows."""
    fields = [c for c in found.columns if c not in ("_k1", "_k2")]
    rows = docs.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(columns)], *doc_keys(key, text))
    packed = found.select("_k1", "_k2", F.struct(*fields).alias("_m"))
    joined = rows.join(if_small(packed, most), ["_k1", "_k2"], "left")
    return joined.select(*[f"_c{i}" for i in range(len(columns))], "_m").toDF(*columns, into)
