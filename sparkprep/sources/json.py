"""JSON scan: lists, wrapped lists, objects and JSON lines."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.cells import quoted
from ..session import shared_folder
from .json_records import cut_records

# Names under which an object may hold its list of records, in order of preference.
WRAPPER_KEYS = ["records", "data", "items", "results", "rows"]


def _edges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """First and last character of the first two non-blank lines: enough to see the layout."""
    try:
        lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
        probe = lines.select(F.substring("line", 1, 1), F.substring("line", -1, 1))
        return [tuple(row) for row in probe.limit(2).collect()]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"JSON file not found: {path}") from error
        raise


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None) -> DataFrame:
    """JSON lines; a damaged one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _one_a_line(spark: SparkSession, path: str) -> bool:
    """Whether each line can hold one object only: a reader of lines would pass over what follows it.

    Braces inside strings may speak against it; the records are then cut apart, which gives the same rows.
    """
    line = F.col("value")
    braces = [F.length(F.replace(line, F.lit(brace), F.lit(""))) for brace in "{}"]
    doubtful = line.rlike(r"\}\s*+[^\s,\]}]") | (braces[0] != braces[1])
    return spark.read.text(path).where(doubtful).isEmpty()


def _unwrapped(df: DataFrame, wrapper_keys: list[str], single_object: bool, path: str) -> DataFrame:
    """Rows of the first list that each object holds under a wrapper key, or else the object."""
    for k, key in enumerate(wrapper_keys):
        field = next((f for f in df.schema if f.name == key), None)
        if field is None or not isinstance(field.dataType, T.ArrayType):
            continue
        held = F.inline(quoted(key)) if isinstance(field.dataType.elementType, T.StructType) else F.explode(quoted(key)).alias("value")
        found, others = df.where(quoted(key).isNotNull()).select(held), df.where(quoted(key).isNull()).drop(key)
        if others.isEmpty():
            return found
        return found.unionByName(_unwrapped(others, wrapper_keys[k + 1 :], single_object, path), allowMissingColumns=True)
    if not single_object:
        raise ValueError(f"no list of records in {path}")
    return df


def _read_documents(
    spark: SparkSession, path: str, wrapper_keys: list[str], single_object: bool, schema: T.StructType | str | None
) -> DataFrame:
    """Files of any layout: their records, as JSON lines in the shared folder, read by Spark's reader."""
    records = cut_records(spark, path, wrapper_keys)
    files = records.groupBy("file", "level").count()
    alone = files.where("level = 0 and count = 1").select("file")  # objects that may hold a list somewhere
    folder = f"{shared_folder(spark)}/sparkprep-{uuid.uuid4().hex}"
    parts = []
    for name, how in (("records", "left_anti"), ("objects", "left_semi")):
        part = records.join(alone, "file", how).select("text")
        part.write.text(f"{folder}/{name}")
        if not spark.read.text(f"{folder}/{name}").isEmpty():
            found = _read(spark, f"{folder}/{name}", schema)
            parts.append(_unwrapped(found, wrapper_keys, single_object, path) if name == "objects" else found)
    if not parts:
        return spark.createDataFrame([], schema if schema is not None else T.StructType([]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_json(
    spark: SparkSession,
    path: str,
    *,
    lines: bool | None = None,
    wrapper_keys: list[str] = WRAPPER_KEYS,
    single_object: bool = True,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read records from JSON.

    A list gives one row per element; an object with a list of objects under a wrapper key gives that
    list; any other object gives one row unless ``single_object=False``; an empty file gives none. Objects may also follow
    one another, on one line or several. Files of a folder may differ in layout. One object per line is read
    as it is, if all lines look so and can be read; any other layout is first cut into records, many tasks to a file. A damaged record anywhere raises ``ValueError``: at once, or with ``schema`` when the rows are read.
    """
    edges = _edges(spark, path)
    if not edges:
        return spark.createDataFrame([], T.StructType([]))
    if edges[0][0] not in "[{":
        raise ValueError(f"unsupported JSON structure in {path}")
    plain = len(edges) > 1 and all(edge == ("{", "}") for edge in edges) if lines is None else lines
    try:
        if plain and (lines or _one_a_line(spark, path)):
            try:
                return _read(spark, path, schema)
            except (PySparkException, Py4JJavaError):
                if lines:
                    raise
        return _read_documents(spark, path, wrapper_keys, single_object, schema)
    except (PySparkException, Py4JJavaError) as error:
        raise ValueError(f"invalid JSON in {path}") from error


def flatten(df: DataFrame, sep: str = "_", max_level: int = 10) -> DataFrame:
    """Open nested objects into ``outer<sep>inner`` columns; arrays stay whole. One projection."""
    columns = []
    for f in df.schema:
        columns += _leaves(quoted(f.name), f.name, f.dataType, sep, max_level)
    return df.select(*[col.alias(name) for name, col in columns])


def _leaves(col, name: str, data_type: T.DataType, sep: str, levels: int) -> list[tuple[str, object]]:
    if not isinstance(data_type, T.StructType) or levels == 0:
        return [(name, col)]
    found = []
    for f in data_type:
        found += _leaves(col.getField(f.name), f"{name}{sep}{f.name}", f.dataType, sep, levels - 1)
    return found
