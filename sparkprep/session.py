"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def build_session(app_name: str = "sparkprep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkprep-"))
    return sc.getCheckpointDir()


@contextmanager
def compiled_in_parts(spark: SparkSession) -> Iterator[None]:
    """Jobs on many columns, in methods that the JVM compiles.

    Whole-stage code puts all expressions of a row into one method. The JVM never compiles one of more than 8,000 bytes of
    code, and interpreted it is ten times as slow; Spark then makes several small methods, if told that limit.
    """
    key, limit = "spark.sql.codegen.hugeMethodLimit", 8_000
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(limit, int(before or limit))))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where a long plan would otherwise be run again for every following aggregate, or where later
    steps must see the very same rows. The copy is columnar, so those steps read only their columns, and
    losing executors does not lose it. It belongs to the run; whoever owns the folder clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/sparkprep-{uuid.uuid4().hex}"
    return _written(df, path).toDF(*df.columns)


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write under neutral names (any column name will do) and read back with a given schema."""
    neutral = df.select(
        *[
            (col.cast("string") if isinstance(f.dataType, T.NullType) else col).alias(f"c{i}")
            for i, (f, col) in enumerate(zip(df.schema, _columns(df)))
        ]
    )
    neutral.write.parquet(path)
    return df.sparkSession.read.schema(neutral.schema).parquet(path)


def _columns(df: DataFrame) -> list:
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def materialize_numbered(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize``, with the position of every row in the written table as column ``name``.

    A row's position is its place inside its file plus the rows of the files before it. The offsets are
    one row per file, so broadcasting them is safe.
    """
    path = f"{shared_folder(df.sparkSession)}/sparkprep-{uuid.uuid4().hex}"
    table = _written(df, path)
    columns = table.columns
    file, place = F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")
    sizes = table.select(file).groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    number = lambda pattern: F.regexp_extract("_file", pattern, 1).try_cast("int")
    before = Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = table.select(*columns, file, place).join(F.broadcast(offsets), "_file")
    position = (F.col("_offset") + F.col("_place")).cast("bigint")
    return placed.select(*columns, position.alias("_position")).toDF(*df.columns, name)
