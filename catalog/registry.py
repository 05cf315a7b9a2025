"""Registered queries: a Spark function over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from sparkprep.session import shared_folder

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            text = views.VIEWS[name]
            inputs = {t: self.read(t) for t in views.INPUTS if "{" + t + "}" in text}
            return self.spark.sql(text, **inputs)
        return self.read(name)

    @cached_property
    def scratch(self) -> str:
        """A new folder next to the checkpoints, which all executors share."""
        return f"{shared_folder(self.spark)}/sparkprep-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` may use the views as ``{view}``."""

    def register(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = views.expand(sql)
        return function

    return register
