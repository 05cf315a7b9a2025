"""Feature vectors: hashed text, standardised numbers, one-hot categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import kind_of
from .cells import nan_to_null, quoted
from .quantiles import exact_quantiles
from .rowid import ROW_ID

WIDTH = 512
MAX_CATEGORIES = 10
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
METHODS = ("hybrid", "text_only", "numeric")


def embed_text(df: DataFrame, column: str, n: int = WIDTH, output: str | None = None) -> DataFrame:
    """Hash the words of a column into ``n`` non-negative buckets, scaled to length 1.

    Words have at least two word characters and are lower-cased; missing or empty text gives the zero
    vector. Stateless, sparse, and computed on the JVM.
    """
    output = output or f"{column}_emb"
    text = df.withColumn("_text", F.coalesce(quoted(column).cast("string"), F.lit("")))
    tokens = RegexTokenizer(
        inputCol="_text", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True
    ).transform(text)
    counted = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=n).transform(tokens)
    scaled = Normalizer(inputCol="_counts", outputCol=output, p=2.0).transform(counted)
    return scaled.drop("_text", "_tokens", "_counts")


@dataclass(frozen=True)
class FeaturePlan:
    """How one column becomes features, and where they sit in the vector."""

    column: str
    type: str  # numeric / boolean / text_embedded / categorical_encoded
    start: int
    size: int
    names: Sequence[str]
    fill: float | None = None
    mean: float | None = None
    std: float | None = None
    categories: Sequence[str] = ()


@dataclass(frozen=True)
class VectorPlan:
    """The fitted vectorisation of a table."""

    method: str
    samples: int
    features: Sequence[FeaturePlan] = field(default_factory=tuple)

    @property
    def size(self) -> int:
        return sum(f.size for f in self.features)

    @property
    def feature_names(self) -> list[str]:
        return [name for f in self.features for name in f.names]


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(fill, mean, population std) per numeric column, measured after filling with the median."""
    df = nan_to_null(df)
    if not columns:
        return {}
    medians = exact_quantiles(df, {c: quoted(c) for c in columns}, [0.5])
    fills = {c: medians[c].values[0.5] for c in columns}
    aggregates = []
    for i, c in enumerate(columns):
        value = _filled_number(c, fills[c])
        aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return {c: (fills[c], row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def _filled_number(column: str, fill: float | None) -> Column:
    return F.coalesce(quoted(column).cast("double"), F.lit(fill).cast("double"))


def _scaled(column: str, fill: float, mean: float, std: float) -> Column:
    return (_filled_number(column, fill) - F.lit(mean)) / F.lit(std)


def standardize(df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_normalized") -> DataFrame:
    """Add (x − mean) / population standard deviation for numeric columns, missing cells at the median."""
    df = nan_to_null(df)
    names = list(columns or [f.name for f in df.schema if kind_of(f.dataType) == "numeric" and f.name != ROW_ID])
    scaling = fit_scaling(df, names)
    return df.select(
        *map(quoted, df.columns), *[_scaled(c, *scaling[c]).alias(c + suffix) for c in names]
    )


def categories_of(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str] | None:
    """The sorted values of a column, or None when there are more than ``limit``.

    The limit ends the distinct early and bounds what reaches the driver.
    """
    values = (
        df.select(quoted(column).cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    return sorted(v[0] for v in values) if len(values) <= limit else None


def vector_entries(col: Column) -> Column:
    """The stored cells of a vector as (place, value), from 0 on: a sparse vector is not spread over its width."""
    vector = F.unwrap_udt(col)
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    return F.arrays_zip(places.alias("place"), vector["values"].alias("value"))


def vector_width(col: Column) -> Column:
    vector = F.unwrap_udt(col)
    return F.coalesce(vector["size"], F.size(vector["values"]))


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """Add a 0/1 column per category except the first; missing cells are 0 everywhere."""
    categories = categories_of(df, column)
    if categories is None:
        raise ValueError(f"column '{column}' has more than {MAX_CATEGORIES} categories")
    return df.select(
        *map(quoted, df.columns),
        *[_is_category(column, v).cast("int").alias(f"{column}_{v}") for v in categories[1:]],
    )


def _is_category(column: str, value: str) -> Column:
    return F.coalesce(quoted(column).cast("string") == F.lit(value), F.lit(False))


def fit_vectors(df: DataFrame, method: str = "hybrid", columns: Sequence[str] | None = None) -> VectorPlan:
    """Measure what the vectors need: scaling of numbers and, for ``numeric``, small category lists."""
    df = nan_to_null(df)
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}'")
    names = [c for c in (columns or df.columns) if c != ROW_ID]
    kinds = {c: kind_of(df.schema[c].dataType) for c in names}
    samples = df.count()
    if not samples or not names:
        raise ValueError("DataFrame is empty")
    numbers = [c for c in names if kinds[c] == "numeric" and method != "text_only"]
    scaling = fit_scaling(df, numbers)
    features, start = [], 0
    for c in names:
        if c in scaling:
            fill, mean, std = scaling[c]
            plan = FeaturePlan(c, "numeric", start, 1, [f"{c}_normalized"], fill, mean, std)
        elif kinds[c] == "boolean" and method != "text_only":
            plan = FeaturePlan(c, "boolean", start, 1, [f"{c}_bool"])
        else:
            values = categories_of(df, c) if method == "numeric" else None
            if values is None:
                labels = [f"{c}_emb_{i}" for i in range(WIDTH)]
                plan = FeaturePlan(c, "text_embedded", start, WIDTH, labels)
            else:
                kept = values[1:]
                labels = [f"{c}_{v}" for v in kept]
                plan = FeaturePlan(c, "categorical_encoded", start, len(kept), labels, categories=kept)
        features.append(plan)
        start += plan.size
    return VectorPlan(method, samples, tuple(features))


def apply_vectors(df: DataFrame, plan: VectorPlan, output: str = "features") -> DataFrame:
    """Add the feature vector. Row-local, so fitted plans also run on streams."""
    df = nan_to_null(df)
    result, parts = df, []
    for i, f in enumerate(plan.features):
        part = f"_part{i}"
        if f.type == "numeric":
            result = result.withColumn(part, _scaled(f.column, f.fill, f.mean, f.std))
        elif f.type == "boolean":
            result = result.withColumn(part, F.coalesce(quoted(f.column).cast("double"), F.lit(0.0)))
        elif f.type == "text_embedded":
            result = embed_text(result, f.column, f.size, part)
        elif f.size:
            flags = [_is_category(f.column, v).cast("double") for v in f.categories]
            result = result.withColumn(part, array_to_vector(F.array(*flags)))
        else:
            continue
        parts.append(part)
    assembled = VectorAssembler(inputCols=parts, outputCol=output).transform(result)
    return assembled.select(*map(quoted, df.columns), quoted(output))


META_SCHEMA = (
    "column string, type string, first_feature int, last_feature int, n_features int, "
    "mean double, std double, categories array<string>, method string, n_samples long"
)


def vector_meta(spark, plan: VectorPlan) -> DataFrame:
    """One row per source column; stored next to the vectors, so nothing is fitted again to describe them."""
    rows = [
        (
            f.column, f.type, f.start, f.start + f.size - 1, f.size, f.mean, f.std,
            list(f.categories) or None, plan.method, plan.samples,
        )
        for f in plan.features
    ]
    return spark.createDataFrame(rows, META_SCHEMA)


def vectorize(
    df: DataFrame, method: str = "hybrid", columns: Sequence[str] | None = None, output: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """Add feature vectors to a table; returns it with its metadata."""
    plan = fit_vectors(df, method, columns)
    return apply_vectors(df, plan, output), vector_meta(df.sparkSession, plan)


def vector_info(meta: DataFrame, shown: int = 20) -> DataFrame:
    """One row: samples, features, method and the first feature names, all from the metadata."""
    size = F.col("n_features")
    names = (
        F.when(F.col("type") == "numeric", F.array(F.concat("column", F.lit("_normalized"))))
        .when(F.col("type") == "boolean", F.array(F.concat("column", F.lit("_bool"))))
        .when(size == 0, F.array().cast("array<string>"))
        .when(
            F.col("type") == "categorical_encoded",
            F.transform("categories", lambda v: F.concat(F.col("column"), F.lit("_"), v)),
        )
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), size - 1),
                lambda i: F.concat(F.col("column"), F.lit("_emb_"), i.cast("string")),
            )
        )
    )
    listed = meta.select("*", names.alias("names"))
    return listed.agg(
        F.max("n_samples").alias("n_samples"),
        F.sum("n_features").alias("n_features"),
        F.max("method").alias("method"),
        F.slice(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_feature", "names"))), lambda s: s["names"])),
            1,
            shown,
        ).alias("feature_names"),
    )
