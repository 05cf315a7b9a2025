"""Outliers by interquartile range or z-score: remove, flag, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import kind_of, numeric_value, parse_number
from .cells import quoted
from .quantiles import exact_quantiles
from .rowid import ROW_ID

NUMERIC_SHARE = 0.6
MIN_VALUES = 5
MIN_VALUES_REPORT = 4


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float


def numeric_columns(df: DataFrame, content: bool = True) -> list[str]:
    """Numeric columns by schema, plus text columns of which more than 60 % of the rows are numbers."""
    typed = {f.name for f in df.schema if kind_of(f.dataType) == "numeric" and f.name != ROW_ID}
    text = [f.name for f in df.schema if kind_of(f.dataType) == "text"] if content else []
    if text:
        row = df.agg(
            F.count(F.lit(1)), *[F.count(parse_number(quoted(c))).alias(f"n{i}") for i, c in enumerate(text)]
        ).first()
        typed |= {c for i, c in enumerate(text) if row[i + 1] > row[0] * NUMERIC_SHARE}
    return [c for c in df.columns if c in typed]


def _value(df: DataFrame, name: str) -> Column:
    return numeric_value(quoted(name), df.schema[name].dataType)


def _inside(df: DataFrame, name: str, bounds: Bounds, drop_nulls: bool) -> Column:
    value = _value(df, name)
    test = (value >= bounds.low) & (value <= bounds.high)
    return test if drop_nulls else F.coalesce(test, F.lit(True))


def _iqr_bounds(df: DataFrame, names: Sequence[str], k: float) -> dict[str, Bounds]:
    """Bounds of all given columns on the table as it is; columns that say nothing are left out."""
    fitted = exact_quantiles(df, {c: _value(df, c) for c in names}, [0.25, 0.75])
    bounds = {}
    for name in names:
        stats = fitted[name]
        if stats.count < MIN_VALUES:
            continue
        q1, q3 = stats.values[0.25], stats.values[0.75]
        if q3 == q1 or not stats.between:
            continue
        bounds[name] = Bounds(q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return bounds


def _zscore_bounds(df: DataFrame, names: Sequence[str], threshold: float) -> dict[str, Bounds]:
    if not names:
        return {}
    aggregates = []
    for i, name in enumerate(names):
        value = _value(df, name)
        aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_samp(value).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return {
        name: Bounds(row[f"m{i}"] - threshold * row[f"s{i}"], row[f"m{i}"] + threshold * row[f"s{i}"])
        for i, name in enumerate(names)
        if row[f"s{i}"]
    }


def fit_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    method: str = "iqr",
    k: float = 1.5,
    threshold: float = 3.0,
    sequential: bool = True,
    drop_nulls: bool = True,
) -> dict[str, Bounds]:
    """The bounds per column.

    Sequential fitting looks at each column after the rows outside the earlier columns' bounds are
    gone, one small search per column; otherwise all columns are fitted together on the full table.
    """
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    if method == "zscore":
        return _zscore_bounds(df, names, threshold)
    if method != "iqr":
        raise ValueError(f"unknown method '{method}'")
    if not sequential:
        return _iqr_bounds(df, names, k)
    bounds: dict[str, Bounds] = {}
    current = df
    for name in names:
        found = _iqr_bounds(current, [name], k)
        if found:
            bounds.update(found)
            current = current.where(_inside(df, name, found[name], drop_nulls))
    return bounds


def apply_outliers(df: DataFrame, bounds: Mapping[str, Bounds], drop_nulls: bool = True) -> DataFrame:
    """Keep rows within all bounds: one row-local filter."""
    tests = [_inside(df, name, b, drop_nulls) for name, b in bounds.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def remove_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    method: str = "iqr",
    k: float = 1.5,
    threshold: float = 3.0,
    sequential: bool = True,
    drop_nulls: bool = True,
) -> DataFrame:
    """Rows within the bounds of every processed column; a missing cell there counts as outside."""
    bounds = fit_outliers(
        df, columns, method=method, k=k, threshold=threshold, sequential=sequential, drop_nulls=drop_nulls
    )
    return apply_outliers(df, bounds, drop_nulls)


def flag_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    method: str = "iqr",
    k: float = 1.5,
    threshold: float = 3.0,
    suffix: str = "_outlier",
) -> DataFrame:
    """Add a boolean column per processed column instead of removing rows; missing is not an outlier."""
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    bounds = fit_outliers(df, names, method=method, k=k, threshold=threshold, sequential=False)
    return df.select(
        *map(quoted, df.columns),
        *[
            (~_inside(df, c, bounds[c], False) if c in bounds else F.lit(False)).alias(c + suffix)
            for c in names
        ],
    )


REPORT_SCHEMA = "column string, values long, lower double, upper double, outliers long, outlier_ratio double"


def outlier_rows(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> list[tuple]:
    """Per numeric column with enough values and a spread: bounds, outliers and their share."""
    names = list(columns or numeric_columns(df, content=False))
    fitted = exact_quantiles(df, {c: _value(df, c) for c in names}, [0.25, 0.75])
    bounds = {}
    for name in names:
        stats = fitted[name]
        if stats.count >= MIN_VALUES_REPORT and stats.values[0.75] > stats.values[0.25]:
            q1, q3 = stats.values[0.25], stats.values[0.75]
            bounds[name] = Bounds(q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    if not bounds:
        return []
    outside = [~_inside(df, c, b, False) for c, b in bounds.items()]
    row = df.agg(*[F.count_if(test).alias(f"o{i}") for i, test in enumerate(outside)]).first()
    return [
        (c, fitted[c].count, b.low, b.high, row[i], row[i] / fitted[c].count)
        for i, (c, b) in enumerate(bounds.items())
    ]


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    return df.sparkSession.createDataFrame(outlier_rows(df, columns, k), REPORT_SCHEMA)
