"""Range rules: flag, drop or clip values outside given bounds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import kind_of, numeric_value, present
from .cells import quoted

VIOLATION_SCHEMA = "column string, rule string, expected double, violations_count long"


def _steps(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]):
    """The single bound checks in rule order; unknown columns are ignored."""
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        action = rule.get("action", "flag")
        for side in ("min", "max"):
            if rule.get(side) is not None:
                yield column, side, rule[side], action


def _violates(df: DataFrame, column: str, side: str, bound: Any) -> Column:
    """TRUE below the minimum or above the maximum; a missing value never violates."""
    data_type = df.schema[column].dataType
    numeric = kind_of(data_type) == "numeric"
    value = present(quoted(column), data_type) if numeric else numeric_value(quoted(column), data_type)
    test = value < F.lit(bound) if side == "min" else value > F.lit(bound)
    return F.coalesce(test, F.lit(False))


def count_range_violations(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Violations per column and bound from one aggregate.

    A dropping rule removes its rows before later rules are counted, so each count carries the
    condition that no earlier dropping rule has hit the row.
    """
    schema = VIOLATION_SCHEMA
    steps = list(_steps(df, rules))
    if not steps:
        return df.sparkSession.createDataFrame([], schema)
    alive = F.lit(True)
    counts = []
    for i, (column, side, bound, action) in enumerate(steps):
        hit = _violates(df, column, side, bound)
        counts.append(F.count_if(alive & hit).alias(f"v{i}"))
        if action == "drop":
            alive = alive & ~hit
    row = df.agg(*counts).first()
    found = [
        (column, side, float(bound), row[i])
        for i, (column, side, bound, _) in enumerate(steps)
        if row[i]
    ]
    return df.sparkSession.createDataFrame(found, schema)


def apply_ranges(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """The table after dropping and clipping. Row-local and lazy, so it also takes streams."""
    kept = F.lit(True)
    clipped: dict[str, Column] = {}
    dropping = False
    for column, side, bound, action in _steps(df, rules):
        hit = _violates(df, column, side, bound)
        if action == "drop":
            kept, dropping = kept & ~hit, True
        elif action == "clip":
            dtype = df.schema[column].dataType
            current = clipped.get(column, quoted(column))
            whole = float(bound).is_integer()
            target = dtype if whole or kind_of(dtype) != "numeric" else "double"
            clipped[column] = F.when(hit, F.lit(bound).cast(target)).otherwise(current.cast(target))
    result = df.where(kept) if dropping else df
    if not clipped:
        return result
    return result.select(*[clipped.get(c, quoted(c)).alias(c) for c in df.columns])


def validate_ranges(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Returns the processed table and the violations that were found."""
    return apply_ranges(df, rules), count_range_violations(df, rules)
