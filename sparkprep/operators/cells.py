"""Row-local clean-up of cells. Lazy, no shuffle, works on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.parsing import (
    CONVERSION_NULL_TOKENS,
    NULL_TOKENS,
    kind_of,
    null_if_token,
    trim_text,
)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if kind_of(field.dataType) == "text"]


def map_text(df: DataFrame, change, columns: Sequence[str] | None = None) -> DataFrame:
    """Apply ``change`` to the text columns in one projection."""
    chosen = set(text_columns(df) if columns is None else columns)
    return df.select(
        *[change(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns]
    )


def trim_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return map_text(df, trim_text, columns)


def normalize_nulls(
    df: DataFrame,
    tokens: Sequence[str] = NULL_TOKENS,
    *,
    trim: bool = False,
    ignore_case: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Null tokens become NULL; the conversion variants trim first and may ignore case."""
    return map_text(
        df, lambda c: null_if_token(c, tokens, trim=trim, ignore_case=ignore_case), columns
    )


def normalize_nulls_for_conversion(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    return normalize_nulls(df, CONVERSION_NULL_TOKENS, trim=True, ignore_case=ignore_case)


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(columns) if columns is not None else None)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing everywhere else in this package, so turn it into NULL once, at the source."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c)
            for c in df.columns
        ]
    )
