"""Column names: standardisation and lookup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def clean_name(name: str, collapse: bool = True) -> str:
    """Lower case, anything but word characters becomes one underscore, none at the ends."""
    name = re.sub(r"\W+", "_", name.strip().lower())
    if collapse:
        name = re.sub(r"__+", "_", name)
    return name.strip("_")


def standard_names(names: list[str], dedupe: bool = True) -> list[str]:
    """Standard form of every name; repeats are numbered and never meet another column's name."""
    if not dedupe:
        return [clean_name(name, collapse=False) for name in names]
    cleaned = [clean_name(name) or "column" for name in names]
    taken: set[str] = set()
    reserved = set(cleaned)
    counter: dict[str, int] = {}
    result = []
    for base in cleaned:
        candidate = base
        while candidate in taken or (candidate != base and candidate in reserved):
            counter[base] = counter.get(base, 0) + 1
            candidate = f"{base}_{counter[base]}"
        taken.add(candidate)
        result.append(candidate)
    return result


def standardize_columns(df: DataFrame, dedupe: bool = True) -> DataFrame:
    return df.toDF(*standard_names(df.columns, dedupe))


def renamed_count(before: list[str], after: list[str]) -> int:
    return sum(old != new for old, new in zip(before, after))


def resolve_column(columns: list[str], key: str) -> str | None:
    """The column a user means: an exact match wins, then the first one that contains or is contained."""
    wanted = key.lower().strip()
    for column in columns:
        if column.lower() == wanted:
            return column
    for column in columns:
        name = column.lower()
        if wanted in name or name in wanted:
            return column
    return None
