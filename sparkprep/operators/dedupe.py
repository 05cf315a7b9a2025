"""Duplicate rows: exact, normalised, on chosen keys.

All forms are grouped aggregates with map-side combining: every task first reduces its own rows to one
per key, so a key that holds a third of the table costs one row per task, not one giant group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import trim_text
from .cells import quoted
from .rowid import ROW_ID

SUSPECTS = 1_000


def remove_duplicates(
    df: DataFrame,
    mode: str = "auto",
    subset: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Keep the first row of every group of duplicates.

    ``exact``: cells equal, NULL equal to NULL. ``normalized``: cells equal as trimmed lower-case text,
    NULL equal to the empty text. ``auto``: exact, and normalised only if there was no exact duplicate.
    "First" follows ``order_by`` or ``_row_id``; without either the smallest row is kept, so the result
    does not depend on partitioning.
    """
    order = _order(df, order_by)
    keys = list(subset) if subset is not None else _data_columns(df)
    if mode == "exact":
        return _exact(df, keys, order, subset is not None)
    if mode == "normalized":
        return _keep_first(df, [normalized_key(keys)], order)
    if mode == "auto":
        return _auto(df, keys, order, subset is not None)
    raise ValueError(f"unknown mode '{mode}'")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def _order(df: DataFrame, order_by) -> list[str]:
    if order_by is not None:
        return [order_by] if isinstance(order_by, str) else list(order_by)
    return [ROW_ID] if ROW_ID in df.columns else []


def normalized_cell(name: str) -> Column:
    return F.coalesce(F.lower(trim_text(quoted(name).cast("string"))), F.lit(""))


def normalized_key(columns: Sequence[str]) -> Column:
    """A 256-bit digest of the normalised cells: half the shuffle of carrying them next to the row.

    The cells go in as a JSON array, so different rows never meet by sharing a separator.
    """
    cells = F.array(*[normalized_cell(c) for c in columns])
    return F.unhex(F.sha2(F.to_json(cells), 256)).alias("_key")


def _exact(df: DataFrame, keys: list[str], order: list[str], chosen: bool) -> DataFrame:
    if not chosen and not order:
        return df.dropDuplicates()
    if not chosen and order == [ROW_ID]:
        first = df.groupBy(*map(quoted, keys)).agg(F.min(ROW_ID).alias(ROW_ID))
        return first.select(*map(quoted, df.columns))
    return _keep_first(df, [quoted(k) for k in keys], order)


def _keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, then by its cells.

    Row positions identify rows, so with them only (digest, position) pairs are grouped, and the later
    positions, usually few, are taken out.
    """
    if list(order) == [ROW_ID]:
        return _without_later(df, keys)
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*map(quoted, order), *map(quoted, rest))
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min(row).alias("_row"))
    return first.select("_row.*").select(*map(quoted, df.columns))


def _without_later(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    placed = df.select(*named, quoted(ROW_ID))
    first = placed.groupBy(*names).agg(F.min(ROW_ID).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = [placed[n].eqNullSafe(first[n]) for n in names]
    later = placed.join(first, same).where(F.col(ROW_ID) > F.col("_first")).select(placed[ROW_ID])
    return df.join(later, ROW_ID, "left_anti").select(*map(quoted, df.columns))


def _auto(df: DataFrame, keys: list[str], order: list[str], chosen: bool) -> DataFrame:
    if has_duplicates(df, keys):
        return _exact(df, keys, order, chosen)
    return _keep_first(df, [normalized_key(keys)], order)


def has_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> bool:
    """Whether two rows agree on all keys, without shuffling the rows.

    Equal rows have equal hashes, so only the 8-byte hashes are grouped. Hashes that occur twice are
    suspects; one pair of equal rows among some of them settles the question. Only if all of those were
    mere collisions are the rows themselves grouped.
    """
    keys = list(keys) if keys is not None else _data_columns(df)
    columns = [quoted(k) for k in keys]
    digest = F.xxhash64(*columns)
    repeated = df.groupBy(digest.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    suspects = [row["_hash"] for row in repeated.limit(SUSPECTS).collect()]
    if not suspects:
        return False
    twice = lambda rows: not rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    if twice(df.where(digest.isin(suspects))):
        return True
    return len(suspects) == SUSPECTS and twice(df)


def row_digest(columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of the cells and of which of them are NULL.

    16 bytes stand for a row of any width; two different rows in 10^12 share them with probability 10^-14.
    """
    cells = [quoted(c) for c in columns]
    gaps = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(*cells, gaps).alias("_h1"), F.xxhash64(F.lit(11400714819323198), *cells, gaps).alias("_h2")]


def count_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows and the rows beyond the first of each group; only digests are shuffled."""
    keys = list(subset) if subset is not None else _data_columns(df)
    groups = df.groupBy(*row_digest(keys)).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    return groups.agg(
        rows.alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (rows - F.count(F.lit(1))).alias("duplicate_rows"),
    )
