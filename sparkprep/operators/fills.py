"""Forward and backward fill over a whole ordered table, without a single-partition window.

The order key is cut into ranges of similar size. One aggregate takes the last known value of every
range and column; the ranges (one row for a million rows) are filled among themselves and joined back as the
value carried into the range. Inside a range an ordinary window does the rest, on the partitioning of that
join, and what no earlier row can fill takes the first known value of the table.

Where many rows share a key, or have none, the key alone cannot be cut evenly. Such tables are numbered first, in
the order of the key and, within equal keys, of a hash of the row, and are cut by number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import kind_of
from .cells import quoted
from .rowid import ROW_ID, with_row_id

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000  # cuts in one plan; beyond it rows are numbered instead
_RANGE = "_range"


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order_by: str | Sequence[str],
    direction: str = "forward",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Fill NULLs with the nearest earlier (``forward``) or later (``backward``) value.

    A leading (trailing) gap takes the value from the other side. ``order_by`` should identify the rows;
    rows with equal keys follow each other in some order that depends on the rows alone.
    With ``by`` every group is filled on its own, ranges being cut inside the groups.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    ranged, key = _with_ranges(df, order, rows_per_range)
    groups = list(by)
    cuts = [quoted(c) for c in groups] + [F.col(_RANGE)]
    forward = direction == "forward"
    nearest, farthest = (F.max_by, F.min_by) if forward else (F.min_by, F.max_by)
    known = lambda c: F.when(quoted(c).isNotNull(), key)

    # One row per range (and group): the value each range hands on, and its other end.
    ends = ranged.groupBy(*cuts).agg(
        *[nearest(quoted(c), known(c)).alias(f"_out{i}") for i, c in enumerate(columns)],
        *[farthest(quoted(c), known(c)).alias(f"_in{i}") for i, c in enumerate(columns)],
    )
    step = F.col(_RANGE).asc() if forward else F.col(_RANGE).desc()
    earlier = Window.partitionBy(*[quoted(c) for c in groups]).orderBy(step).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Reading the ranges the other way round finds the far end's first known value.
    back = F.col(_RANGE).desc() if forward else F.col(_RANGE).asc()
    whole = Window.partitionBy(*[quoted(c) for c in groups]).orderBy(back).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carry = ends.select(
        *cuts,
        *[
            F.coalesce(
                F.last(f"_out{i}", ignorenulls=True).over(earlier),
                F.last(f"_in{i}", ignorenulls=True).over(whole),
            ).alias(f"_carry{i}")
            for i in range(len(columns))
        ],
    )
    joined = _join_carry(ranged, carry, groups)
    upto = Window.partitionBy(*cuts).orderBy(key.asc() if forward else key.desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(upto), F.col(f"_carry{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(*[filled.get(c, quoted(c)).alias(c) for c in df.columns])


def _join_carry(left: DataFrame, carry: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join on the range number, and on the group with NULL as a group of its own."""
    keys = [*groups, _RANGE]
    carries = [c for c in carry.columns if c.startswith("_carry")]
    renamed = carry.select(*[quoted(k).alias(f"_key{i}") for i, k in enumerate(keys)], *carries)
    test = F.col(_RANGE) == F.col(f"_key{len(groups)}")
    for i, group in enumerate(groups):
        test = test & quoted(group).eqNullSafe(F.col(f"_key{i}"))
    return left.join(renamed, test, "left")


def _with_ranges(df: DataFrame, order: list[str], rows_per_range: int) -> tuple[DataFrame, Column]:
    """Add the range number; returns the key by which rows inside a range are compared."""
    single = len(order) == 1
    if single and order[0] == ROW_ID:
        # Positions are dense: a division cuts them evenly.
        span = F.floor(quoted(ROW_ID) / F.lit(rows_per_range)).cast("int")
        return df.withColumn(_RANGE, span), quoted(ROW_ID)
    dtype = df.schema[order[0]].dataType
    if single and kind_of(dtype) in ("numeric", "datetime"):
        ranged = _numeric_ranges(df, order[0], kind_of(dtype), rows_per_range)
        if ranged is not None:
            return ranged, F.struct(quoted(order[0]), _tie(df))
    # Any other key gets positions first (range partitioning and one written copy).
    numbered = with_row_id(df, "_position", order_by=[*map(quoted, order), _tie(df)])
    span = F.floor(F.col("_position") / F.lit(rows_per_range)).cast("int")
    return numbered.withColumn(_RANGE, span), F.col("_position")


def _tie(df: DataFrame) -> Column:
    """What orders rows with equal keys: a hash of their cells (maps have none)."""
    cells = [quoted(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cells) if cells else F.lit(0)


def _numeric_ranges(df: DataFrame, name: str, kind: str, rows_per_range: int) -> DataFrame | None:
    """Cut a number or instant at sampled quantiles; a monotone double is enough to cut by.

    None if that would take too many cuts, or if a range came out more than twice as large as wanted.
    """
    number = quoted(name).cast("double")
    if kind == "datetime":
        number = F.unix_micros(quoted(name).cast("timestamp")).cast("double")
    pieces = math.ceil(df.count() / rows_per_range)
    if pieces > MAX_RANGES:
        return None
    if pieces <= 1:
        return df.withColumn(_RANGE, F.lit(0))
    shares = [k / pieces for k in range(1, pieces)]
    cuts = df.agg(F.percentile_approx(number, shares, max(1_000, 4 * pieces))).first()[0] or []
    picked = sorted(set(cuts))
    if not picked:
        return None
    splits = [-math.inf, *picked, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_number", outputCol=_RANGE, handleInvalid="keep")
    ranged = cut.transform(df.withColumn("_number", number)).drop("_number")
    ranged = ranged.withColumn(_RANGE, F.coalesce(F.col(_RANGE).cast("int"), F.lit(-1)))
    sizes = ranged.groupBy(_RANGE).count().agg(F.max("count")).first()
    return ranged if sizes[0] <= 2 * rows_per_range else None
