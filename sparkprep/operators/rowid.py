"""Explicit row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..session import materialize_numbered

ROW_ID = "_row_id"


def with_row_id(
    df: DataFrame, name: str = ROW_ID, order_by: Sequence[str | Column] | str | None = None
) -> DataFrame:
    """Number the rows 0 … n−1 without gaps and without bringing them together.

    The rows are written once, and their place in the written files is their position: in the order of
    the scan, or of ``order_by`` after range partitioning and sorting. ``order_by`` should identify rows:
    equal leading values are then spread over partitions by the rest of the key.
    """
    if order_by is not None:
        keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize_numbered(df, name)
