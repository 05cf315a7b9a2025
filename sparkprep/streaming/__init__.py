"""Cleaning of streams with plans that were fitted on a batch.

All steps are row-local, so a stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import FilterPlan
from ..operators.validate import split_valid
from ..plans.clean import RowPlan, apply_rows


def clean_stream(stream: DataFrame, plan: RowPlan, filters: FilterPlan | None = None) -> DataFrame:
    """Apply a fitted plan with its filters, and further ones compiled on a batch with the same columns."""
    cleaned = apply_rows(stream, plan)
    return filters.apply(cleaned) if filters else cleaned


def write_split(
    stream: DataFrame, plan: RowPlan, valid_path: str, rejected_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write valid rows and rejected rows of a cleaned stream to two Parquet tables.

    Every batch is written under its own number, so a batch that runs again replaces itself.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both tables come from one evaluation
        try:
            valid, rejected = split_valid(batch, plan.rules)
            valid.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = apply_rows(stream, plan).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
