"""Missing data: analysis, recommendations, fills, drops and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.parsing import INTEGRAL_TYPES, kind_of
from .cells import nan_to_null, quoted
from .fills import fill_ordered
from .quantiles import exact_modes, exact_quantiles
from .rowid import ROW_ID, with_row_id

STRATEGIES = (
    "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward", "fill_value",
    "drop_rows", "drop_columns", "flag",
)
STRATEGY_ALIASES = {"drop": "drop_rows"}
DROP_SHARE = 50.0  # percent; above it the recommendation is to drop the column


@dataclass(frozen=True)
class MissingAnalysis:
    """Null counts of a table from one aggregate."""

    rows: int
    counts: Mapping[str, int]
    types: Mapping[str, T.DataType]

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    @property
    def percentage(self) -> float:
        cells = self.rows * len(self.counts)
        return round(100 * self.total / cells, 2) if cells else 0.0

    def column_percentage(self, name: str) -> float:
        return round(100 * self.counts[name] / self.rows, 2) if self.rows else 0.0

    @property
    def affected(self) -> list[str]:
        return [name for name, count in self.counts.items() if count]

    @property
    def high_missing(self) -> list[str]:
        return [name for name in self.affected if self.column_percentage(name) > DROP_SHARE]

    def recommendation(self, name: str) -> str:
        if self.column_percentage(name) > DROP_SHARE:
            return "drop_columns"
        return {"numeric": "fill_median", "datetime": "fill_forward"}.get(
            kind_of(self.types[name]), "fill_mode"
        )

    @property
    def recommendations(self) -> dict[str, str]:
        return {name: self.recommendation(name) for name in self.affected}


def analyze_missing(df: DataFrame, columns: Sequence[str] | None = None) -> MissingAnalysis:
    names = list(df.columns if columns is None else columns)
    df = nan_to_null(df)
    row = df.agg(
        F.count(F.lit(1)), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]
    ).first()
    return MissingAnalysis(
        row[0],
        {c: row[0] - row[i + 1] for i, c in enumerate(names)},
        {f.name: f.dataType for f in df.schema if f.name in names},
    )


ANALYSIS_SCHEMA = (
    "column string, dtype string, missing_count long, missing_percentage double, recommendation string"
)


def missing_report(df: DataFrame, analysis: MissingAnalysis | None = None) -> DataFrame:
    """One row per column with missing cells."""
    found = analysis or analyze_missing(df)
    rows = [
        (c, found.types[c].simpleString(), found.counts[c], found.column_percentage(c), found.recommendation(c))
        for c in found.affected
    ]
    return df.sparkSession.createDataFrame(rows, ANALYSIS_SCHEMA)


def missing_summary(df: DataFrame, analysis: MissingAnalysis | None = None) -> DataFrame:
    """Totals of the table followed by the affected columns, the emptiest first."""
    found = analysis or analyze_missing(df)
    ordered = sorted(found.affected, key=found.column_percentage, reverse=True)
    rows = [(0, "table", None, found.total, found.percentage, None, len(ordered), len(found.counts))]
    rows += [
        (i + 1, "column", c, found.counts[c], found.column_percentage(c), found.recommendation(c), None, None)
        for i, c in enumerate(ordered)
    ]
    schema = (
        "position int, level string, column string, missing_count long, missing_percentage double, "
        "recommendation string, affected_columns int, total_columns int"
    )
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass(frozen=True)
class FillStep:
    """One fitted step: the strategy that runs on a column and, for constants, its value."""

    column: str
    strategy: str
    value: Any = None


@dataclass
class MissingPlan:
    """Fitted handling of a table; steps are applied in column order."""

    steps: list[FillStep] = field(default_factory=list)
    actions: list[tuple[str, str, str]] = field(default_factory=list)
    rows_dropped: int = 0
    final_rows: int = 0

    @property
    def columns_dropped(self) -> list[str]:
        return [s.column for s in self.steps if s.strategy == "drop_columns"]

    @property
    def row_local(self) -> bool:
        """Whether the plan can run on a stream."""
        return not any(s.strategy in ("fill_forward", "fill_backward") for s in self.steps)


def fit_missing(
    df: DataFrame,
    strategy: Mapping[str, str] | str | None = None,
    default_strategy: str = "fill_mean",
    fill_value: Any = None,
    columns: Sequence[str] | None = None,
    analysis: MissingAnalysis | None = None,
) -> MissingPlan:
    """Choose a step per column with missing cells and compute the constants it needs.

    Dropping rows changes what later columns see, so constants are computed block by block between
    ``drop_rows`` columns; without such columns there is one block: one aggregate for counts and means,
    one quantile search for all medians and one job per data type for modes.
    """
    df = nan_to_null(df)
    names = [c for c in (df.columns if columns is None else columns) if c != ROW_ID]
    found = analysis or analyze_missing(df, names)
    plan = MissingPlan(final_rows=found.rows)
    chosen = {c: _strategy_for(c, found, strategy, default_strategy) for c in names}
    cuts = [i for i, c in enumerate(names) if chosen[c] == "drop_rows" and found.counts[c]]
    current, start, dropped = df, 0, False
    for cut in [*cuts, len(names)]:
        block = names[start:cut]
        if dropped:
            left = names[start:]
            found = analyze_missing(current, left)
        _fit_block(current, [c for c in block if found.counts[c]], chosen, found, fill_value, plan)
        start = cut
        if cut < len(names):
            name = names[cut]
            if found.counts[name]:
                plan.steps.append(FillStep(name, "drop_rows"))
                plan.actions.append((name, "drop_rows", f"Dropped {found.counts[name]} rows with missing values"))
                plan.rows_dropped += found.counts[name]
                plan.final_rows -= found.counts[name]
                current, dropped = current.where(quoted(name).isNotNull()), True
            start = cut + 1
            if dropped:
                continue
    return plan


def _strategy_for(column: str, found: MissingAnalysis, strategy, default: str) -> str:
    if isinstance(strategy, str):
        chosen = strategy
    elif strategy is None:
        chosen = found.recommendation(column)
    else:
        chosen = strategy.get(column, default)
    chosen = STRATEGY_ALIASES.get(chosen, chosen)
    if chosen not in STRATEGIES:
        raise ValueError(f"unknown strategy '{chosen}' for column '{column}'")
    return chosen


def _fit_block(df, names, chosen, found: MissingAnalysis, fill_value, plan: MissingPlan) -> None:
    numeric = {c for c in names if kind_of(found.types[c]) == "numeric"}
    means = [c for c in names if chosen[c] == "fill_mean" and c in numeric]
    medians = [c for c in names if chosen[c] == "fill_median" and c in numeric]
    modes = [
        c for c in names
        if chosen[c] == "fill_mode" or (chosen[c] in ("fill_mean", "fill_median") and c not in numeric)
    ]
    values: dict[str, Any] = {}
    if means:
        row = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(means)]).first()
        values.update({c: row[i] for i, c in enumerate(means)})
    if medians:
        fitted = exact_quantiles(df, {c: quoted(c) for c in medians}, [0.5])
        values.update({c: fitted[c].values[0.5] for c in medians})
    if modes:
        values.update(exact_modes(df, modes))
    for c in names:
        how = chosen[c]
        value = fill_value if how == "fill_value" else values.get(c)
        plan.steps.append(FillStep(c, how, value))
        plan.actions.append((c, how, _action_text(c, how, value, c in values and c not in numeric)))


def _action_text(column: str, how: str, value: Any, by_mode: bool) -> str:
    if how in ("fill_mean", "fill_median"):
        word = how.removeprefix("fill_")
        if by_mode:
            return f"Filled with mode ({word} not applicable)"
        return f"Filled with {word} ({value:.2f})" if value is not None else f"No {word} to fill with"
    return {
        "fill_mode": f"Filled with mode ({value})",
        "fill_forward": "Forward filled (with backward fill for the leading gap)",
        "fill_backward": "Backward filled (with forward fill for the trailing gap)",
        "fill_value": f"Filled with the given value ({value})",
        "drop_columns": "Column taken out",
        "flag": "Created flag column",
    }[how]


def apply_missing(
    df: DataFrame,
    plan: MissingPlan,
    flag_suffix: str = "_missing",
    order_by: str | Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Run fitted steps. Constants, flags and drops are one projection and one filter; only ordered
    fills shuffle."""
    df = nan_to_null(df)
    ordered = {
        how: [s.column for s in plan.steps if s.strategy == how] for how in ("fill_forward", "fill_backward")
    }
    drops = [s.column for s in plan.steps if s.strategy == "drop_rows"]
    result = df
    position = _fill_order(df, order_by) if any(ordered.values()) else None
    borrowed = position == [ROW_ID] and ROW_ID not in df.columns
    if borrowed:
        result = with_row_id(result)
    if drops and position:
        result = _fill_around_drops(result, plan, position, by)
    else:
        if drops:
            result = result.na.drop(subset=drops)
        for how, columns in ordered.items():
            if columns:
                result = fill_ordered(result, columns, position, how.removeprefix("fill_"), by)
    if borrowed:
        result = result.drop(ROW_ID)

    constants = {
        s.column: s.value
        for s in plan.steps
        if s.value is not None and s.strategy in ("fill_mean", "fill_median", "fill_mode", "fill_value")
    }
    gone = set(plan.columns_dropped)
    output = [
        _filled(f.name, f.dataType, constants[f.name]).alias(f.name) if f.name in constants else quoted(f.name)
        for f in result.schema
        if f.name not in gone
    ]
    flags = [
        quoted(s.column).isNull().alias(s.column + flag_suffix) for s in plan.steps if s.strategy == "flag"
    ]
    return result.select(*output, *flags)


def _fill_around_drops(df: DataFrame, plan: MissingPlan, position: list[str], by: Sequence[str]) -> DataFrame:
    """Ordered fills and row drops in the order of the steps, consecutive fills together."""
    pending: tuple[str, list[str]] | None = None
    result = df
    for step in [*plan.steps, FillStep("", "end")]:
        if pending and step.strategy != pending[0]:
            result = fill_ordered(result, pending[1], position, pending[0].removeprefix("fill_"), by)
            pending = None
        if step.strategy in ("fill_forward", "fill_backward"):
            pending = (step.strategy, [*(pending[1] if pending else []), step.column])
        elif step.strategy == "drop_rows":
            result = result.where(quoted(step.column).isNotNull())
    return result


def _fill_order(df: DataFrame, order_by) -> list[str]:
    if order_by is None:
        return [ROW_ID]
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _filled(name: str, data_type: T.DataType, value: Any):
    """Fill with a constant; the column becomes double or text where its type cannot hold the value."""
    col, kind = quoted(name), kind_of(data_type)
    if isinstance(data_type, INTEGRAL_TYPES) and isinstance(value, float) and not value.is_integer():
        return F.coalesce(col.cast("double"), F.lit(value))
    if isinstance(value, str) and kind in ("numeric", "boolean", "datetime"):
        return F.coalesce(col.cast("string"), F.lit(value))
    return F.coalesce(col, F.lit(value).cast(data_type))


HANDLING_SCHEMA = "column string, strategy string, action string"


def handling_report(df: DataFrame, plan: MissingPlan) -> DataFrame:
    return df.sparkSession.createDataFrame(plan.actions, HANDLING_SCHEMA)


def handle_missing(
    df: DataFrame,
    strategy: Mapping[str, str] | str | None = None,
    default_strategy: str = "fill_mean",
    fill_value: Any = None,
    flag_suffix: str = "_missing",
    order_by: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Handle every column with missing cells; returns the table and a report of what was done.

    ``order_by`` names the key that forward and backward fills follow; without it they follow
    ``_row_id`` or, lacking that, the scan order. With ``by`` they stay inside the groups of those columns.
    """
    plan = fit_missing(df, strategy, default_strategy, fill_value, columns)
    return apply_missing(df, plan, flag_suffix, order_by, by), handling_report(df, plan)
