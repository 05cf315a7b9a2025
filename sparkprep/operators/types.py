"""Type inference and enforcement.

One aggregate over the text columns counts, per column, how many cells read as boolean, number or integer and how
many look like each date layout; a second one, only over columns that look like dates, tries the likely layouts. Both inference rules (shares of all rows for normalisation, shares of
non-null rows for detection) are decided on the driver from those counts, so normalising *and*
enforcing a whole table costs at most two scans and one lazy projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.parsing import (
    DATE_FORMATS,
    FALLBACK_FORMATS,
    FALSE_TOKENS,
    FALSE_TOKENS_EXTENDED,
    NULL_TOKENS,
    TRUE_TOKENS,
    TRUE_TOKENS_EXTENDED,
    DateFormat,
    is_integral,
    is_known_signature,
    kind_of,
    null_if_token,
    parse_bool,
    parse_datetime,
    parse_integer,
    parse_number,
    rough_signature,
    trim_text,
)
from .cells import quoted

NORMALIZE_SHARE = 0.7  # of all rows, strictly more
FORMAT_SHARE = 0.7  # a date layout must read more than this share
POSSIBLE_SHARE = 0.5  # below all shares that choose a layout
DETECT_SHARE = 0.8  # of non-null rows, at least
LONGEST_FLAG = max(map(len, TRUE_TOKENS_EXTENDED + FALSE_TOKENS_EXTENDED))

# Names users may give to types, with the spelling used in plans.
TYPE_ALIASES = {
    "bool": "bool", "boolean": "bool",
    "int": "int", "integer": "int", "long": "int",
    "float": "float", "number": "float", "double": "float", "numeric": "float",
    "datetime": "datetime", "date": "datetime", "timestamp": "datetime",
    "string": "string", "str": "string", "text": "string",
    "auto": "auto",
}

@dataclass(frozen=True)
class CellCounts:
    """What the fused aggregate knows about one text column."""

    rows: int
    present: int
    bools: int
    bools_extended: int
    numbers: int
    integers: int
    dates: Mapping[str, int]

    def date_format(self, denominator: int) -> str | None:
        """The first layout that reads more than 70 % of ``denominator`` rows."""
        for name, count in self.dates.items():
            if denominator and count / denominator > FORMAT_SHARE:
                return name
        return None

    def best_format(self) -> str:
        return self.date_format(self.rows) or self.date_format(self.present) or max(
            self.dates, key=lambda name: self.dates[name]
        )


@dataclass(frozen=True)
class ColumnPlan:
    """How one column is read: ``kind`` is bool / int / float / datetime / string / keep."""

    kind: str
    date_format: str | None = None
    extended: bool = False


@dataclass(frozen=True)
class TypePlan:
    """The fitted conversion of a table; plain data, usable on other batches and on streams."""

    columns: Mapping[str, ColumnPlan]
    targets: Mapping[str, str] = field(default_factory=dict)
    errors: Sequence[tuple[str, str]] = ()
    requested: Mapping[str, str] = field(default_factory=dict)
    null_tokens: Sequence[str] = tuple(NULL_TOKENS)
    trim: bool = True


def count_cells(
    df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = NULL_TOKENS, forced: Sequence[str] = ()
) -> dict[str, CellCounts]:
    """Counts for all text columns in one job, and in a second one for those that look like dates.

    The columns are unpivoted to (column, cell) rows first: the tests are then compiled once instead of
    once per column, however wide the table is, and combined per task before a shuffle of a few rows. Dates are
    first counted by signature, which bounds what each layout can read. Only layouts that may read more than
    ``POSSIBLE_SHARE`` of a column's cells, or any of a column in ``forced``, are then tried on the cells of that
    column; the bound stands for the others.
    """
    layouts = DATE_FORMATS + FALLBACK_FORMATS
    # One projection per step: Spark keeps them apart, so each value is computed once per cell.
    tested = _cells(df, columns, tokens).select(
        "item",
        "cell",
        "trimmed",
        F.when(F.octet_length("trimmed") <= LONGEST_FLAG, F.lower("trimmed")).alias("word"),
        parse_number(F.col("cell")).alias("number"),
    )
    rough = F.when(F.col("number").isNull(), rough_signature(F.col("trimmed")))
    signed = tested.select("item", "cell", "word", "number", rough.alias("rough"))
    signed = signed.withColumn("signature", F.when(is_known_signature(F.col("rough")), F.col("rough")))
    tallies = ["rows", "present", "bools", "bools_extended", "numbers", "integers"]
    by_signature = signed.groupBy("item", "signature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("cell").alias("present"),
        F.count_if(F.col("word").isin(TRUE_TOKENS + FALSE_TOKENS)).alias("bools"),
        F.count_if(F.col("word").isin(TRUE_TOKENS_EXTENDED + FALSE_TOKENS_EXTENDED)).alias("bools_extended"),
        F.count("number").alias("numbers"),
        F.count_if(is_integral(F.col("number"))).alias("integers"),
    )
    bounds = [
        F.sum(F.when(F.col("signature").rlike(layout.signature), F.col("rows")).otherwise(0)).alias(f"date{j}")
        for j, layout in enumerate(layouts)
    ]
    counted = by_signature.groupBy("item").agg(*[F.sum(name).alias(name) for name in tallies], *bounds)
    empty = CellCounts(0, 0, 0, 0, 0, 0, {layout.name: 0 for layout in layouts})
    result = dict.fromkeys(columns, empty)
    for row in counted.collect():  # one row per column
        dates = {layout.name: row[f"date{j}"] for j, layout in enumerate(layouts)}
        result[columns[row["item"]]] = CellCounts(*[row[name] for name in tallies], dates)
    possible = {}
    for name, counts in result.items():
        least = 0 if name in forced else counts.present * POSSIBLE_SHARE
        likely = [layout for layout in layouts if counts.dates[layout.name] > least]
        if likely:
            possible[name] = likely
    for name, read in _count_dates(df, possible, tokens).items():
        result[name] = replace(result[name], dates={**result[name].dates, **read})
    return result


def _cells(df: DataFrame, columns: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """All cells of the columns: item (the column's place), cell (NULL for tokens) and the cell trimmed."""
    cells = df.select(F.posexplode(F.array(*map(quoted, columns))).alias("item", "raw"))
    cell = null_if_token(F.col("raw"), tokens) if tokens else F.col("raw")
    return cells.select("item", cell.alias("cell")).select("item", "cell", trim_text(F.col("cell")).alias("trimmed"))


def _count_dates(df: DataFrame, possible: Mapping[str, Sequence[DateFormat]], tokens: Sequence[str]) -> dict[str, dict[str, int]]:
    """How many cells each possible layout reads, per column; one job, none without such columns."""
    if not possible:
        return {}
    columns = list(possible)
    items: dict[DateFormat, list[int]] = {}
    for item, name in enumerate(columns):
        for layout in possible[name]:
            items.setdefault(layout, []).append(item)
    read = [
        F.count(F.when(F.col("item").isin(places), parse_datetime(F.col("trimmed"), layout))).alias(f"date{j}")
        for j, (layout, places) in enumerate(items.items())
    ]
    counted = _cells(df, columns, tokens).groupBy("item").agg(*read).collect()  # one row per column
    return {
        columns[row["item"]]: {
            layout.name: row[f"date{j}"] for j, layout in enumerate(items) if layout in possible[columns[row["item"]]]
        }
        for row in counted
    }


def _normalized_kind(counts: CellCounts) -> ColumnPlan:
    """Boolean, number, date, text, in that order, by shares of all rows."""
    share = lambda n: n / counts.rows if counts.rows else 0.0
    if share(counts.bools) > NORMALIZE_SHARE:
        return ColumnPlan("bool")
    if share(counts.numbers) > NORMALIZE_SHARE:
        whole = counts.integers == counts.rows
        return ColumnPlan("int" if whole else "float")
    layout = counts.date_format(counts.rows)
    if layout:
        return ColumnPlan("datetime", layout)
    return ColumnPlan("string")


def _detected_kind(counts: CellCounts, confidence: float) -> ColumnPlan:
    """Boolean, number, date, text, in that order, by shares of the non-null rows."""
    if counts.present == 0:
        return ColumnPlan("string")
    share = lambda n: n / counts.present
    if share(counts.bools_extended) >= confidence:
        return ColumnPlan("bool", extended=True)
    if share(counts.numbers) >= confidence:
        return ColumnPlan("int" if counts.integers == counts.numbers else "float")
    layout = counts.date_format(counts.present)
    if layout and share(counts.dates[layout]) >= confidence:
        return ColumnPlan("datetime", layout)
    return ColumnPlan("string")


def _typed_kind(data_type: T.DataType) -> str:
    kind = kind_of(data_type)
    if kind == "numeric":
        return "int" if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "float"
    return {"boolean": "bool", "datetime": "datetime", "text": "string"}.get(kind, "keep")


def _refined_kind(counts: CellCounts, confidence: float) -> ColumnPlan:
    """Normalisation followed by detection on its result, from the counts of the raw column."""
    first = _normalized_kind(counts)
    if first.kind == "string":
        return _detected_kind(counts, confidence)
    if first.kind == "float" and counts.integers == counts.numbers:
        return ColumnPlan("int")
    return first


def fit_types(
    df: DataFrame,
    *,
    normalize: bool = True,
    enforce: bool = True,
    type_map: Mapping[str, str] | None = None,
    auto_detect: bool = True,
    confidence: float = DETECT_SHARE,
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> TypePlan:
    """Decide the type of every column. One aggregate over the text columns, nothing for typed ones."""
    fields = {f.name: f.dataType for f in df.schema}
    wanted = {}
    for name, target in (type_map or {}).items():
        wanted[name] = TYPE_ALIASES.get(target, target)
    text = [name for name, dtype in fields.items() if kind_of(dtype) == "text"]
    tokens = tuple(null_tokens) if normalize else ()
    forced = [name for name, target in wanted.items() if target == "datetime"] if enforce else []
    counts = count_cells(df, text, tokens, forced) if text and (normalize or enforce) else {}

    fractional = _fractional_columns(
        df, [n for n, t in wanted.items() if t == "int" and n in fields and n not in counts]
    )
    columns: dict[str, ColumnPlan] = {}
    targets: dict[str, str] = {}
    errors: list[tuple[str, str]] = []
    for name, dtype in fields.items():
        base = ColumnPlan("keep")
        if name in counts:
            base = _normalized_kind(counts[name]) if normalize else ColumnPlan("keep")
        columns[name] = base
        if not enforce:
            continue
        target = wanted.get(name)
        if target in (None, "auto"):
            if not auto_detect and target is None:
                continue
            if name in counts:
                decide = _refined_kind if normalize else _detected_kind
                columns[name] = decide(counts[name], confidence)
            else:
                columns[name] = ColumnPlan(_typed_kind(dtype))
            targets[name] = columns[name].kind
            continue
        plan = _forced_kind(target, counts.get(name), name in fractional)
        if isinstance(plan, str):
            errors.append((name, plan))
        else:
            columns[name] = plan
            targets[name] = target
    for name in wanted:
        if enforce and name not in fields:
            errors.append((name, f"No column '{name}' in the table"))
    return TypePlan(columns, targets, tuple(errors), wanted, tokens, trim=normalize)


def _forced_kind(target: str, counts: CellCounts | None, fractional: bool) -> ColumnPlan | str:
    if target == "bool":
        return ColumnPlan("bool", extended=True)
    if target == "datetime":
        return ColumnPlan("datetime", counts.best_format() if counts else None)
    if target == "int" and (fractional or (counts and counts.integers != counts.numbers)):
        return "Failed to enforce type: fractional values cannot become int"
    if target in ("int", "float", "string"):
        return ColumnPlan(target)
    return f"Failed to enforce type: unknown type '{target}'"


def _fractional_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Typed numeric columns that hold values with a fraction."""
    names = [n for n in names if _typed_kind(df.schema[n].dataType) == "float"]
    if not names:
        return set()
    row = df.agg(
        *[F.count_if(~is_integral(quoted(n).cast("double"))).alias(f"f{i}") for i, n in enumerate(names)]
    ).first()
    return {n for i, n in enumerate(names) if row[i]}


def typed_column(name: str, data_type: T.DataType, plan: ColumnPlan, trim: bool) -> Column:
    """The expression that converts one column, whose null tokens are gone already."""
    col = quoted(name)
    if kind_of(data_type) != "text":
        return _typed_cast(col, data_type, plan)
    if plan.kind == "bool":
        return parse_bool(col, plan.extended)
    if plan.kind == "int":
        return parse_integer(col)
    if plan.kind == "float":
        return parse_number(col)
    if plan.kind == "datetime":
        return parse_datetime(col, plan.date_format)
    return trim_text(col) if trim else col


def prepare_cells(df: DataFrame, plan: TypePlan, keep: Sequence[str] = ()) -> DataFrame:
    """Null tokens out, dates trimmed: steps of their own, so that the conversions read plain columns."""
    text = {f.name for f in df.schema if kind_of(f.dataType) == "text"} - set(keep)
    dates = {c for c, p in plan.columns.items() if p.kind == "datetime"} & text
    if plan.null_tokens and text:
        df = df.select(
            *[null_if_token(quoted(c), plan.null_tokens).alias(c) if c in text else quoted(c) for c in df.columns]
        )
    if dates:
        df = df.select(*[trim_text(quoted(c)).alias(c) if c in dates else quoted(c) for c in df.columns])
    return df


def _typed_cast(col: Column, data_type: T.DataType, plan: ColumnPlan) -> Column:
    """Enforce a type on a column that already has one."""
    have = _typed_kind(data_type)
    if plan.kind == "keep":
        return col
    if plan.kind == have:
        return {
            "int": lambda: col.cast("bigint"),
            "float": lambda: col.cast("double"),
            "datetime": lambda: col.cast("timestamp_ntz"),
        }.get(have, lambda: col)()
    if plan.kind == "string":
        return col.cast("string")
    if plan.kind == "bool":
        if have in ("int", "float"):
            return F.when(col == 1, F.lit(True)).when(col == 0, F.lit(False))
        return parse_bool(col, extended=True)
    if plan.kind in ("int", "float") and have in ("int", "float", "bool"):
        return col.cast("bigint" if plan.kind == "int" else "double")
    if plan.kind == "datetime":
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(None).cast("bigint" if plan.kind == "int" else "double")


def apply_types(df: DataFrame, plan: TypePlan) -> DataFrame:
    """Convert all columns, lazily. Row-local, so it also takes streaming frames."""
    keep = ColumnPlan("keep")
    return prepare_cells(df, plan).select(
        *[
            typed_column(f.name, f.dataType, plan.columns.get(f.name, keep), plan.trim).alias(f.name)
            for f in df.schema
        ]
    )


def normalize_types(df: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Infer a type for every text column and convert it; cells that do not fit become NULL."""
    return apply_types(df, fit_types(df, enforce=False, null_tokens=null_tokens))


def detect_column_types(
    df: DataFrame, confidence: float = DETECT_SHARE, sample: int | None = None
) -> dict[str, str]:
    """The intended type of every column. ``sample`` looks only at the first rows, as a preview does."""
    probe = df if sample is None else df.limit(sample)
    plan = fit_types(probe, normalize=False, confidence=confidence)
    return {name: p.kind if p.kind != "keep" else "string" for name, p in plan.columns.items()}


def first_row_types(df: DataFrame) -> dict[str, str]:
    """What a preview shows for every column, told from the first row alone: boolean, numeric, datetime or text.

    Text is a datetime if some layout reads it and it has more than eight characters. A missing value, and every
    column of an empty table, is text. Sort the table first if "first" should not be left to the scan.
    """
    rows = df.limit(1).collect()
    if not rows:
        return dict.fromkeys(df.columns, "text")
    first = df.sparkSession.createDataFrame(rows, df.schema)
    dates = {c for c, p in fit_types(first, normalize=False).columns.items() if p.kind == "datetime"}
    kinds = {}
    for f, value in zip(df.schema, rows[0]):
        if value is None:
            kinds[f.name] = "text"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "datetime" if f.name in dates and len(value) > 8 else "text"
        else:
            dated = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            kinds[f.name] = "datetime" if dated else "text"
    return kinds


def enforce_types(
    df: DataFrame,
    type_map: Mapping[str, str] | None = None,
    auto_detect: bool = True,
    confidence: float = DETECT_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """Convert columns to detected or given types; returns the table and its report."""
    plan = fit_types(
        df, normalize=False, type_map=type_map, auto_detect=auto_detect, confidence=confidence
    )
    typed = apply_types(df, plan)
    return typed, type_report(df, typed, plan)


REPORT_SCHEMA = "column string, original string, target string, final string, error string"


def type_report(before: DataFrame, after: DataFrame, plan: TypePlan) -> DataFrame:
    """One row per enforced column, plus one per column that could not be enforced."""
    rows = [
        (
            name,
            before.schema[name].dataType.simpleString(),
            target,
            after.schema[name].dataType.simpleString(),
            None,
        )
        for name, target in plan.targets.items()
    ]
    types = {f.name: f.dataType.simpleString() for f in before.schema}
    rows += [(name, types.get(name), plan.requested.get(name), None, message) for name, message in plan.errors]
    return before.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become numbers when every non-null cell reads as one."""
    names = [f.name for f in df.schema if kind_of(f.dataType) == "text"]
    names = [n for n in names if columns is None or n in columns]
    if not names:
        return df
    aggregates = []
    for i, name in enumerate(names):
        number = parse_number(quoted(name))
        aggregates += [
            F.count(quoted(name)).alias(f"present_{i}"),
            F.count(number).alias(f"number_{i}"),
            F.count_if(is_integral(number)).alias(f"integer_{i}"),
        ]
    row = df.agg(*aggregates).first()
    plans = {}
    for i, name in enumerate(names):
        if row[f"present_{i}"] and row[f"present_{i}"] == row[f"number_{i}"]:
            whole = row[f"integer_{i}"] == row[f"number_{i}"]
            plans[name] = ColumnPlan("int" if whole else "float")
    return apply_types(df, TypePlan(plans, null_tokens=(), trim=False))


def conversion_errors(df: DataFrame, plan: TypePlan, row_id: str | Sequence[str] = "_row_id") -> DataFrame:
    """Cells that hold text but are lost by the conversion: row, column, value, target.

    Row-local: an array of failures is built per row and opened with ``inline``; rows without
    failures produce nothing, and nothing is shuffled.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    cells = prepare_cells(df, plan, keep=ids)
    failures = []
    for f in df.schema:
        column = plan.columns.get(f.name)
        if f.name in ids or column is None or column.kind in ("keep", "string"):
            continue
        if kind_of(f.dataType) != "text":
            continue
        parsed = typed_column(f.name, f.dataType, column, plan.trim)
        failures.append(
            F.when(
                quoted(f.name).isNotNull() & parsed.isNull(),
                F.struct(
                    F.lit(f.name).alias("column"),
                    quoted(f.name).alias("value"),
                    F.lit(column.kind).alias("target"),
                ),
            )
        )
    names = {ids[0]: "row"} if len(ids) == 1 else {i: i for i in ids}
    keys = [quoted(i).alias(names[i]) for i in ids]
    if not failures:
        empty = "array<struct<column:string,value:string,target:string>>"
        return df.where(F.lit(False)).select(*keys, F.inline(F.lit(None).cast(empty)))
    return cells.select(*keys, F.inline(F.array_compact(F.array(*failures))))
