"""Declarative filters: a dictionary of rules becomes one Catalyst predicate.

Typed columns are compared with literals of their own type, so range and equality rules reach the
Parquet scan as pushed filters. Only text columns named in the rules need a look at their content, and
one aggregate decides all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.parsing import (
    FALSE_TOKENS_EXTENDED,
    INTEGRAL_TYPES,
    NUMBER_PATTERN,
    TRUE_TOKENS_EXTENDED,
    kind_of,
    parse_datetime,
    parse_number,
    present,
    trim_text,
)
from .cells import quoted
from .names import resolve_column
from .types import CellCounts, count_cells

FILTER_SHARE = 0.6  # a text column counts as numbers or dates above this share of all rows

# Names of operators that are accepted next to the short ones.
OP_ALIASES = {
    "greater_than": ">", "gt": ">",
    "greater_than_or_equal": ">=", "greater_or_equal": ">=", "gte": ">=",
    "less_than": "<", "lt": "<",
    "less_than_or_equal": "<=", "less_or_equal": "<=", "lte": "<=",
    "equals": "==", "equal": "==", "eq": "==", "=": "==",
    "not_equals": "!=", "not_equal": "!=", "ne": "!=",
}


@dataclass(frozen=True)
class Rule:
    column: str
    op: str
    value: Any = None
    low: Any = None
    high: Any = None
    regex: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class FilterPlan:
    """The compiled filter: predicates in order and the rules that could not be used."""

    predicates: Sequence[Column]
    ignored: Sequence[tuple[str, str]]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, self.predicates)) if self.predicates else df


# ---- reading operands ---------------------------------------------------------------------------


def _number(value: Any) -> int | float | None:
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return value if math.isfinite(value) else None
    if isinstance(value, str) and re.match(NUMBER_PATTERN, value):
        number = float(value)
        if not math.isfinite(number):
            return None
        return int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else number
    return None


def _instant(value: Any) -> datetime | None:
    if isinstance(value, datetime):
        parsed = value
    elif isinstance(value, date):
        parsed = datetime(value.year, value.month, value.day)
    elif isinstance(value, str):
        parsed = _read_instant(value.strip())
    else:
        parsed = None
    if parsed is not None and parsed.tzinfo is not None:
        parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
    return parsed


def _read_instant(text: str) -> datetime | None:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        pass
    for layout in (
        "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M %p",
        "%m-%d-%Y", "%d-%m-%Y", "%m.%d.%Y", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
    ):
        try:
            return datetime.strptime(text, layout)
        except ValueError:
            continue
    return None


def _flag(value: Any) -> bool | None:
    word = str(value).strip().lower()
    if word in TRUE_TOKENS_EXTENDED:
        return True
    return False if word in FALSE_TOKENS_EXTENDED else None


def _blank(value: Any) -> bool:
    return value is None or (isinstance(value, str) and not value.strip())


# ---- comparisons --------------------------------------------------------------------------------


def _compare_number(col: Column, data_type: T.DataType, op: str, number: int | float) -> Column:
    """A comparison whose literal has the column's own type whenever that changes nothing."""
    if isinstance(data_type, INTEGRAL_TYPES) and not float(number).is_integer():
        # x > 5.5 is x >= 6 for whole numbers, and so on.
        below, above = math.floor(number), math.ceil(number)
        return {
            ">": col >= above,
            ">=": col >= above,
            "<": col <= below,
            "<=": col <= below,
            "==": F.lit(False),
            "!=": col.isNotNull(),
        }[op]
    if isinstance(data_type, INTEGRAL_TYPES):
        literal = F.lit(int(number))
    else:
        literal = F.lit(float(number))
    test = _compare(col, op, literal)
    if isinstance(data_type, (T.DoubleType, T.FloatType)) and op in (">", ">=", "!="):
        return test & ~F.isnan(col)  # NaN is missing, though it sorts above all numbers
    return test


def _compare(col: Column, op: str, literal: Column) -> Column:
    return {
        ">": lambda: col > literal,
        ">=": lambda: col >= literal,
        "<": lambda: col < literal,
        "<=": lambda: col <= literal,
        "==": lambda: col == literal,
        "!=": lambda: col != literal,
    }[op]()


def _instant_literal(value: datetime, data_type: T.DataType) -> Column:
    text = F.lit(value.isoformat(sep=" "))
    if isinstance(data_type, T.TimestampType):
        return text.cast("timestamp")
    return text.cast("timestamp_ntz")


def _number_rule(col: Column, dtype: T.DataType, rule: Rule) -> Column | str:
    if rule.op in (">", ">=", "<", "<="):
        number = _number(rule.value)
        return "operand is not a number" if number is None else _compare_number(col, dtype, rule.op, number)
    if rule.op in ("==", "!="):
        number = _number(rule.value)
        return F.lit(False) if number is None else _compare_number(col, dtype, rule.op, number)
    if rule.op == "between":
        low, high = _number(rule.low), _number(rule.high)
        if low is None or high is None:
            return F.lit(False)
        return _compare_number(col, dtype, ">=", low) & _compare_number(col, dtype, "<=", high)
    if rule.op == "not_in":
        numbers = [n for n in map(_number, _list(rule.value)) if n is not None]
        tests = [_compare_number(col, dtype, "!=", n) for n in numbers]
        return reduce(lambda a, b: a & b, tests, col.isNotNull())
    if rule.op == "in":
        numbers = [n for n in map(_number, _list(rule.value)) if n is not None]
        return reduce(lambda a, b: a | b, [_compare_number(col, dtype, "==", n) for n in numbers], F.lit(False))
    if rule.op in ("contains", "starts_with", "ends_with"):
        return _text_rule(_written(present(col, dtype), dtype), rule)
    return f"operator '{rule.op}' does not apply to numbers"


def _written(col: Column, dtype: T.DataType) -> Column:
    """A number as people write it: whole ones without a fraction."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.cast("string")
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def _instant_rule(col: Column, dtype: T.DataType, rule: Rule) -> Column | str:
    if rule.op in ("range", "between"):
        tests = []
        for op, bound in ((">=", rule.low), ("<=", rule.high)):
            if _blank(bound):
                continue
            moment = _instant(bound)
            if moment is None:
                return F.lit(False)
            tests.append(_compare(col, op, _instant_literal(moment, dtype)))
        return reduce(lambda a, b: a & b, tests, col.isNotNull())
    if rule.op in (">", ">=", "<", "<=", "==", "!="):
        moment = _instant(rule.value)
        if moment is None:
            return F.lit(False) if rule.op in ("==", "!=") else "operand is not a date"
        return _compare(col, rule.op, _instant_literal(moment, dtype))
    return f"operator '{rule.op}' does not apply to dates"


def _bool_rule(col: Column, rule: Rule) -> Column:
    wanted = _flag(rule.value)
    if wanted is None:
        return F.lit(False)
    return col == F.lit(not wanted if rule.op == "!=" else wanted)


def _text_rule(col: Column, rule: Rule) -> Column | str:
    cell = trim_text(col)
    value = "" if rule.value is None else str(rule.value)
    if rule.op in ("==", "!="):
        same = F.lower(cell) == F.lit(value.lower())
        return same if rule.op == "==" else ~same
    if rule.op == "contains":
        if rule.regex:
            return cell.rlike("(?i)" + value) if _is_pattern("(?i)" + value) else f"'{value}' is not a pattern"
        return F.contains(F.lower(cell), F.lit(value.lower()))
    if rule.op in ("starts_with", "ends_with"):
        test = F.startswith if rule.op == "starts_with" else F.endswith
        if rule.ignore_case:
            return test(F.lower(cell), F.lit(value.lower()))
        return test(cell, F.lit(value))
    if rule.op in ("in", "not_in"):
        member = F.lower(cell).isin([str(v).lower() for v in _list(rule.value)])
        return member if rule.op == "in" else ~member
    return f"operator '{rule.op}' does not apply to text"


def _is_pattern(text: str) -> bool:
    """Whether the engine can compile a pattern; asked while rules are compiled, as a job would end with it."""
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return False
    return True


def _list(value: Any) -> list:
    if value is None:
        return []
    if isinstance(value, str):
        return [part.strip() for part in value.split(",")]
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


# ---- reading the specification ------------------------------------------------------------------


def _as_rule(column: str, raw: Any, regex: bool, ignore_case: bool) -> Rule | None:
    if not isinstance(raw, Mapping):
        return Rule(column, "==", raw) if isinstance(raw, (str, int, float, bool, date)) else None
    op = raw.get("op", raw.get("operator"))
    if not isinstance(op, str):
        return None
    first = lambda *keys: next((raw[k] for k in keys if raw.get(k) is not None), None)
    return Rule(
        column,
        OP_ALIASES.get(op, op),
        raw.get("value"),
        first("min", "start"),
        first("max", "end"),
        bool(raw.get("regex", regex)),
        bool(raw.get("ignore_case", ignore_case)),
    )


def _entries(spec: Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> list[tuple[str, Any]]:
    """(key, rule) pairs from the dictionary form or the list form; a key may hold several rules."""
    if isinstance(spec, Mapping):
        pairs = list(spec.items())
    else:
        pairs = [(entry.get("column", ""), entry) for entry in spec]
    flat = []
    for key, raw in pairs:
        flat += [(key, one) for one in raw] if isinstance(raw, (list, tuple)) else [(key, raw)]
    meta_order = {"_textSearch": 0, "_dateRange": 1, "_numericRange": 2}
    return sorted(flat, key=lambda pair: meta_order.get(pair[0], 3))


def compile_filters(
    df: DataFrame,
    spec: Mapping[str, Any] | Sequence[Mapping[str, Any]] | None,
    *,
    regex: bool = False,
    ignore_case: bool = False,
) -> FilterPlan:
    """Turn rules into predicates. Runs at most one aggregate, over text columns the rules touch."""
    if not spec:
        return FilterPlan((), ())
    entries = _entries(spec)
    ignored: list[tuple[str, str]] = []
    column_rules: list[Rule] = []
    metas: list[tuple[str, Mapping[str, Any]]] = []
    for key, raw in entries:
        if key.startswith("_"):
            if isinstance(raw, Mapping):
                metas.append((key, raw))
            else:
                ignored.append((key, "rule is not a mapping"))
            continue
        rule = _as_rule(key, raw, regex, ignore_case)
        column = resolve_column(df.columns, key) if key.strip() else None
        if rule is None:
            ignored.append((key, "rule is not readable"))
        elif column is None:
            ignored.append((key, "no such column"))
        else:
            column_rules.append(Rule(column, *[getattr(rule, n) for n in
                                               ("op", "value", "low", "high", "regex", "ignore_case")]))

    kinds = _kinds(df, {rule.column for rule in column_rules}, {key for key, _ in metas})
    predicates = []
    for key, raw in metas:
        test = _meta_rule(df, key, raw, kinds)
        if isinstance(test, str):
            ignored.append((key, test))
        else:
            predicates.append(test)
    for rule in column_rules:
        test = _column_rule(df, rule, kinds)
        if isinstance(test, str):
            ignored.append((rule.column, test))
        else:
            predicates.append(test)
    return FilterPlan(tuple(predicates), tuple(ignored))


def apply_filters(df: DataFrame, spec, *, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Rows that satisfy all rules; unknown columns and operators are ignored."""
    return compile_filters(df, spec, regex=regex, ignore_case=ignore_case).apply(df)


def filter_by_date_range(df: DataFrame, start: Any, end: Any) -> DataFrame:
    return apply_filters(df, {"_dateRange": {"op": "range", "start": start, "end": end}})


def _kinds(df: DataFrame, rule_columns: set[str], metas: set[str]) -> dict[str, tuple[str, str | None]]:
    """Kind and date layout per column: by schema, by content for the text columns that matter."""
    kinds = {f.name: (kind_of(f.dataType), None) for f in df.schema}
    probe = {c for c in rule_columns if kinds[c][0] == "text"}
    for meta, kind in (("_dateRange", "datetime"), ("_numericRange", "numeric")):
        if meta in metas:
            # Text columns ahead of the first column that has the type already.
            for name in df.columns:
                if kinds[name][0] == kind:
                    break
                if kinds[name][0] == "text":
                    probe.add(name)
    if probe:
        counts = count_cells(df, sorted(probe), ())
        for name in probe:
            kinds[name] = _content_kind(counts[name])
    return kinds


def _content_kind(counts: CellCounts) -> tuple[str, str | None]:
    if counts.numbers > counts.rows * FILTER_SHARE:
        return "numeric", None
    for layout, read in counts.dates.items():
        if read > counts.rows * FILTER_SHARE:
            return "datetime", layout
    return "text", None


def _read(df: DataFrame, name: str, kinds) -> tuple[Column, T.DataType, str]:
    """The column as its kind, with the type that literals should have."""
    col, dtype, (kind, layout) = quoted(name), df.schema[name].dataType, kinds[name]
    if kind_of(dtype) == "text" and kind == "numeric":
        return parse_number(col), T.DoubleType(), kind
    if kind_of(dtype) == "text" and kind == "datetime":
        return parse_datetime(trim_text(col), layout), T.TimestampNTZType(), kind
    return col, dtype, kind


def _column_rule(df: DataFrame, rule: Rule, kinds) -> Column | str:
    col, dtype, kind = _read(df, rule.column, kinds)
    if kind == "numeric":
        return _number_rule(col, dtype, rule)
    if kind == "datetime":
        return _instant_rule(col, dtype, rule)
    if kind == "boolean":
        return _bool_rule(col, rule)
    return _text_rule(col.cast("string") if kind == "text" else F.to_json(col), rule)


def _meta_rule(df: DataFrame, key: str, raw: Mapping[str, Any], kinds) -> Column | str:
    op = raw.get("op")
    if key == "_textSearch":
        if op != "contains":
            return f"operator '{op}' does not apply"
        value = str(raw.get("value") or "").lower().strip()
        if not value:
            return "nothing to search for"
        return reduce(lambda a, b: a | b, [F.contains(_search_text(f), F.lit(value)) for f in df.schema])
    if key in ("_dateRange", "_numericRange"):
        is_date = key == "_dateRange"
        if op not in (("range", "between") if is_date else ("between",)):
            return f"operator '{op}' does not apply"
        read = _instant if is_date else _number
        low_raw, high_raw = (raw.get("start"), raw.get("end")) if is_date else (raw.get("min"), raw.get("max"))
        low, high = read(low_raw), read(high_raw)
        if (low is None and not _blank(low_raw)) or (high is None and not _blank(high_raw)):
            return "bound is not readable"
        if low is None and high is None:
            return "no bounds"
        wanted = "datetime" if is_date else "numeric"
        name = next((c for c in df.columns if kinds[c][0] == wanted), None)
        if name is None:
            return f"no {wanted} column"
        col, dtype, _ = _read(df, name, kinds)
        rule = Rule(name, "range" if is_date else "between", low=low, high=high)
        if is_date:
            return _instant_rule(col, dtype, rule)
        tests = [
            _compare_number(col, dtype, op, bound)
            for op, bound in ((">=", low), ("<=", high))
            if bound is not None
        ]
        return reduce(lambda a, b: a & b, tests)
    return "unknown filter"


def _search_text(f: T.StructField) -> Column:
    col = quoted(f.name)
    text = F.to_json(col) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col.cast("string")
    return F.lower(text)
