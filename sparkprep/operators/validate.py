"""Schema validation with row-level errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.parsing import (
    DATE_FORMATS,
    FALLBACK_FORMATS,
    date_shape,
    kind_of,
    parse_datetime,
    parse_number,
    present as without_nan,
    trim_text,
)
from .cells import quoted
from .missing import MissingAnalysis, analyze_missing
from .rowid import ROW_ID, with_row_id

ERRORS = "_errors"
ERROR_TYPE = "array<struct<column:string,rule:string,message:string,value:string>>"
# Names for values of each kind in messages.
KIND_NAMES = {"numeric": "number", "boolean": "boolean", "datetime": "datetime", "text": "string"}


def type_ok(col: Column, data_type: T.DataType, expected: str) -> Column:
    """Whether each cell fits the expected type; missing cells and unknown types pass."""
    kind = kind_of(data_type)
    good, bad = F.lit(True), col.isNull()
    if expected == "string":
        return good if kind == "text" else bad
    if expected == "number":
        if kind == "text":
            return col.isNull() | parse_number(col).isNotNull()
        return good if kind in ("numeric", "boolean") else bad
    if expected == "boolean":
        return good if kind == "boolean" else bad
    if expected == "datetime":
        if kind == "text":
            return col.isNull() | _reads_as_date(col)
        return good if kind in ("datetime", "numeric") else bad
    return good


def _reads_as_date(col: Column) -> Column:
    """Whether any layout reads the cell; the trimmed cell and its shape are computed once for all."""
    shaped = F.transform(F.array(trim_text(col)), lambda c: F.struct(c.alias("cell"), date_shape(c).alias("shape")))
    readings = lambda s: F.coalesce(
        *[
            F.when(s["shape"] == layout.shape, parse_datetime(s["cell"], layout))
            for layout in DATE_FORMATS + FALLBACK_FORMATS
        ]
    )
    return F.coalesce(F.exists(shaped, lambda s: readings(s).isNotNull()), F.lit(False))


def error_array(df: DataFrame, schema: Mapping[str, Mapping[str, Any]]) -> Column:
    """The rules each row breaks, in rule order. Row-local, so it works on streams as well."""
    fields = {f.name: f.dataType for f in df.schema}
    found: list[Column] = []
    for name, rules in schema.items():
        present = name in fields
        data_type = fields.get(name, T.StringType())
        col = without_nan(quoted(name), data_type) if present else F.lit(None).cast("string")
        value = col.cast("string") if kind_of(data_type) != "other" else F.to_json(col)
        if rules.get("required"):
            found.append(_error(col.isNull(), name, "required", f"'{name}' is required but has no value", value))
        expected = rules.get("type")
        if not present or not expected:
            continue
        fits = type_ok(col, data_type, expected)
        got = KIND_NAMES.get(kind_of(data_type), data_type.simpleString())
        found.append(_error(~fits, name, "type", f"'{name}' holds {got} where {expected} is wanted", value))
        if expected == "number" and (rules.get("min") is not None or rules.get("max") is not None):
            number = parse_number(col) if kind_of(data_type) == "text" else col.cast("double")
            found.append(_bound_errors(F.when(fits, number), name, rules, value))
    if not found:
        return F.lit(None).cast(ERROR_TYPE)
    return F.array_compact(F.flatten(F.array(*found))).cast(ERROR_TYPE)


def _bound_errors(number: Column, name: str, rules: Mapping[str, Any], value: Column) -> Column:
    """Errors against both bounds; ``transform`` binds the number once for them."""
    tests = []
    for rule, side in (("min", "below"), ("max", "above")):
        if rules.get(rule) is not None:
            tests.append((rule, f"'{name}' is {side} its {rule} of {rules[rule]}", float(rules[rule])))

    def check(n: Column) -> Column:
        hits = [(n < F.lit(bound)) if rule == "min" else (n > F.lit(bound)) for rule, _, bound in tests]
        return F.array(
            *[_error_struct(hit, name, rule, message, value) for hit, (rule, message, _) in zip(hits, tests)]
        )

    return F.transform(F.array(number), check)[0]


def _error(test: Column, name: str, rule: str, message: str, value: Column) -> Column:
    return F.array(_error_struct(test, name, rule, message, value))


def _error_struct(test: Column, name: str, rule: str, message: str, value: Column) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(name).alias("column"),
            F.lit(rule).alias("rule"),
            F.lit(message).alias("message"),
            value.alias("value"),
        ),
    )


def validate_schema(df: DataFrame, schema: Mapping[str, Mapping[str, Any]] | None) -> bool:
    """Whether every row passes; stops at the first row that does not."""
    if not schema:
        return True
    return df.where(F.size(error_array(df, schema)) > 0).select(F.lit(1)).isEmpty()


def validation_errors(
    df: DataFrame, schema: Mapping[str, Mapping[str, Any]], row_id: str | Sequence[str] | None = None
) -> DataFrame:
    """One row per broken rule: row, column, rule, message, value.

    ``row_id`` names the column (or columns) that identify a row; by default the 0-based position.
    """
    if row_id is None and ROW_ID not in df.columns:
        df = with_row_id(df)
    ids = [ROW_ID] if row_id is None else [row_id] if isinstance(row_id, str) else list(row_id)
    keys = [quoted(ids[0]).alias("row")] if len(ids) == 1 else [quoted(i) for i in ids]
    return df.select(*keys, F.inline(error_array(df, schema)))


def split_valid(df: DataFrame, schema: Mapping[str, Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the rules they break in ``_errors``."""
    checked = df.withColumn(ERRORS, F.coalesce(error_array(df, schema), F.array().cast(ERROR_TYPE)))
    return checked.where(F.size(ERRORS) == 0).drop(ERRORS), checked.where(F.size(ERRORS) > 0)


ISSUE_SCHEMA = "column string, issue string, missing_count long, percentage double, message string"


def quality_issue_rows(found: MissingAnalysis) -> list[tuple]:
    rows = []
    for name in found.affected:
        count = found.counts[name]
        share = round(100 * count / found.rows, 1)
        rows.append((name, "missing", count, share, f"Column '{name}': {count} missing values ({share:.1f}%)"))
    rows += [
        (name, "empty", found.rows, 100.0, f"Column '{name}': All values are missing")
        for name in found.affected
        if found.counts[name] == found.rows
    ]
    return rows


def quality_issues(df: DataFrame, analysis: MissingAnalysis | None = None) -> DataFrame:
    """Columns with missing cells, and a second entry for columns that are entirely missing."""
    found = analysis or analyze_missing(df)
    return df.sparkSession.createDataFrame(quality_issue_rows(found), ISSUE_SCHEMA)
