import math
import random
import re
import string
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from sparkprep import (
    coerce_numeric, conversion_errors, detect_column_types, drop_empty_rows, enforce_types, fit_types,
    normalize_nulls, normalize_types, standardize_columns, trim_cells, validate_ranges,
)
from sparkprep.functions import parse_bool, parse_datetime, parse_integer, parse_number
from sparkprep.functions.parsing import ALL_FORMATS, DATE_FORMATS, FALLBACK_FORMATS
from sparkprep.operators.names import standard_names
from sparkprep.operators.types import apply_types
from sparkprep.operators.validate import type_ok


def column(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def values(df, name="v"):
    return [r[name] for r in df.collect()]


def test_names():
    assert standard_names(["Name", "NAME", "name"]) == ["name", "name_1", "name_2"]
    assert standard_names(["Name@Email", "Phone#", "Add-ress-"]) == ["name_email", "phone", "add_ress"]
    assert standard_names(["", "@@", " A  b "]) == ["column", "column_1", "a_b"]
    assert standard_names(["a", "A", "a_1"]) == ["a", "a_2", "a_1"]
    assert standard_names(["A__b", "@"], dedupe=False) == ["a__b", ""]


def test_names_of_empty_table(spark):
    df = spark.createDataFrame([], "`First Name` string, `first-name` string")
    assert standardize_columns(df).columns == ["first_name", "first_name_1"]


@pytest.mark.parametrize(
    "text, number",
    [("25", 25.0), (" 25 ", 25.0), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("1e5", 1e5), ("-2.5E-3", -0.0025)]
    + [(bad, None) for bad in ("1,000", "1_000", "$5", "5%", "1d", "1.0f", "0x1", "", "inf", "NaN", "1e999", "1 2")],
)
def test_parse_number(spark, text, number):
    assert values(column(spark, [text]).select(parse_number(F.col("v")).alias("v"))) == [number]


def test_parse_integer_keeps_large_numbers(spark):
    df = column(spark, ["9007199254740993", " 7 ", "2.0", "2.5", "99999999999999999999", "x", None])
    assert values(df.select(parse_integer(F.col("v")).alias("v"))) == [9007199254740993, 7, 2, None, None, None, None]


def test_parse_bool(spark):
    df = column(spark, [" TRUE ", "no", "1", "0", "y", "F", "x", None])
    assert values(df.select(parse_bool(F.col("v")).alias("v"))) == [True, False, True, False, None, None, None, None]
    assert values(df.select(parse_bool(F.col("v"), True).alias("v")))[4:] == [True, False, None, None]


@pytest.mark.parametrize(
    "layout, text, expected",
    [
        ("%Y-%m-%d", "2024-1-5", datetime(2024, 1, 5)),
        ("%Y-%m-%d", "2024-02-30", None),
        ("%Y-%m-%d", "2024-01-05 x", None),
        ("%Y-%m-%d", "24-01-05", None),
        ("%m/%d/%Y", "12/31/2024", datetime(2024, 12, 31)),
        ("%m/%d/%Y", "31/12/2024", None),
        ("%d/%m/%Y", "31/12/2024", datetime(2024, 12, 31)),
        ("%Y/%m/%d", "2024/3/9", datetime(2024, 3, 9)),
        ("%Y-%m-%d %H:%M:%S", "2024-01-05 3:04:05", datetime(2024, 1, 5, 3, 4, 5)),
        ("%m/%d/%Y %H:%M", "1/5/2024 13:04", datetime(2024, 1, 5, 13, 4)),
        ("iso", "2024-01-05T03:04:05.250", datetime(2024, 1, 5, 3, 4, 5, 250000)),
        ("iso utc", "2024-01-05T03:04:05Z", datetime(2024, 1, 5, 3, 4, 5)),
        ("%m/%d/%y", "1/5/68", datetime(2068, 1, 5)),
        ("%d/%m/%y", "31/12/69", datetime(1969, 12, 31)),
        ("%d/%m/%y", "30/02/24", None),
        ("%m-%d-%y", "1-2-10", None),
        ("%Y-%m", "2024-13", None),
        ("%b %Y", "Sept. 2024", datetime(2024, 9, 1)),
        ("%d %b %Y", "Tues, 5 Jan 2024 03:04:05 GMT", datetime(2024, 1, 5, 3, 4, 5)),
        ("%b %d %Y", "Friday, January 5, 2024", datetime(2024, 1, 5)),
        ("%d %b %y", "5-Jan-24", datetime(2024, 1, 5)),
    ],
)
def test_parse_datetime(spark, layout, text, expected):
    assert values(column(spark, [text]).select(parse_datetime(F.col("v"), layout).alias("v"))) == [expected]


# A cell for every layout, and one that has its signature but cannot be read.
LAYOUT_CELLS = {
    "%Y-%m-%d": "2024-1-25", "%m/%d/%Y": "1/25/2024", "%d/%m/%Y": "25/1/2024", "%Y/%m/%d": "2024/01/25",
    "%Y-%m-%d %H:%M:%S": "2024-01-25 3:04:05", "%m/%d/%Y %H:%M": "1/25/2024 13:04", "iso": "2024-01-25T03:04:05.25",
    "iso minutes": "2024-01-25T03:04", "iso utc": "2024-01-25 03:04:05+00:00", "%m/%d/%Y %H:%M:%S": "01/25/2024 03:04:05",
    "%Y/%m/%d %H:%M:%S": "2024/01/25 03:04:05", "iso offset": "2024-01-25T03:04:05.5 -0330",
    "%m/%d/%Y %I:%M %p": "1/25/2024 3:04 p.m.", "%m-%d-%Y": "01.25.2024", "%d-%m-%Y": "25-01-2024",
    "%m-%d-%Y time": "01-25-2024 03:04", "%d-%m-%Y time": "25.01.2024 03:04:05", "%d %b %Y": "Thursday, 25 January 2024 03:04",
    "%b %d %Y": "Thu. Jan. 25, 2024 03:04:05 UTC", "%m/%d/%y": "1/25/24", "%d/%m/%y": "25/1/24", "%m-%d-%y": "01-25-24",
    "%d-%m-%y": "25-01-24", "%d %b %y": "25 Jan 24", "%d/%m/%Y %H:%M:%S": "25/01/2024 03:04:05", "%Y/%m/%d %H:%M": "2024/01/25 03:04",
    "%Y.%m.%d": "2024.01.25", "%Y-%m": "2024-01", "%Y/%m": "2024/01", "%m/%Y": "1/2024", "%b %Y": "January 2024",
}


def test_every_layout_is_found_by_signature_and_by_shape(spark):
    assert set(LAYOUT_CELLS) == set(ALL_FORMATS)
    names = list(LAYOUT_CELLS)
    one = spark.createDataFrame([tuple(LAYOUT_CELLS.values())], ", ".join(f"c{i} string" for i in range(len(names))))
    read = normalize_types(one)
    assert {t for _, t in read.dtypes} == {"timestamp_ntz"}
    row = read.first()
    assert {(v.year, v.month) for v in row} == {(2024, 1)}
    assert all(v.day in (1, 25) for v in row)
    cells = one.select(F.explode(F.array(*one.columns)).alias("cell"))
    assert cells.where(~type_ok(F.col("cell"), T.StringType(), "datetime")).count() == 0


def test_cells_that_only_look_like_dates(spark):
    wrong = ["99/99/2024", "2024-13-45", "1.2.10", "10.20.30", "45 Foo 2024", "May contain nuts", "12 Main St", "2024-00", "3-4-5"]
    columns = ", ".join(f"c{i} string" for i in range(len(wrong)))
    assert {t for _, t in normalize_types(spark.createDataFrame([tuple(wrong)] * 3, columns)).dtypes} == {"string"}
    # Of a forced column even rare layouts are counted by what they read, not by how the cells look.
    cells = ["25/12/2024", "13/12/2024", "12/30/2024"] + ["word"] * 9
    typed, _ = enforce_types(column(spark, cells), {"v": "datetime"})
    assert values(typed)[:3] == [datetime(2024, 12, 25), datetime(2024, 12, 13), None]
    assert values(normalize_types(column(spark, ["25/12/2024"] * 8 + ["word"] * 2)))[0] == datetime(2024, 12, 25)
    empty = normalize_types(spark.createDataFrame([], "v string"))
    assert (empty.dtypes, empty.count()) == ([("v", "string")], 0)


def test_cells(spark):
    df = spark.createDataFrame([(" a ", None), ("", "null"), (None, None)], "x string, y string")
    assert [tuple(r) for r in trim_cells(df).collect()] == [("a", None), ("", "null"), (None, None)]
    assert [tuple(r) for r in normalize_nulls(df).collect()] == [(" a ", None), (None, None), (None, None)]
    assert drop_empty_rows(normalize_nulls(df)).count() == 1


def test_normalize_infers_types(spark):
    assert values(normalize_types(column(spark, ["25", "30", "35"]))) == [25, 30, 35]
    assert normalize_types(column(spark, ["25", None, "35.5", "4"])).dtypes == [("v", "double")]
    flags = normalize_types(column(spark, ["yes", "no", "1", "0", "true", "false"]))
    assert (flags.dtypes[0][1], values(flags)) == ("boolean", [True, False, True, False, True, False])
    nulls = normalize_types(column(spark, ["", " ", "null", "none", "nan", "na", "undefined", "word"]))
    assert (nulls.dtypes[0][1], values(nulls)) == ("string", [None] * 7 + ["word"])
    dates = normalize_types(column(spark, ["2024-01-01", "2024-01-02", "2024-01-03", "bad"]))
    assert (dates.dtypes[0][1], values(dates)[3]) == ("timestamp_ntz", None)
    # 70 % exactly is not enough.
    assert normalize_types(column(spark, ["1.5"] * 7 + ["x"] * 3)).dtypes[0][1] == "string"
    assert normalize_types(column(spark, ["31/12/2024"] * 8 + ["1/2/2024"] * 2)).collect()[9][0] == datetime(2024, 2, 1)


def test_detect(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "1", None), ("2", "2.5", "2", None), ("3", "3.5", "3", None), ("4", "4.5", "4", None), ("5", "5.5", "x", None)],
        "a string, b string, c string, d string",
    )
    assert detect_column_types(df) == {"a": "int", "b": "float", "c": "int", "d": "string"}
    assert detect_column_types(column(spark, ["t", "f", "y", "n", None])) == {"v": "bool"}
    assert detect_column_types(spark.range(3)) == {"id": "int"}


def test_enforce(spark):
    df = spark.createDataFrame(
        [("1", "Ann", "true", "9.5"), ("2", "Bob", "false", "8"), ("3", "Cid", "true", "7.25")],
        "id string, name string, active string, score string",
    )
    typed, report = enforce_types(df)
    assert [t for _, t in typed.dtypes] == ["bigint", "string", "boolean", "double"]
    assert report.where("error is null").count() == 4
    typed, report = enforce_types(column(spark, ["1", "2", None, "4", "5"]), {"v": "int"}, auto_detect=False)
    assert values(typed) == [1, 2, None, 4, 5]
    _, report = enforce_types(df, {"missing": "int"}, auto_detect=False)
    assert report.where("error is not null").count() == 1
    same, report = enforce_types(column(spark, ["1.5", "2"]), {"v": "int"}, auto_detect=False)
    assert (values(same), report.collect()[0]["error"] is not None) == (["1.5", "2"], True)
    typed, _ = enforce_types(spark.createDataFrame([(1.0,), (2.5,)], "v double"), {"v": "string"})
    assert values(typed) == ["1.0", "2.5"]


def test_one_plan_equals_two_steps(spark):
    """Deciding normalisation and enforcement from one aggregate gives what two passes give."""
    rng = random.Random(5)
    words = ["1", "0", "t", "f", "yes", "no", "2.5", "7", "x", "n/a", "", None, "2024-01-02", "3/4/2024", "true", " 2024-05-06 "]
    for _ in range(12):
        picked = rng.sample(words, 4)
        cells = [rng.choices(picked, weights=[8, 2, 1, 1])[0] for _ in range(20)]
        df = column(spark, cells)
        fused = apply_types(df, fit_types(df))
        stepped, _ = enforce_types(normalize_types(df))
        assert (fused.dtypes, values(fused)) == (stepped.dtypes, values(stepped)), cells


def test_conversion_errors(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(9)] + [(9, "abc"), (10, "null")], "_row_id long, v string")
    plan = fit_types(df.drop("_row_id"))
    assert [tuple(r) for r in conversion_errors(df, plan).collect()] == [(9, "v", "abc", "int")]


def test_coerce(spark):
    df = spark.createDataFrame([("1", "1", "1.5"), ("2", "x", None)], "a string, b string, c string")
    assert [t for _, t in coerce_numeric(df).dtypes] == ["bigint", "string", "double"]


def test_ranges(spark):
    df = spark.createDataFrame([(25, 85), (150, 90), (-5, 110), (30, 95), (None, 70)], "age int, score int")
    rules = {"age": {"min": 0, "max": 120}, "score": {"max": 100}, "nothing": {"min": 1}}
    flagged, found = validate_ranges(df, rules)
    assert flagged.count() == 5
    assert sorted((r["column"], r["rule"], r["violations_count"]) for r in found.collect()) == [
        ("age", "max", 1), ("age", "min", 1), ("score", "max", 1),
    ]
    dropped, found = validate_ranges(df, {c: {**r, "action": "drop"} for c, r in rules.items()})
    assert sorted(r["age"] or 0 for r in dropped.collect()) == [0, 25, 30]
    # The row below the age minimum is gone before scores are counted.
    assert {r["column"] for r in found.collect()} == {"age"}
    clipped, _ = validate_ranges(df, {"age": {"min": 0, "max": 120, "action": "clip"}})
    assert [r["age"] for r in clipped.collect()] == [25, 120, 0, 30, None]
    assert clipped.dtypes[0][1] == "int"


def test_number_pattern_matches_python(spark):
    """Random strings of number characters: accepted exactly when Python reads a finite number."""
    rng = random.Random(1)
    cells = ["".join(rng.choices("0123456789+-.eE ", k=rng.randint(1, 6))) for _ in range(3000)]

    def expected(cell):
        try:
            number = float(cell)
        except ValueError:
            return None
        return number if math.isfinite(number) else None

    got = values(column(spark, cells).select(parse_number(F.col("v")).alias("v")))
    assert got == [expected(c) for c in cells]


def test_trim_is_pythons_strip(spark):
    cells = [w + "a b" + w for w in map(chr, range(0x3001)) if w.isspace()] + [c + "x" for c in string.whitespace]
    assert values(trim_cells(column(spark, cells))) == [c.strip() for c in cells]


def test_first_row_types(spark):
    from sparkprep.operators.types import first_row_types

    rows = [(1, "01/02/2024", "1/2/24", "1", True, None, "x"), (2, "y", "y", "2024-01-01", False, 1.5, "2024-01-01")]
    df = spark.createDataFrame(rows, "n long, d string, short string, one string, b boolean, gone double, t string").coalesce(1)
    want = {"n": "numeric", "d": "datetime", "short": "text", "one": "text", "b": "boolean", "gone": "text", "t": "text"}
    assert first_row_types(df.orderBy("n")) == want
    assert set(first_row_types(df.where("false")).values()) == {"text"}


def test_a_layout_searches_each_cell_once(spark):
    """Parts used twice were searched for again at every use, up to dozens of times a cell."""
    for layout in DATE_FORMATS + FALLBACK_FORMATS:
        searches = re.findall("rlike|regexp_", str(parse_datetime(F.col("cell"), layout)).lower())
        assert 1 <= len(searches) <= 4, layout.name


def test_parts_of_dates_are_put_together(spark):
    cells = [
        ("%m/%d/%Y %I:%M %p", "01/02/2024 12:05 AM", "2024-01-02 00:05:00"),
        ("%m/%d/%Y %I:%M %p", "01/02/2024T1:05 p.m.", "2024-01-02 13:05:00"),
        ("%m/%d/%Y %I:%M %p", "01/02/2024 13:05 pm", "2024-01-02 13:05:00"),
        ("%m/%d/%Y %I:%M %p", "1/2/2024 PM", "2024-01-02 12:00:00"),
        ("iso offset", "2024-01-02 03:04-0530", "2024-01-02 08:34:00"),
        ("iso offset", "2024-01-02T03:04:05+00:30", "2024-01-02 02:34:05"),
        ("%d %b %Y", "Saturday, 3 Sept. 2022 10:11 GMT", "2022-09-03 10:11:00"),
        ("%d %b %y", "mon 5-Feb-69\n", "1969-02-05 00:00:00"),
        ("%b %Y", "May, 2024", "2024-05-01 00:00:00"),
        ("%m/%d/%y", "02/30/24", None), ("%d %b %Y", "#", None), ("%m/%Y", "--", None), ("%Y-%m", "2024-01-02", None),
    ]
    for name, cell, want in cells:
        df = spark.createDataFrame([(cell,)], "cell string")
        got = df.select(parse_datetime(F.col("cell"), name).cast("string")).first()[0]
        assert got == want, (name, cell)
