import pytest

from sparkprep import apply_filters, compile_filters, filter_by_date_range, resolve_column


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("John Doe", "New York", "active", "30"),
            ("Jane Roe", "Boston", "inactive", "25"),
            ("John Smith", "New York", "active", "22"),
            ("Bob Johnson", "Chicago", "active", "45"),
            (None, "New York", "active", "60"),
        ],
        "name string, city string, status string, age string",
    )


def names(df):
    return sorted(r["name"] or "" for r in df.collect())


def test_resolve():
    columns = ["page", "Age", "First Name"]
    assert resolve_column(columns, " age ") == "Age"
    assert resolve_column(columns, "name") == "First Name"
    assert resolve_column(columns, "user_age_group") == "Age"
    assert resolve_column(columns, "zip") is None


def test_three_rules(people):
    spec = {
        "age": {"op": ">=", "value": "30"},
        "city": {"op": "equals", "value": "new york"},
        "_textSearch": {"op": "contains", "value": "John"},
    }
    assert names(apply_filters(people, spec)) == ["John Doe"]


@pytest.mark.parametrize(
    "rule, expected",
    [
        ({"op": ">", "value": "25"}, 3),
        ({"op": ">=", "value": 25}, 4),
        ({"op": "<", "value": "25.5"}, 2),
        ({"op": "<=", "value": "22"}, 1),
        ({"op": "equals", "value": "45"}, 1),
        ({"op": "between", "min": "25", "max": "45"}, 3),
        ({"op": "between", "min": "x", "max": "45"}, 0),
        ({"op": ">", "value": "x"}, 5),
        ({"op": "equals", "value": "x"}, 0),
        ({"op": "no_such_op", "value": "x"}, 5),
        ({"operator": "greater_than", "value": 25}, 3),
        (45, 1),
        ([{"op": ">", "value": 22}, {"op": "<", "value": 45}], 2),
    ],
)
def test_numeric_text(people, rule, expected):
    assert apply_filters(people, {"age": rule}).count() == expected


@pytest.mark.parametrize(
    "rule, expected",
    [
        ({"op": "contains", "value": "JOHN"}, 3),
        ({"op": "contains", "value": "j.h"}, 0),
        ({"op": "contains", "value": "j.h", "regex": True}, 3),
        ({"op": "starts_with", "value": "John"}, 2),
        ({"op": "starts_with", "value": "john"}, 0),
        ({"op": "starts_with", "value": "john", "ignore_case": True}, 2),
        ({"op": "ends_with", "value": "son"}, 1),
        ({"op": "in", "value": ["john doe", "JANE ROE"]}, 2),
        ({"op": "in", "value": "john doe, bob johnson"}, 2),
        ({"op": "not_in", "value": ["john doe"]}, 3),
        ({"op": "!=", "value": "john doe"}, 3),
        ("John Doe", 1),
    ],
)
def test_text(people, rule, expected):
    assert apply_filters(people, {"name": rule}).count() == expected


def test_missing_never_matches(people):
    assert apply_filters(people, {"name": {"op": "!=", "value": "x"}}).count() == 4


def test_search(people):
    search = lambda v: apply_filters(people, {"_textSearch": {"op": "contains", "value": v}}).count()
    assert (search("ACTIVE"), search("bos"), search("  "), search("zzz")) == (5, 1, 5, 0)


def test_typed_columns(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (1, 1.5D, true, timestamp_ntz'2024-01-01', date'2024-01-01'),
          (2, 2.5D, false, timestamp_ntz'2024-01-02', date'2024-01-02'), (NULL, NULL, NULL, NULL, NULL)
        t(n, x, b, ts, d)""")
    count = lambda spec: apply_filters(df, spec).count()
    assert count({"n": {"op": ">", "value": "1.5"}}) == 1
    assert count({"n": {"op": "==", "value": "1.5"}}) == 0
    assert count({"n": {"op": "!=", "value": "1.5"}}) == 2
    assert count({"b": {"op": "equals", "value": "false"}}) == 1
    assert count({"b": {"op": "anything", "value": "yes"}}) == 1
    assert count({"ts": {"op": "range", "start": "2024-01-01", "end": "2024-01-01"}}) == 1
    assert count({"ts": {"op": "range", "start": "", "end": None}}) == 2
    assert count({"ts": {"op": "range", "start": "bad", "end": "2024-01-05"}}) == 0
    assert count({"ts": {"op": "equals", "value": "01/02/2024"}}) == 1
    assert count({"ts": {"op": ">", "value": "bad"}}) == 3
    assert count({"d": {"op": ">=", "value": "2024-01-02T00:00:00Z"}}) == 1
    assert count({"_numericRange": {"op": "between", "min": 2}}) == 1
    assert count({"_numericRange": {"op": "between", "min": "x", "max": 9}}) == 3
    assert filter_by_date_range(df, "2024-01-02", "2024-02-01").count() == 1
    assert filter_by_date_range(df, "nonsense", "2024-02-01").count() == 3


def test_dates_in_text(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01"), ("c", "x")], "k string, day string")
    assert apply_filters(df, {"day": {"op": "range", "start": "2024-01-15"}}).count() == 1
    assert filter_by_date_range(df, "2024-01-01", "2024-01-31").count() == 1


def test_ignored_rules_are_reported(people):
    spec = {"zip": {"op": ">", "value": 1}, "_other": {"op": "x"}, "age": {"op": "like", "value": 1}, "city": None}
    plan = compile_filters(people, spec)
    assert sorted(k for k, _ in plan.ignored) == ["_other", "age", "city", "zip"]
    assert plan.apply(people).count() == 5
    assert apply_filters(people, {}).count() == apply_filters(people, None).count() == 5


def test_predicates_reach_the_scan(spark, tmp_path, capsys):
    """Typed comparisons are pushed into the Parquet scan and unused columns are not read."""
    spark.range(100).selectExpr("id", "id * 1.5D AS x", "'t' AS s", "timestamp_ntz'2024-01-01' AS ts").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spec = {"id": {"op": ">", "value": "10.5"}, "x": {"op": "<=", "value": 90}, "ts": {"op": "range", "start": "2023-01-01"}}
    apply_filters(df, spec).select("id").explain("formatted")
    plan = capsys.readouterr().out
    for pushed in ("GreaterThanOrEqual(id,11)", "LessThanOrEqual(x,90.0)", "GreaterThanOrEqual(ts,"):
        assert pushed in plan
    assert "s:string" not in plan


def test_malformed_pattern_is_ignored_and_reported(spark):
    df = spark.createDataFrame([("a(b",), ("cd",)], "name string")
    plan = compile_filters(df, {"name": {"op": "contains", "value": "a(b", "regex": True}})
    assert plan.ignored == (("name", "'a(b' is not a pattern"),)
    assert plan.apply(df).count() == 2
    assert apply_filters(df, {"name": {"op": "contains", "value": r"a\(b", "regex": True}}).count() == 1
