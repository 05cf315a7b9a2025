import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep import analyze_missing, handle_missing, missing_report, missing_summary
from sparkprep.operators import fills
from sparkprep.operators.fills import fill_ordered
from sparkprep.operators.quantiles import exact_modes, exact_quantiles
from sparkprep.operators import quantiles


def numbers(spark, cells, name="value"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"_row_id long, {name} double")


def filled(df, name="value"):
    return [r[name] for r in df.orderBy("_row_id").collect()]


def test_analysis_and_recommendations(spark):
    df = spark.createDataFrame(
        [(1.0, None, "a"), (2.0, None, "b"), (None, None, "c"), (4.0, None, "d"), (5.0, None, "e")],
        "col1 double, col2 string, col3 string",
    )
    found = analyze_missing(df)
    assert (found.total, found.percentage, found.column_percentage("col2")) == (6, 40.0, 100.0)
    assert found.recommendations == {"col1": "fill_median", "col2": "drop_columns"}
    assert {r["column"]: r["missing_count"] for r in missing_report(df).collect()} == {"col1": 1, "col2": 5}
    lines = missing_summary(df).orderBy("position").collect()
    assert [(r["level"], r["column"]) for r in lines] == [("table", None), ("column", "col2"), ("column", "col1")]


def test_recommendation_by_type(spark):
    df = spark.sql("SELECT * FROM VALUES (1, true, timestamp_ntz'2024-01-01', 'x'), (2, true, timestamp_ntz'2024-01-02', 'y'), (NULL, NULL, NULL, NULL) t(n, b, d, s)")
    assert analyze_missing(df).recommendations == {
        "n": "fill_median", "b": "fill_mode", "d": "fill_forward", "s": "fill_mode",
    }


@pytest.mark.parametrize(
    "strategy, cells, expected",
    [
        ("fill_mean", [10, 20, None, 40, 50], [10, 20, 30, 40, 50]),
        ("fill_median", [10, 20, None, 40, 50], [10, 20, 30, 40, 50]),
        ("fill_mode", [3, 2, 2, 3, None], [3, 2, 2, 3, 2]),
        ("fill_forward", [10, None, None, 40, None], [10, 10, 10, 40, 40]),
        ("fill_forward", [None, 2, None], [2, 2, 2]),
        ("fill_backward", [None, None, 30, None, 50], [30, 30, 30, 50, 50]),
        ("fill_backward", [1, None], [1, 1]),
        ("drop_rows", [10, None, 30, None, 50], [10, 30, 50]),
        ("drop", [10, None, 30, None, 50], [10, 30, 50]),
    ],
)
def test_strategies(spark, strategy, cells, expected):
    df = numbers(spark, [None if c is None else float(c) for c in cells])
    result, report = handle_missing(df, {"value": strategy})
    assert filled(result) == expected
    assert report.count() == 1


def test_value_flag_and_column_drop(spark):
    df = numbers(spark, [10.0, None, 30.0, None, 50.0])
    assert filled(handle_missing(df, {"value": "fill_value"}, fill_value=0)[0]) == [10, 0, 30, 0, 50]
    flagged = handle_missing(df, {"value": "flag"})[0]
    assert filled(flagged, "value_missing") == [False, True, False, True, False]
    assert handle_missing(df, {"value": "drop_columns"})[0].columns == ["_row_id"]
    with pytest.raises(ValueError):
        handle_missing(df, {"value": "guess"})


def test_text_falls_back_to_mode(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["A", "B", "A", None, "B", "A"])], "_row_id long, v string")
    for strategy in ("fill_mean", "fill_median", "fill_mode"):
        assert filled(handle_missing(df, {"v": strategy})[0], "v")[3] == "A"


def test_default_strategy_and_integers(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 2, 4), (2, None, 5)], "_row_id long, a int, b int")
    result, _ = handle_missing(df, {"b": "fill_median"})
    assert (filled(result, "a"), filled(result, "b")) == ([1.0, 2.0, 1.5], [4.5, 4.0, 5.0])
    assert dict(result.dtypes)["a"] == "double"
    whole, _ = handle_missing(df.withColumn("a", F.coalesce("a", F.lit(3))).drop("b"), {})
    assert dict(whole.dtypes)["a"] == "int"


def test_means_follow_dropped_rows(spark):
    df = spark.createDataFrame([(None, 100.0), (1, 2.0), (2, None), (3, 4.0)], "a int, b double")
    result, _ = handle_missing(df, {"a": "drop_rows", "b": "fill_mean"})
    assert sorted(r["b"] for r in result.collect()) == [2.0, 3.0, 4.0]
    first, _ = handle_missing(df.select("b", "a"), {"a": "drop_rows", "b": "fill_mean"})
    assert sorted(r["b"] for r in first.collect()) == [2.0, 4.0, pytest.approx(106 / 3)]


def test_fill_without_positions_follows_the_scan(spark):
    df = numbers(spark, [None, 2.0, None, 4.0]).coalesce(1).drop("_row_id")
    assert [r[0] for r in handle_missing(df, "fill_forward")[0].collect()] == [2, 2, 2, 4]


@pytest.mark.parametrize("order", ["_row_id", "stamp", ["half", "stamp"]])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_ordered_fill_equals_pandas(spark, order, direction):
    """Long gaps over many small ranges, at both ends too, a third of the leading keys equal."""
    rng = random.Random(7)
    cells = [None] * 40 + [rng.choice([None, None, None, float(i)]) for i in range(400)] + [None] * 60
    rows = [(i, f"{0 if i < 170 else i:04d}", 1000.0 + 3 * i, c, None if i % 50 else i) for i, c in enumerate(cells)]
    pdf = pd.DataFrame(rows, columns=["_row_id", "half", "stamp", "v", "w"])
    if direction == "forward":
        want = pdf[["v", "w"]].ffill().bfill()
    else:
        want = pdf[["v", "w"]].bfill().ffill()
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "_row_id long, half string, stamp double, v double, w long").repartition(6)
    got = fill_ordered(df, ["v", "w"], order, direction, rows_per_range=30).orderBy("_row_id").toPandas()
    assert got["v"].tolist() == want["v"].tolist() and got["w"].tolist() == want["w"].tolist()


def test_ranges_stay_even_with_ties_and_null_keys(spark):
    """Nine rows in ten share a key or have none: no range holds more than twice what is wanted."""
    rows = [(i, None if i % 10 < 4 else 5.0 if i % 10 < 9 else float(i), None if i % 3 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, k double, v double").repartition(4)
    ranged, _ = fills._with_ranges(df, ["k"], 100)
    assert max(r["count"] for r in ranged.groupBy("_range").count().collect()) <= 200
    got = fill_ordered(df, ["v"], "k", rows_per_range=100)
    assert got.where("v is null").isEmpty() and got.count() == 2000
    again = fill_ordered(df.repartition(7), ["v"], "k", rows_per_range=150)
    assert sorted(map(tuple, got.na.fill(-1.0).collect())) == sorted(map(tuple, again.na.fill(-1.0).collect()))


def test_fill_by_group(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", rng.choice([None, float(i)])) for i in range(300)]
    pdf = pd.DataFrame(rows, columns=["i", "g", "v"])
    want = pdf.groupby("g")["v"].transform(lambda s: s.ffill().bfill())
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(5)
    got = fill_ordered(df, ["v"], "i", by=["g"], rows_per_range=25).orderBy("i").toPandas()
    assert got["v"].tolist() == want.tolist()


def test_ordered_fill_has_no_global_window(spark):
    df = numbers(spark, [1.0, None] * 20)
    plan = fill_ordered(df, ["value"], "_row_id")._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "Window" in line and "value" in line]
    assert big and all("_range" in line for line in big)
    assert fills.MAX_RANGES <= 20_000


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_quantiles_equal_pandas(spark, monkeypatch, limit):
    """Without a limit all bits are counted in rounds; two values hold two thirds of one column."""
    monkeypatch.setattr(quantiles, "COUNT_LIMIT", limit)
    rng = random.Random(limit)
    pdf = pd.DataFrame({
        "a": [rng.gauss(0, 1) for _ in range(4000)],
        "b": [rng.choice([1.0, 2.0, rng.random() + 1]) for _ in range(4000)],
        "c": [float(rng.randint(0, 2)) for _ in range(4000)],
        "d": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3990)] + [0.0, -0.0, 5e-324, -5e-324, 1.0] * 2,
        "e": [rng.choice([float("nan"), -7.5]) for _ in range(4000)],
    })
    points = [0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1]
    df = spark.createDataFrame(pdf).repartition(5)
    got = exact_quantiles(df, {c: F.col(c) for c in pdf}, points)
    want = pdf.quantile(points)
    for c in pdf:
        assert [got[c].values[p] for p in points] == pytest.approx(want[c].tolist(), rel=1e-12, abs=1e-12)
        assert (got[c].count, got[c].minimum, got[c].maximum) == (pdf[c].count(), pdf[c].min(), pdf[c].max())
    assert got["a"].between and got["c"].between and not got["e"].between


def test_quantiles_gather_no_column(spark):
    """Counts are summed by (column, prefix) in many tasks; none of them sees the values or a sketch of them."""
    numbers_ = spark.range(0, 100_000, numPartitions=40).select((F.col("id") % 9973).cast("double").alias("c0"))
    counts = quantiles._count(numbers_, [quantiles._Live(0, 0, 0, ())], 0, 16)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(live" in plan and "SinglePartition" not in plan and "percentile" not in plan
    assert counts.agg(F.sum("n")).first()[0] == 100_000
    assert exact_quantiles(numbers_, {"v": F.col("c0")}, [0.5])["v"].values[0.5] == 4972.5


def test_quantiles_of_nothing(spark):
    got = exact_quantiles(numbers(spark, [None, None]), {"value": F.col("value")}, [0.5])["value"]
    assert (got.count, got.values[0.5]) == (0, None)


def test_modes(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None)], "n int, s string")
    assert exact_modes(df, ["n", "s"]) == {"n": 9, "s": "a"}
