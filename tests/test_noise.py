import random

import pytest
from pyspark.sql import functions as F

from sparkprep import count_duplicates, flag_outliers, outlier_report, remove_duplicates, remove_outliers
from sparkprep.operators.dedupe import has_duplicates
from sparkprep.operators.outliers import fit_outliers


def test_exact(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), ("c", 3)], "name string, age int")
    assert remove_duplicates(df, "exact").count() == remove_duplicates(df).count() == 3
    nulls = spark.createDataFrame([(None, 1), (None, 1), ("b", 2), ("b", 2)], "name string, age int")
    assert remove_duplicates(nulls).count() == 2


def test_normalized_keeps_first(spark):
    rows = [(2, "JOHN ", 30), (0, "John", 30), (1, " john", 30), (3, "Jane", 30)]
    df = spark.createDataFrame(rows, "_row_id long, name string, age int").repartition(3)
    kept = remove_duplicates(df)
    assert sorted((r["_row_id"], r["name"]) for r in kept.collect()) == [(0, "John"), (3, "Jane")]
    assert kept.columns == df.columns


def test_normalized_only_without_exact_duplicates(spark):
    rows = [("a", 1), ("a", 1), (" A", 1)]
    df = spark.createDataFrame(rows, "s string, n int")
    assert remove_duplicates(df).count() == 2
    assert remove_duplicates(df, "normalized").count() == 1


def test_separators_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ('a","b', "c")], "x string, y string")
    assert remove_duplicates(df, "normalized").count() == 3


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("",)], "x string")
    assert remove_duplicates(df, "normalized").count() == 1


def test_subset_and_order(spark):
    rows = [("a", 3), ("a", 1), ("b", 2), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, n int")
    kept = remove_duplicates(df, "exact", subset=["k"], order_by="n")
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 2)]


def test_positions_are_not_part_of_the_row(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "_row_id long, s string")
    assert sorted(map(tuple, remove_duplicates(df).collect())) == [(0, "a"), (2, "b")]
    assert has_duplicates(df) and not has_duplicates(df, ["_row_id", "s"])


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", " X", "y ", "Y", "hot"]), rng.choice([1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, n int")
    results = [sorted(map(tuple, remove_duplicates(df.repartition(n), "normalized").collect())) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    again = remove_duplicates(remove_duplicates(df, "normalized"), "normalized")
    assert sorted(map(tuple, again.collect())) == results[0]


def test_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("same").alias("s"), (F.col("id") % 2).alias("n"))
    plan = remove_duplicates(df, "normalized")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_count(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "s string")
    assert tuple(count_duplicates(df).first()) == (4, 2, 2)
    assert tuple(count_duplicates(df.limit(0)).first()) == (0, 0, 0)


def test_iqr(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcdef", [10, 12, 11, 13, 12, 500])], "name string, value int")
    assert remove_outliers(df).count() == 5
    assert fit_outliers(df).keys() == {"value"}
    flagged = flag_outliers(df).where("value_outlier").collect()
    assert [r["value"] for r in flagged] == [500]


@pytest.mark.parametrize("cells", [[1, 2, 3, 400], [5, 5, 5, 5, 5], [0, 0, 0, 0, 0, 1], [0, 1, 1, 1, 1, 1, 1, None]])
def test_guards(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "v int")
    assert remove_outliers(df).count() == len(cells)


def test_numbers_as_text_and_missing(spark):
    cells = ["1", "2", "3", "4", "5", "900", None, "x"]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    assert sorted(r["v"] for r in remove_outliers(df).collect()) == ["1", "2", "3", "4", "5"]
    assert remove_outliers(df, drop_nulls=False).count() == 7


def test_sequential_and_one_pass_differ(spark):
    rows = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (900, 6), (6, 90)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert remove_outliers(df).count() == 5
    assert remove_outliers(df, sequential=False).count() == 5
    assert remove_outliers(df, ["a"]).count() == 6


def test_zscore_and_report(spark):
    df = spark.createDataFrame([(float(v % 7),) for v in range(70)] + [(1000.0,)], "v double")
    assert remove_outliers(df, method="zscore").count() == 70
    row = outlier_report(df).first()
    assert (row["column"], row["values"], row["outliers"]) == ("v", 71, 1)
