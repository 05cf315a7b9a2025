"""Validation, quality, profiles, vectors."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkprep import (
    compare_profiles, correlations, embed_text, error_rate_score, histogram, interactions, measure_quality,
    missing_patterns, one_hot, preview, profile_alerts, profile_columns, profile_dates, profile_numeric,
    profile_overview, profile_text, quality_issues, quality_score, read_vectors, split_valid, standardize,
    top_values, validate_schema, validation_errors, vector_info, vectorize, write_vectors, analyze_missing,
)
from sparkprep.operators.quality import grade_of


def test_validation_errors(spark):
    df = spark.createDataFrame([("Ann", "30"), (None, "40"), ("Bob", "abc")], "name string, age string")
    schema = {"name": {"type": "string", "required": True}, "age": {"type": "number"}}
    found = sorted((r["row"], r["column"], r["rule"]) for r in validation_errors(df.coalesce(1), schema).collect())
    assert found == [(1, "name", "required"), (2, "age", "type")]
    assert not validate_schema(df, schema)


def test_bounds_may_both_fail_and_order(spark):
    df = spark.createDataFrame([(0, 5), (1, 150), (2, 50), (3, None)], "_row_id long, age int")
    rules = {"age": {"type": "number", "min": 10, "max": 100}}
    assert [(r["row"], r["rule"]) for r in validation_errors(df, rules).orderBy("row").collect()] == [(0, "min"), (1, "max")]
    crossed = {"age": {"type": "number", "min": 100, "max": 10}}
    assert [r["rule"] for r in validation_errors(df.where("_row_id = 2"), crossed).collect()] == ["min", "max"]
    # Bounds need the number type, as a missing required value stops further rules.
    assert validation_errors(df, {"age": {"min": 1000}}).count() == 0


@pytest.mark.parametrize(
    "kind, data_type, good",
    [
        ("string", "string", True), ("string", "int", False), ("number", "double", True), ("number", "boolean", True),
        ("number", "timestamp_ntz", False), ("boolean", "boolean", True), ("boolean", "int", False),
        ("datetime", "timestamp_ntz", True), ("datetime", "boolean", False), ("anything", "int", True),
    ],
)
def test_types_by_schema(spark, kind, data_type, good):
    value = {"string": "x", "int": "1", "double": "1.5", "boolean": "true", "timestamp_ntz": "2024-01-01"}[data_type]
    df = spark.range(1).select(F.lit(value).cast(data_type).alias("v"))
    assert validate_schema(df, {"v": {"type": kind}}) is good
    assert validate_schema(df.select(F.lit(None).cast(data_type).alias("v")), {"v": {"type": kind}})


def test_empty_schema_and_data(spark):
    df = spark.createDataFrame([], "v string")
    assert validate_schema(df, {"v": {"required": True}}) and validate_schema(df, {}) and validate_schema(df, None)


def test_split(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("v"))
    valid, rejected = split_valid(df, {"v": {"type": "number", "max": 4}})
    assert valid.count() + rejected.count() == 100
    assert valid.columns == ["v"] and rejected.agg(F.min("v")).first()[0] == 5


def test_issues(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a int, b string")
    found = sorted((r["column"], r["issue"], r["percentage"]) for r in quality_issues(df).collect())
    assert found == [("a", "missing", 33.3), ("b", "empty", 100.0), ("b", "missing", 100.0)]


def test_clean_table_scores_high(spark):
    rows = [(i, f"Name {i}", 20 + i, 80.0 + i) for i in range(5)]
    score = measure_quality(spark.createDataFrame(rows, "id int, name string, age int, score double"))
    assert (score.completeness_score, score.validity_score, score.grade) == (100, 100, "A")
    assert score.overall_score > 80


def test_scores_by_part(spark):
    df = spark.createDataFrame(
        [("A", 1.0, None), ("b ", 2.0, None), ("Cc", 300.0, None), ("Cc", 300.0, None)], "s string, x double, e int"
    )
    before = analyze_missing(df)
    rules = {"x": {"type": "number", "max": 100}}
    score = measure_quality(df, before=before, type_errors=3, schema=rules)
    assert score.completeness_score == pytest.approx(round(100 * 8 / 12 - 5, 2))
    assert score.validity_score == pytest.approx(100 - 15 - 40)
    # Mixed case and padding in one column, a spread above 1 in the other; the empty column does not count.
    assert score.consistency_score == pytest.approx((75 + 90) / 2)
    assert score.accuracy_score == pytest.approx(100 - 25)
    total = 0.3 * (100 * 8 / 12 - 5) + 0.3 * 45 + 0.2 * 82.5 + 0.2 * 75
    assert (score.overall_score, score.grade) == (round(total, 2), "D")


def test_validity_bonus_and_empty_table(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert measure_quality(df, type_errors=1, schema={"x": {"type": "number"}}).validity_score == 100
    assert tuple(quality_score(df.limit(0)).first()) == (0, 0, 0, 0, 0, "F")


def test_outliers_lower_accuracy(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 1000])], "id int, value double")
    assert measure_quality(df).accuracy_score == pytest.approx(95)


def test_grades_and_error_rate(spark):
    assert [grade_of(s) for s in (95, 90, 85, 70, 60, 59.9)] == ["A", "A", "B", "C", "D", "F"]
    df, none = spark.range(200), spark.range(0)
    score = lambda d, e: tuple(error_rate_score(d, e).first())[2:]
    assert score(df, none) == (100, "excellent")
    assert score(df, spark.range(31)) == (85, "good")
    assert score(df, spark.range(500)) == (0, "needs review")
    assert score(none, none) == (0, "needs review")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [("a", 1.0, 0, None), ("b", 2.0, 0, "2024-01-01"), ("b", 4.0, 0, "2024-01-03"), (None, None, 5, None)],
        "s string, x double, z int, d string",
    ).withColumn("d", F.col("d").cast("timestamp_ntz"))


def test_profiles(spark, table):
    assert {r["column"]: (r["kind"], r["missing_count"]) for r in profile_columns(table).collect()} == {
        "s": ("text", 1), "x": ("numeric", 1), "z": ("numeric", 0), "d": ("datetime", 2),
    }
    whole = profile_overview(table).first()
    assert (whole["total_cells"], whole["missing_cells"], whole["duplicate_rows"]) == (16, 4, 0)
    x = profile_numeric(table).where("column = 'x'").first()
    assert (x["values"], x["missing"], x["median"], x["mad"], x["iqr"]) == (3, 1, 2.0, 1.0, 1.5)
    assert x["skewness"] == pytest.approx(0.9352195295828244)
    s = profile_text(table).first()
    assert (s["distinct"], s["min_length"], s["missing"]) == (2, 1, 1)
    d = profile_dates(table).first()
    assert (d["values"], d["missing"], d["range_seconds"]) == (2, 2, 172800.0)


def test_distributions(spark, table):
    bins = histogram(table, ["x"], 3).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [1, 1, 1] and (bins[0]["lower"], bins[2]["upper"]) == (1.0, 4.0)
    assert [r["count"] for r in histogram(table.limit(1), ["x"]).collect()] == [1]
    top = top_values(table, ["s", "z"], 1).orderBy("column").collect()
    assert [(r["column"], r["value"], r["count"], r["percentage"]) for r in top] == [("s", "b", 2, 50.0), ("z", "0", 3, 75.0)]
    patterns = {r["missing_columns"]: r["rows"] for r in missing_patterns(table).collect()}
    assert patterns == {"d": 1, "": 2, "s,x,d": 1}
    assert sum(r["count"] for r in interactions(table, "x", "z", 2).collect()) == 3
    head, totals = preview(table, 2, "x")
    assert head.count() == 2 and tuple(totals.first()) == (2, 4)


def test_top_values_are_limited_before_ranking(spark, table):
    plan = top_values(table, ["s"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_relations(spark):
    df = spark.range(60).select(
        F.col("id"), (F.col("id") * 2.0).alias("twice"), F.lit(1).alias("one"), F.lit(0).alias("zero"),
        F.concat(F.lit("k"), F.col("id") % 55).alias("key"), F.lit(None).cast("int").alias("none"),
    )
    assert {(r["column"], r["alert"]) for r in profile_alerts(df).collect()} == {
        ("id", "unique"), ("twice", "unique"), ("one", "constant"), ("zero", "constant"), ("zero", "zeros"),
        ("key", "high_cardinality"), ("none", "high_missing"), ("id,twice", "high_correlation"),
    }
    assert correlations(df, ["id", "twice"]).first()["correlation"] == pytest.approx(1)
    change = {r["column"]: r for r in compare_profiles(df, df.drop("one").where("id < 10")).collect()}
    assert change["one"]["type_after"] is None and change["id"]["rows_after"] == 10


def test_embedding(spark):
    texts = ["Hello world hello", "hello HELLO World", "", None, "a b c", "Été à Zürich", "x1_y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    vectors = [r["v"] for r in embed_text(df, "t").orderBy("i").select(vector_to_array("t_emb").alias("v")).collect()]
    norms = [round(math.sqrt(sum(x * x for x in v)), 9) for v in vectors]
    assert {len(v) for v in vectors} == {512} and norms == [1, 1, 0, 0, 0, 1, 1]
    assert vectors[0] == vectors[1] and min(map(min, vectors)) >= 0
    assert sorted(x for x in vectors[0] if x) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert sum(1 for x in vectors[5] if x) == 2  # the one-letter word is left out


def test_scaling_and_categories(spark):
    df = spark.createDataFrame([(1.0, 7, "b"), (3.0, 7, "a"), (None, 7, None), (100.0, 7, "c")], "x double, k int, c string")
    scaled = standardize(df).collect()
    filled = [1.0, 3.0, 3.0, 100.0]
    mean = sum(filled) / 4
    std = math.sqrt(sum((v - mean) ** 2 for v in filled) / 4)
    assert [r["x_normalized"] for r in scaled] == pytest.approx([(v - mean) / std for v in filled])
    assert [r["k_normalized"] for r in scaled] == [0, 0, 0, 0]
    hot = one_hot(df, "c")
    assert hot.columns[-2:] == ["c_b", "c_c"]
    assert [(r["c_b"], r["c_c"]) for r in hot.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError):
        one_hot(spark.range(11), "id")


@pytest.mark.parametrize("method, size", [("hybrid", 1 + 1 + 512), ("numeric", 1 + 1 + 2), ("text_only", 3 * 512)])
def test_vectorize(spark, tmp_path, method, size):
    df = spark.createDataFrame([(1.0, True, "a"), (2.0, None, "b"), (4.0, False, None), (5.0, True, "c")], "x double, b boolean, c string")
    vectors, meta = vectorize(df, method)
    assert {len(r["v"]) for r in vectors.select(vector_to_array("features").alias("v")).collect()} == {size}
    write_vectors(vectors, meta, str(tmp_path / "v"))
    stored, stored_meta = read_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, vectors.collect()))
    info = vector_info(stored_meta).first()
    assert (info["n_samples"], info["n_features"], info["method"]) == (4, size, method)
    first = {"hybrid": "x_normalized", "numeric": "x_normalized", "text_only": "x_emb_0"}[method]
    assert info["feature_names"][0] == first and len(info["feature_names"]) == min(20, size)


def test_vectorize_errors(spark):
    with pytest.raises(ValueError):
        vectorize(spark.range(3), "magic")
    with pytest.raises(ValueError):
        vectorize(spark.range(0))


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 26))
    base[:, 1] = base[:, 0] * 1e-9 + 1e9  # far from zero
    base[:, 2] = -base[:, 0] * 1e200  # squares would overflow
    base[:, 3] = 0.1  # constant
    base[rng.random(base.shape) < 0.2] = np.nan
    base[:, 4] = np.nan
    base[:, 5] = np.where(np.arange(300) == 7, 3.0, np.nan)  # known once
    base[:150, 6], base[150:, 7] = np.nan, np.nan  # never known together
    base[:, 8] = np.where(np.isnan(base[:, 9]), base[:, 8], 0.3)  # constant where the next column is known
    names = [f"a.{i}" for i in range(26)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    found = {(r["column_a"], r["column_b"]): r["correlation"] for r in correlations(df).collect()}
    assert list(found) == list(combinations(names, 2))
    for (a, b), value in found.items():
        i, j = names.index(a), names.index(b)
        both = ~np.isnan(base[:, i]) & ~np.isnan(base[:, j])
        x, y = base[both, i] / (1e200 if i == 2 else 1), base[both, j] / (1e200 if j == 2 else 1)
        if len(x) < 2 or len(set(x)) == 1 or len(set(y)) == 1:
            assert value is None, (a, b, value)
        else:
            assert value == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6), (a, b)
    assert {r["correlation"] for r in correlations(df.limit(0)).collect()} == {None}


def test_correlations_of_many_columns_run_in_methods_that_are_compiled(spark):
    """The tasks of both passes run under the JVM's limit, and the session is as before, even after an error."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)

    def checked(limit, fail=False):
        def rows(batches):
            from pyspark import TaskContext

            found = TaskContext.get().getLocalProperty(key)
            assert found is not None and int(found) <= limit and not fail
            yield from batches

        numbers = spark.range(2000).select(*[((F.col("id") + i) % (i + 3)).cast("double").alias(f"c{i}") for i in range(26)])
        return numbers.mapInPandas(rows, numbers.schema)

    assert len({r["correlation"] for r in correlations(checked(8000)).collect()}) > 300
    assert spark.conf.get(key) == before
    with pytest.raises(PythonException):
        correlations(checked(8000, fail=True))
    assert spark.conf.get(key) == before
    spark.conf.set(key, "500")  # a lower limit stays
    try:
        correlations(checked(500))
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.unset(key)
    assert spark.conf.get(key) == before
