"""Whole runs, manifest, streams, and the registered queries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sparkprep import CleanConfig, apply_filters, clean, clean_stream, read_csv, read_json, run, write_split
from sparkprep.operators.filters import compile_filters
from sparkprep.plans import apply_rows, fit_rows, read_manifest, run_history, run_status_counts

CSV = """ID,Full Name,Signed-Up,Score,Active
1, Ann ,2024-01-05,9.5,yes
2,Bob,2024-01-06,,no
2,Bob,2024-01-06,,no
3,Cid,2024-01-07,7.5,yes
4,null,2024-01-08,8.0,yes
5,Dee,bad,6.0,no
6,Eve,2024-01-10,500,yes
7,too,many,fields,here,x
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return str(path)


def test_clean_from_file(spark, csv):
    result = clean(csv, {"remove_outliers": True, "filters": {"id": {"op": "<=", "value": 6}}}, spark=spark)
    assert dict(result.df.dtypes) == {
        "id": "bigint", "full_name": "string", "signed_up": "timestamp_ntz", "score": "double", "active": "boolean",
    }
    rows = {r["id"]: r for r in result.df.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[2]["score"] == 8.0 and rows[4]["full_name"] == "Bob"
    assert rows[5]["signed_up"] == datetime(2024, 1, 8)
    counters = result.summary.first().asDict()
    assert (counters["rows_initial"], counters["duplicates_removed"], counters["outliers_removed"]) == (7, 1, 1)
    assert (counters["rows_after"], counters["columns_renamed"], counters["missing_data_handled"]) == (5, 5, 3)
    assert result.quality.completeness_score == 100
    assert set(result.reports) >= {"types", "missing", "missing_handling", "quality", "profile"}


def test_switches(spark, csv):
    plain = clean(csv, CleanConfig(normalize=False, enforce_types=False, handle_missing_data=False,
                                   remove_duplicates=False, profile=False), spark=spark)
    assert plain.df.columns == ["ID", "Full Name", "Signed-Up", "Score", "Active"]
    assert plain.df.count() == 7 and {t for _, t in plain.df.dtypes} == {"string"}
    with pytest.raises(ValueError):
        CleanConfig.from_dict({"no_such_option": 1})
    assert CleanConfig.from_dict({"handle_missing": "drop"}).missing_data_strategy == "drop"


def test_drop_flags_and_rules(spark, csv):
    dropped = clean(csv, {"handle_missing": "drop"}, spark=spark)
    assert sorted(r["id"] for r in dropped.df.collect()) == [1, 3, 6]
    flagged = clean(csv, {"missing_data_strategy": {"score": "fill_mean"}, "flag_missing_data": True,
                          "validation_rules": {"score": {"type": "number", "max": 100}}}, spark=spark)
    assert {"full_name_missing", "signed_up_missing"} <= set(flagged.df.columns)
    # Both copies of the second row and the one above the limit; positions are those of the file.
    found = [(r["row"], r["column"], r["rule"]) for r in flagged.errors.where("step = 'validation'").collect()]
    assert (6, "score", "max") in found


def test_run_writes_everything(spark, csv, tmp_path):
    manifest = str(tmp_path / "manifest")
    result = run(spark, csv, str(tmp_path / "out"), {"output_format": "json"}, manifest=manifest, run_id="a")
    assert read_json(spark, str(tmp_path / "out/data")).count() == result.counters["rows_after"]
    with pytest.raises(FileNotFoundError):
        run(spark, str(tmp_path / "none.csv"), str(tmp_path / "out2"), manifest=manifest, run_id="b")
    history = {r["run_id"]: r for r in run_history(read_manifest(spark, manifest)).collect()}
    assert (history["a"]["status"], history["b"]["status"]) == ("completed", "failed")
    assert history["a"]["counters"]["rows_initial"] == "7" and "none.csv" in history["b"]["message"]
    counts = {r["status"]: r["runs"] for r in run_status_counts(read_manifest(spark, manifest)).collect()}
    assert counts == {"pending": 0, "processing": 0, "completed": 1, "failed": 1, "cancelled": 0, "total": 2}


def test_csv_output(spark, csv, tmp_path):
    run(spark, csv, str(tmp_path / "out"))
    assert "full_name" in read_csv(spark, str(tmp_path / "out/data")).columns


def test_fitted_plan_on_a_stream(spark, csv, tmp_path):
    """A stream of the same rows gives what the batch gives."""
    batch = read_csv(spark, csv)
    rules = {"score": {"type": "number", "max": 100}}
    strategies = {"score": "fill_median", "full_name": "fill_mode", "signed_up": "flag"}
    plan = fit_rows(batch, {"missing_data_strategy": strategies, "validation_rules": rules})
    want = apply_rows(batch, plan)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = write_split(stream(), plan, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "progress"))
    done.awaitTermination()
    valid = spark.read.parquet(str(tmp_path / "ok")).drop("batch")
    rejected = spark.read.parquet(str(tmp_path / "bad"))
    assert valid.count() == 6 and [r["score"] for r in rejected.collect()] == [500.0]
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(valid.select(want.columns)) == as_rows(want.where("score <= 100"))

    filters = compile_filters(want, {"active": True, "score": {"op": ">", "value": 7}})
    query = clean_stream(stream(), plan, filters).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert as_rows(spark.table("cleaned")) == as_rows(apply_filters(want, {"active": True, "score": {"op": ">", "value": 7}}))


def test_plans_for_streams_refuse_ordered_fills(spark, csv):
    with pytest.raises(ValueError):
        fit_rows(read_csv(spark, csv), {"missing_data_strategy": {"score": "fill_forward"}})


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    first = contract.entry(spark)
    assert first.columns == ["event_id", "ts", "user_id", "event_type", "value"] and not first.isEmpty()
