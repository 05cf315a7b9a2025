import numpy as np
import zlib

from sparkprep.llm import gam

from .helpers import prose


def test_tables_and_pairs_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    x[rng.random(4000) < 0.1, 5] = np.nan
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_held_out_accuracy_nulls_and_ties(spark):
    rows = [(i, prose(i, 150) if i % 2 else "BUY!! " * (40 + i % 30), "f") for i in range(400)]
    rows += [(1000, None, "f"), (1001, "", "f"), (None, prose(1, 100), None), (1, prose(1, 150), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 1), (None, 1), (5, None), (7777, 0)], "doc_id long, quality int")
    out = gam.classify(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([(r["score"] >= 0.3) == r["doc_id"] % 2 for r in held]) > 0.97
    again = {r["doc_id"]: r["score"] for r in gam.classify(docs.repartition(3), marks).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in out)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert gam.classify(docs, none).first()["score"] == 0.5
    assert gam.classify(docs.where("false"), none).count() == 0
