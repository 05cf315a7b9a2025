import hashlib
import re
import uuid

import pytest

from sparkprep.llm import digest_index
from sparkprep.session import shared_folder

SCHEMA = "doc_id long, text string, digest string, row int, `a.b` string"


def empty_index(spark, **settings):
    return digest_index.open_index(spark, f"{shared_folder(spark)}/test-index-{uuid.uuid4().hex}", **{"buckets": 4, **settings})


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def expected(batches):
    """(batch, id, text) -> how often: keep_id, group_size, kept, by brute force."""
    rows = [(b, i, r[0], r[1]) for b, part in enumerate(batches) for i, r in enumerate(part)]
    out = []
    for b, i, doc, text in rows:
        group = [x for x in rows if normal(x[3]) == normal(text)]
        best = min(group, key=lambda x: (-len(x[3] or ""), x[2] is None, x[2] or 0, x[0], 0))
        tied = [x for x in group if (len(x[3] or ""), x[2], x[0]) == (len(best[3] or ""), best[2], best[0])]
        kept = (b, doc) == (best[0], best[2]) and len(text or "") == len(best[3] or "")
        out.append((doc, best[2], len(group), kept, len(tied), hashlib.sha256(normal(text).encode()).hexdigest()))
    return out


BATCHES = [
    [(1, "a b", "x", 1, "k"), (2, "ab", "x", 1, "k"), (3, None, "x", 1, "k"), (4, " \t\n", "x", 1, "k"), (5, "Ä é", None, None, None)],
    [(6, "a  b ", "y", 2, "m"), (0, "new", "y", 2, "m"), (None, "new", "y", 2, "m"), (7, "", "y", 2, "m"), (8, "long " * 50_000, "y", 2, "m")],
    [(9, "new", "z", 3, "n"), (9, "Äé", "z", 3, "n"), (10, "a b", "z", 3, "n"), (11, "long" * 50_000, "z", 3, "n")],
]


def test_deliveries_against_brute_force(spark):
    index = empty_index(spark)
    fresh = []
    for k, part in enumerate(BATCHES):
        added = digest_index.add(index, spark.createDataFrame(part, SCHEMA), str(k))
        assert added.columns == ["doc_id", "text", "digest", "row", "a.b"]
        fresh.append(sorted(normal(r["text"])[:9] for r in added.collect()))
    assert fresh == [["", "ab", "Äé"], ["longlongl", "new"], ["a b"]]  # one row of each text that was not there
    got = [
        (r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in digest_index.verdicts(index).collect()
    ]
    want = [(d, k, n, kept, h) for d, k, n, kept, _, h in expected(BATCHES)]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_delivery_again_and_later_session(spark):
    index = empty_index(spark)
    docs = spark.createDataFrame(BATCHES[0], SCHEMA)
    digest_index.add(index, docs, "a")
    digest_index.add(index, spark.createDataFrame(BATCHES[1], SCHEMA), "b")
    first = sorted(map(str, digest_index.verdicts(index).collect()))
    assert digest_index.add(index, spark.createDataFrame(BATCHES[1], SCHEMA), "b").count() == 2
    assert sorted(map(str, digest_index.verdicts(index).collect())) == first
    again = digest_index.open_index(spark, index.path)  # as a new session finds it
    assert (again.buckets, again.id_type) == (4, "bigint")
    assert digest_index.add(again, docs, "c").count() == 0
    assert digest_index.verdicts(again).count() == 15


def test_repeated_rows_keep_exactly_one(spark):
    index = empty_index(spark)
    rows = [(1, "same", "", 0, "")] * 300 + [(1, "other", "", 0, "")]
    digest_index.add(index, spark.createDataFrame(rows, SCHEMA).repartition(5), "a")
    got = digest_index.verdicts(index).groupBy("digest").agg({"group_size": "max", "kept": "count"}).collect()
    assert sorted(r["max(group_size)"] for r in got) == [1, 300]
    assert digest_index.verdicts(index).where("kept").count() == 2


def test_empty_table_and_text_ids(spark):
    index = empty_index(spark, id_type="string")
    docs = spark.createDataFrame([("x1", "a"), ("x0", "a ")], "name string, body string")
    assert digest_index.add(index, docs.where("false"), "none", key="name", text="body").count() == 0
    assert digest_index.verdicts(index).count() == 0
    assert [tuple(r) for r in digest_index.add(index, docs, "some", key="name", text="body").collect()] == [("x0", "a ")]


def test_index_is_not_shuffled(spark):
    index = empty_index(spark, buckets=16)
    digest_index.add(index, spark.createDataFrame(BATCHES[0], SCHEMA), "a")
    plan = digest_index.verdicts(index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(digest") == 1 and "SelectedBucketsCount: 16" in plan  # the rows' side only
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_texts_change_the_plan_only(spark, monkeypatch, hot):
    monkeypatch.setattr(digest_index, "HOT", hot)
    index = empty_index(spark)
    rows = [(i, "often" if i % 3 else f"t{i % 7}", "", 0, "") for i in range(60)]
    digest_index.add(index, spark.createDataFrame(rows, SCHEMA), "a")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in digest_index.verdicts(index).collect()}
    for doc, keep, n, kept, _, _ in expected([rows]):
        assert got[doc] == (keep, n, kept)
