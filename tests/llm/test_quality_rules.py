import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from sparkprep.llm import quality_rules as q
from sparkprep.llm.text import read

from .helpers import prose

SCHEMA = "doc_id long, text string, `_w` string, `a.b` int"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    inside = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_equal_brute_force(spark):
    long = prose(5, 60_000)
    texts = [None, "", "   \n\t", "a", "a b", "a b c a b c", "a b a b a", "# x\n\n# x\n  # x\ny", "é ü ß\x0bz", prose(1, 300), prose(1, 300), long, "q " * 3000, "a b c x a b c y a b c"]
    df = spark.createDataFrame([(i, t, "w", i) for i, t in enumerate(texts)] + [(None, "a b c", None, None)], SCHEMA)
    out = q.apply_rules(df)
    assert out.columns == [*df.columns, "_measures", "_broken"]
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r["_measures"][c] for c in COUNTS) == plain(r["text"]), r["text"]
    by = {r["doc_id"]: r["_broken"] for r in rows}
    assert by[0] == by[1] == ["too_few_words"] and by[9] == by[10] == []
    assert "repeated_windows" in by[12]


def test_filter_on_the_verdict_and_empty_table(spark):
    df = spark.createDataFrame([(1, prose(2, 200), "", 0), (2, "too short", "", 0)], SCHEMA)
    kept = q.apply_rules(df).where("size(_broken) = 0")
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert q.apply_rules(df.where("false")).count() == 0


def test_custom_table(spark):
    df = spark.createDataFrame([(1, "a b c", "", 0)], SCHEMA)
    rules = [q.Rule("long", "n_words", high=2), q.Rule("unused", "n_words", low=1)]
    assert q.apply_rules(df, rules).first()["_broken"] == ["long"]
    assert q.apply_rules(df, []).first()["_broken"] == []


def test_rules_of_a_corpus_spare_single_lines_and_other_languages(spark):
    line = " ".join(prose(3, 200).split()).rstrip(".")
    russian = " ".join(f"слово{i}" for i in range(100)) + "."
    rows = [(1, line, "en"), (2, russian, "ru"), (3, russian, None), (4, russian, "en-GB"), (5, line.replace(" ", " x\n "), "en")]
    out = corpus_pipeline.good_quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]


def test_no_clean_labelled_document_is_lost(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    clean = read(spark, folder, "labels").where("quality = 1").select("doc_id")
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang").join(clean, "doc_id")
    base = q.apply_rules(docs, [r for r in q.RULES if r.base]).where("size(_broken) = 0").select("doc_id")
    kept = corpus_pipeline.good_quality(spark, docs, folder)
    assert base.count() > 3000 and base.join(kept, "doc_id", "left_anti").collect() == []
