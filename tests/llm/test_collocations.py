import random
import re
from collections import Counter

import pytest

from sparkprep.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def brute(rows, longest, least, share, top):
    """Every phrase of every length counted apart, in plain Python."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    lists = {}
    for (lang, *p), a in candidates.items():
        p = tuple(p)
        holders = (q for q in candidates if q[0] == lang and len(q) - 1 > len(p))
        if any(p in [q[1:][i : i + len(p)] for i in range(len(q))] and 100 * candidates[q] >= share * a for q in holders):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        lists.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[(lang, *p[:k])], f[(lang, *p[k:])]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in lists.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def corpus(seed, n=80, vocabulary=6):
    rng = random.Random(seed)
    joins = [" ", " ", " ", "\t ", ". ", ",", "\n", "; ", "\r\n", " ! "]
    names = ["a", "B", "é", "É", "x|y", "日本", "c-d"][:vocabulary]
    made = ["".join(rng.choice(names) + rng.choice(joins) for _ in range(rng.randrange(60))) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", None, "und", "", "de"]), "k", 1) for i, t in enumerate(made)]
    return rows + [(900, None, "en", None, None), (901, "", None, None, None), (None, " \n.. ", None, None, None)] + [rows[3]] * 12


@pytest.mark.parametrize("longest, least, share, top", [(3, 10, 50, 2000), (3, 4, 30, 7), (2, 10, 50, 2000), (4, 5, 50, 2000)])
def test_against_counting_each_length(spark, longest, least, share, top):
    rows = corpus(longest * 10 + least)
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), longest, least, share, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, longest, least, share, top)
    assert len(want) > 20 and sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("hot", [1, 10])
def test_hot_words_change_the_plan_only(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "HOT", hot)
    rows = corpus(5, vocabulary=4)
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 10, 50, 2000)


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "one two three " * 40_000, "en", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in collocations.collocations(docs).orderBy("rank").collect()]
    assert [g[2] for g in got] == ["one two three", "three one two", "two three one"] and got[0][3] == 40_000 and got[0][6] == 120_000
    assert collocations.collocations(docs.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    a, l, r = 99_999_999_999_999, 99_999_999_999_998, 100_000_000_000_000 - 7  # noqa: E741
    rows = [(a, l, r), (10, 99_999_999_999_999, 10), (3, 7, 5)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [x[0] for x in df.select(collocations.score(df.a, df.l, df.r)).collect()]
    assert got == [10**6 * a * a // (l * r) for a, l, r in rows]


@pytest.mark.parametrize("entries", [0, 2, 4])
def test_words_without_numbers_are_counted_as_text(spark, monkeypatch, entries):
    monkeypatch.setattr(collocations, "ENTRIES", entries)
    rows = corpus(8)
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 10, 50, 2000)


def test_dealing_out_changes_the_plan_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FIRST", 2)
    monkeypatch.setattr(collocations, "WORDS", 50)
    rows = corpus(9)
    out = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 10, 50, 2000)


def test_windows_are_counted_once(spark):
    texts = spark.createDataFrame(corpus(1), SCHEMA).select("lang", "text").na.fill("")
    plan = collocations.marginals(collocations.windows(texts, ["a", "b"], 3), 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Expand") == 1 and "Generate" not in plan
