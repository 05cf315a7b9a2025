import re

from sparkprep.llm import decontamination as d

from .helpers import prose

SCHEMA = "doc_id long, text string, n_hit int, words string"


def cut(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(doc, items):
    w, hit, ids = cut(doc), set(), set()
    for item, text in items:
        v = cut(text)
        wins = [v[i : i + 10] for i in range(len(v) - 9)] if len(v) >= 10 else [v] if v else []
        for win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(item)
    return len(hit), sorted(map(str, ids))


def case(n_items=12):
    items = [(i, prose(100 + i, 8 + 3 * i)) for i in range(n_items)]
    items += [(40, "rare Pair"), (41, "solo"), (42, ""), (43, None), (44, items[5][1]), (5, prose(7, 30))]
    docs = [prose(i, 120) for i in range(10)]
    docs[1] += " " + items[4][1].upper() + " " + items[4][1]
    docs[2] = items[11][1] + docs[2]
    docs[3] += " -- RARE, pair!"
    docs[4] += " solo solo"
    docs[5] = " ".join(items[9][1].split()[3:14])
    docs[6] += " " + items[5][1]
    docs += [None, "", "?!", docs[1], "über Straße " * 6]
    return items, docs


def test_equals_brute_force(spark):
    items, docs = case()
    df = spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(docs)] + [(None, docs[2], 0, "w")] * 2, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.mark(df, bench)
    assert out.columns == [*df.columns, "_hits"]
    rows = out.collect()
    assert len(rows) == len(docs) + 2
    for r in rows:
        n, ids = plain(r["text"], items)
        assert (r["_hits"] is None) == (n == 0)
        if n:
            assert (r["_hits"]["n_hit"], r["_hits"]["items_text"].split(",")) == (n, ids)
    clean = {r["doc_id"] for r in d.without_contaminated(df, bench).collect()}
    assert clean == {i for i, t in enumerate(docs) if not plain(t, items)[0]}


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs = case()
    df = spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {r["doc_id"]: r["_hits"] for r in d.mark(df, bench).collect()}
    monkeypatch.setattr(d, "BLOCK", 60)
    assert {r["doc_id"]: r["_hits"] for r in d.mark(df, bench).collect()} == one


def test_empty_tables(spark):
    items, docs = case()
    df = spark.createDataFrame([(1, docs[0], 0, "w")], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.mark(df.where("false"), bench).count() == 0
    assert d.mark(df, bench.where("false")).first()["_hits"] is None
