from collections import Counter

from sparkprep.llm import near_duplicates as n

from .helpers import changed, prose

SCHEMA = "doc_id long, text string, digest string, root int"


def sets(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(docs):
    s = {i: sets(t) for i, t in docs.items()}
    degree, head = Counter(), {i: i for i in docs}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((top(a), top(b)))
                head[y] = x
    return {i: (degree[i], top(i)) for i in docs}


def case():
    base = [prose(i, 150) for i in range(8)]
    docs = [*base, base[0], base[0], "", "", None, "  ", "one", "one", "one two", prose(9, 20_000)]
    docs += [changed(base[1], k, 0.012) for k in range(40)] + [changed(base[2], k, 0.03) for k in range(40)]
    return dict(enumerate(docs))


def test_links_and_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "CHUNK", 8)  # so that the large groups take several blocks, and several old chunks
    docs = case()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA).repartition(5)
    got = {r["id"]: (r["n_links"], r["near_group"]) for r in n.near_duplicates(df).collect()}
    assert got == plain(docs)


def lengths_used(monkeypatch):
    used, blocks = [], n._blocks
    monkeypatch.setattr(n, "_blocks", lambda tries, length, depth: used.append(length) or blocks(tries, length, depth))
    return used


def test_shorter_prefixes_raise_the_recall(spark, monkeypatch):
    used = lengths_used(monkeypatch)
    docs = {i: t for i, t in case().items() if i > 17}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA)
    want = plain(docs)
    found = n.near_duplicates(df, trees=8, recall=0.999).collect()  # eight values in eight trees are not enough
    assert used == list(range(8, used[-1] - 1, -1)) and used[-1] < 8
    assert sum(r["n_links"] for r in found) >= 0.99 * sum(d for d, _ in want.values())
    degree = {r["id"]: r["n_links"] for r in found}
    assert all(degree[i] <= want[i][0] for i in docs)  # a link that several lengths meet counts once


def test_default_join_shortens_only_while_links_may_be_missed(spark, monkeypatch):
    used = lengths_used(monkeypatch)
    base = [prose(i, 200) for i in range(60)]
    close = [changed(t, i, 0.004) for i, t in enumerate(base)]  # far above the threshold
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(base + close)], SCHEMA)
    docs = dict(enumerate(base + close))
    assert {r["id"]: (r["n_links"], r["near_group"]) for r in n.near_duplicates(df).collect()} == plain(docs)
    assert used[0] == n.DEPTH
    used.clear()
    rough = [changed(t, k * 100 + i, 0.018) for i, t in enumerate(base) for k in range(3)]  # around it
    docs = dict(enumerate(base + rough))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA)
    got = {r["id"]: (r["n_links"], r["near_group"]) for r in n.near_duplicates(df).collect()}
    assert used == [8, 7, 6] and n.floor_length(n.THRESHOLD, n.RECALL, n.TREES, n.DEPTH) == 6
    assert got == plain(docs)


def test_prefixes_are_shifted_labels():
    import numpy as np

    values = np.array([[0x1FF, 2, 3, 4, 5, 6, 7, 8], [0x2FF, 2, 3, 9, 5, 6, 7, 8]], np.uint64)
    a, b = n.packed(values)
    assert a >> np.uint64(40) == b >> np.uint64(40) == 0xFF0203 and a >> np.uint64(32) != b >> np.uint64(32)
    assert len(n.packed(np.zeros((3, 6), np.uint64))) == 3


def test_one_of_each_group_stays(spark):
    docs = case()
    rows = [(i, t, "x", 1) for i, t in docs.items()] + [(3, docs[3], "x", 1)] * 2 + [(None, docs[4], "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = n.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({top for _, top in plain(docs).values()})
    assert n.near_duplicates(df.where("false")).count() == 0
    assert n.without_near_duplicates(df.where("false")).count() == 0
