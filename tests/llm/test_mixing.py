import hashlib
import math
import re

from sparkprep.llm import mixing

from .helpers import prose

SCHEMA = "doc_id long, source string, text string, size int, k string"


def filled(sizes, weights, cap=3.0):
    """Targets by giving out the rest again and again."""
    total, target, full = sum(sizes), {}, set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = sum(weights[i] for i in open_)
        target = {i: cap * sizes[i] if i in full else rest * weights[i] / share for i in range(len(sizes))}
        over = {i for i in open_ if target[i] > cap * sizes[i]}
        if not over:
            return target
        full |= over


def key(doc, text):
    n, s = len(text.split()), len(re.findall("[#*$%&|<>]", text))
    u = (int(hashlib.md5(f"mix{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)
    return -math.log(u) / max(0.25, min(1, 1 - s / n)) if n else 0


def test_targets_epochs_and_order(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, prose(i, 5 + i % 40) + (" ###" if i % 3 == 0 else ""), 1, "x") for i in range(200)]
    rows += [(900, "tiny", "one two", 1, "x"), (901, "void", "", 1, "x"), (902, "void", None, 1, "x")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "source", "text", "size", "k", "_mix"]
    got = {r["doc_id"]: r["_mix"] for r in out.collect()}
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    docs = {n: [r for r in rows if r[1] == n] for n in names}
    sizes = [sum(len((r[2] or "").split()) for r in docs[n]) for n in names]
    target = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, n in enumerate(names):
        want, words = round(target[i]), sizes[i]
        epochs = want // words if words else 0
        rest = want - epochs * words
        for r in sorted(docs[n], key=lambda r: key(r[0], r[2] or "")):
            size = len((r[2] or "").split())
            part = min(size, rest)
            rest -= part
            m = got[r[0]]
            assert (m["size"], m["source_size"], m["taken"]) == (size, words, epochs * size + part)
            assert abs(m["target"] - target[i]) < 1e-6 and m["taken"] <= 3 * size


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a", "w w w w", 1, "")] * 6 + [(None, "b", "v " * 50, 1, "")] * 2 + [(None, None, None, None, None)]
    first = [tuple(r["_mix"]) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()]
    again = [tuple(r["_mix"]) for r in mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()]
    assert len(first) == len(rows) and sorted(first) == sorted(again)
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA).where("false")).count() == 0


def test_quality_weights_decide(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"s{i % 2}", "a b c d", i % 10 < 5, "") for i in range(4000)]
    df = spark.createDataFrame([(a, b, c, int(d), e) for a, b, c, d, e in rows], SCHEMA)
    out = mixing.mix(df, weights=(1.0, 7.0), quality=F.when(F.col("size") == 1, 1.0).otherwise(0.25))
    taken = {r["size"]: r["t"] for r in out.where("source = 's0'").groupBy("size").agg(F.sum("_mix.taken").alias("t")).collect()}
    assert taken[1] > 2 * taken[0] > 0
