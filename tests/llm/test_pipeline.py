"""The pipeline's stages against plain Python, each on what the one before it kept."""

import re

import corpus_pipeline

from . import test_decontamination, test_mixing, test_near_duplicates, test_pii, test_quality_rules
from .helpers import changed, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def case():
    items = [(i, prose(500 + i, 30)) for i in range(4)]
    texts = [prose(i, 120) for i in range(30)]
    texts += [texts[0], texts[0], changed(texts[1], 1, 0.02), changed(texts[1], 2, 0.02), changed(texts[2], 3, 0.3)]
    texts += ["short", "", None, "again and again " * 60, texts[3] + " " + items[0][1], items[1][1] + " " + texts[4]]
    texts += [texts[5] + " mail a.b@c.de or +1 (743) 555-3824 now.", prose(99, 150) + " 10.0.0.1."]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6]], items


def plain(rows, items):
    """Rows after rules, near duplicates, decontamination and redaction."""
    out = []
    for r in rows:
        n, chars, symbols, _, repeats = test_quality_rules.plain(r[1])
        if n >= 50 and 100 * repeats <= 50 * n:
            out.append(r)
    stages = [sorted(out, key=str)]
    docs = {r[0]: r[1] for r in out}
    top = {t for _, t in test_near_duplicates.plain(docs).values()}
    out = list({r[0]: r for r in out if r[0] in top}.values())
    stages.append(sorted(out, key=str))
    out = [r for r in out if not test_decontamination.plain(r[1], items)[0]]
    stages.append(sorted(out, key=str))
    redacted = []
    for r in out:
        text = r[1]
        for kind, form in test_pii.FORMS.items():
            text = re.sub(form, lambda m: f"[{kind.upper()}]" if test_pii.good(kind, m[0]) else m[0], text)
        redacted.append((r[0], text, r[2], r[3], len(text)))
    stages.append(sorted(redacted, key=str))
    return stages


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = case()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows, items)
    assert len(want[0]) > len(want[1]) > len(want[2]) > 20
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES, want):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        assert sorted((tuple(r) for r in docs.collect()), key=str) == rows_wanted, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {}
    for r in want[3]:
        sizes.setdefault(r[3], []).append(len(r[1].split()))
    names = sorted((n for n in sizes if n is not None)) + [None]
    target = test_mixing.filled([sum(sizes[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, n in enumerate(names):
        assert sum(r["taken"] for r in last if r["source"] == n) == round(target[i])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, last), key=str)


def test_empty_documents(spark, tmp_path):
    _, items = case()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_very_long_texts(spark, tmp_path):
    """Columns named as the stages' own, or with a dot, come through; a long text is kept whole; the benchmark may be empty."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = ["_broken", "_quality", "_mix", "size", "Taken", "a.b", "_k1", "id", "near_group"]
    rows = [(i, prose(i, 30_000 if i == 3 else 90), "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in more]) for i in range(12)]
    schema = SCHEMA + ", " + ", ".join(f"`{c}` string" for c in more)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *more, "_size", "source_size", "target", "_taken"]
    out.write.parquet(f"{tmp_path}/out")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 3 in got and got[3]["text"] == rows[3][1] and got[3]["_size"] == len(rows[3][1].split())
    assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in more)
