import re

from sparkprep.llm import pii

from .helpers import prose

SCHEMA = "doc_id long, text string, m_email string, _t int"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [
        f"{k}:{m.start()}:{m.end()}" for k, f in FORMS.items() for m in re.finditer(f, text or "") if good(k, m[0])
    ]


TEXTS = [
    None, "", "no data here", "a@b.c", "über a.b+c@mail-1.example.com, x@y and z@w.d@e.f.", "%x@e.fg%y@h.ij", "a@b.cd%x@e.fg",
    "1.2.3.4 255.255.255.255 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.0255 .1.2.3.4", "4111 1111 1111 1111 and 4111111111111112",
    "4111-1111-1111-1111 4111111111111111", "+1 (743) 555-3824, +49.30.1234567 190 +1 2 +123456789012345678", "+1 (826) 555-4081 190.",
    "++1 22 33 44 55", "x" * 30_000, "7" * 5000, "a@" + "b." * 4000 + "c", "me@x.org " * 700, "日本 a@b.jp 𝒳 1.1.1.1",
]


def test_strict_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "m", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None)] * 2, SCHEMA)
    detected = pii.detect(df)
    assert detected.columns == [*df.columns, "_candidates"]
    model = pii.fit(detected)
    rows = pii.label(detected, model).withColumn("base", pii.spans_text(pii.F.filter("_spans", lambda s: s["strict"]))).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r["base"].split(",") if r["base"] else []) == plain(r["text"])


def test_labelers_add_what_they_agree_on(spark):
    rows = [(i, f"please call me at (743) 555-38{i:02d} or mail a{i}@b.com", "", 0) for i in range(50)]
    rows += [(100 + i, f"version 743-555-38{i:02d} of part", "", 0) for i in range(50)]
    rows += [(200, "write to joe [at] example [dot] com", "", 0), (201, prose(1, 200), "", 0)]
    detected = pii.detect(spark.createDataFrame(rows, SCHEMA))
    model = pii.fit(detected)
    out = {r["doc_id"]: r["s"] for r in pii.label(detected, model).withColumn("s", pii.spans_text(pii.F.col("_spans"))).collect()}
    assert all(out[i].startswith("email:") and "phone:18:32" in out[i] for i in range(50))
    assert not any(out[100 + i] for i in range(50)) and out[201] == ""
    assert all(0.5 < a < 1 and 0.5 < b < 1 for a, b in model.reliability.values())


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, "m", i) for i, t in enumerate(TEXTS)], SCHEMA)
    model = pii.fit(pii.detect(df))
    rows = {r["doc_id"]: r for r in pii.redact(df, model).collect()}
    assert rows[0]["text"] is None and rows[2]["text"] == TEXTS[2] and rows[9]["m_email"] == "m"
    for i, text in enumerate(TEXTS):
        for kind, form in FORMS.items():
            text = text and re.sub(form, lambda m: f"[{kind.upper()}]" if good(kind, m[0]) else m[0], text)
        assert rows[i]["text"] == text


def test_empty_table_and_clean_texts(spark):
    df = spark.createDataFrame([(1, "nothing", "", 0)], SCHEMA)
    for one in (df, df.where("false")):
        detected = pii.detect(one)
        model = pii.fit(detected)
        assert model.weights == {}
        assert [r["_spans"] for r in pii.label(detected, model).collect()] == [[]] * one.count()
        assert pii.redact(one, model).count() == one.count()


def test_redaction_masks_all_of_overlapping_spans(spark):
    texts = ["+33.1.23.45.67.89", "tel +33.1.23.45.67.89, 𝒳" + " é" * 300 + " 4111111111111111@b.org x", "+4111 1111 1111 1111", None,
             "call (743) 555-3824 +33.1.23.45.67.89 " * 400 + "end", "a@b.cd%x@e.fg +1.2.3.4.5.6.7.8"]
    df = spark.createDataFrame([(i, t, "m", i) for i, t in enumerate(texts)], SCHEMA)
    detected = pii.detect(df)
    model = pii.fit(detected)
    spans = {r["doc_id"]: r["_spans"] for r in pii.label(detected, model).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert got[0] == "[PHONE]" and got[3] is None and {(s["kind"], s["start"], s["stop"]) for s in spans[0]} == {(1, 1, 11), (3, 0, 17)}
    for i, text in enumerate(texts):
        out, upto = "", 0
        for start, back, kind in sorted((s["start"], -s["stop"], s["kind"]) for s in spans[i]):
            if start >= upto:
                out += text[upto:start] + f"[{pii.KINDS[kind].upper()}]"
            upto = max(upto, -back)
        assert got[i] == (text and out + text[upto:])


def test_guards_change_no_result(spark, monkeypatch):
    """A guard only spares texts that no match can be in, whatever else they say."""
    from dataclasses import replace

    texts = [
        "WRITE: MAIL JOE [AT] EXAMPLE [DOT] COM NOW", "mail joe [at] example [dot] com, that", "MAIL JOE [AT] EXAMPLE [DOT] COM, that",
        "server 2001:0db8:0000:0000:0000:0000:0000:0001 x", "call 212 555 0123", "a.b@c.de 10.0.0.1 +1 (743) 555-3824", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    on = [tuple(r) for r in pii.detect(docs).orderBy("doc_id").collect()]
    assert [len(r[2]) for r in on[:3]] == [1, 1, 1]
    monkeypatch.setattr(pii, "PATTERNS", tuple(replace(p, guard=()) for p in pii.PATTERNS))
    assert [tuple(r) for r in pii.detect(docs).orderBy("doc_id").collect()] == on
