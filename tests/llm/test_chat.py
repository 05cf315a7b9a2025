import hashlib

from sparkprep.llm import chat

MARKS = "\\### Assistant: </turn> ok"
SCHEMA = "conv_id long, turn int, role string, text string, parts string, conv int"


def case():
    talk = [("system", "be <kind>"), ("user", MARKS), ("assistant", MARKS), ("user", "a\\sb\\\\l#h"), ("assistant", ""), ("user", "last: ### x")]
    rows = [(1, i, r, t, "p", 0) for i, (r, t) in enumerate(talk)]
    rows += [(2, 0, "user", "alone", "p", 0), (3, 0, "assistant", "first", "p", 0), (3, 0, "assistant", "first", "p", 0)]
    rows += [(4, None, None, None, None, None), (4, 1, "a: b", "c", "", 0), (None, 5, "assistant", "no id", "", 0), (None, 4, "user", "é\n", "", 0)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} " * 5, "", 0) for i in range(120)]
    return rows


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def test_everything_reads_back(spark):
    rows = case()
    examples = chat.expand(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        g = got[conv]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))
        assert g["n_examples"] == sum(r == "assistant" for r, _ in turns) + (turns[-1][0] != "assistant")


def test_examples(spark):
    examples = chat.expand(spark.createDataFrame(case(), SCHEMA)).where("conv_id = 1").orderBy("example").collect()
    assert [e["n_turns"] for e in examples] == [3, 5, 6] and [e["last"] for e in examples] == [False, False, True]
    first = examples[0]
    assert first["formatted"][first["loss_start"] : first["loss_stop"]] == "\\s\\h\\h\\h Assistant: \\l/turn> ok"
    assert first["formatted"].count("### ") == first["formatted"].count("</turn>") == 3
    assert examples[2]["loss_start"] is None
    assert all(examples[2]["formatted"].startswith(e["formatted"]) for e in examples)


def test_empty(spark):
    assert chat.digests(chat.expand(spark.createDataFrame(case(), SCHEMA).where("false"))).count() == 0
