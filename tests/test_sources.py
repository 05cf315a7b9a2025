import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from sparkprep import (
    clean, flatten, read_any, read_csv, read_excel, read_json, read_markdown_tables, read_text_docs, with_row_id,
    write,
)
from sparkprep.operators.convert import csv_to_json, json_to_csv
from sparkprep.sources import markdown_table, sniff_separator
from sparkprep.sources.csv import detect_encodings
from sparkprep.sources.text import markdown_rows


def put(tmp_path, name, text, binary=False):
    path = tmp_path / name
    path.write_bytes(text) if binary else path.write_text(text)
    return str(path)


def test_csv_all_text(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", "name,age,city\nAnn,30,Rome\nBob,25,Oslo\n"))
    assert df.dtypes == [("name", "string"), ("age", "string"), ("city", "string")]
    assert df.count() == 2


def test_csv_blank_lines_and_padding(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", "name,age\n\n  Ann  , 25 \n\n,\nBob,30\n"))
    assert [tuple(r) for r in df.collect()] == [("Ann", "25"), ("Bob", "30")]


def test_csv_header_only_and_errors(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", "name,age,city\n"))
    assert (df.count(), len(df.columns)) == (0, 3)
    with pytest.raises(ValueError):
        read_csv(spark, put(tmp_path, "empty.csv", ""))
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_csv_quotes_null_tokens_and_lengths(spark, tmp_path):
    text = 'name,description,z\nA,"one, two",1\nB,"say ""hi""",NA\nC\nD,x,y,surplus\nE,null,none\nF,a,b,\nG,a,b,,x\n'
    df = read_csv(spark, put(tmp_path, "a.csv", text))
    assert [tuple(r) for r in df.collect()] == [
        ("A", "one, two", "1"),
        ("B", 'say "hi"', None),
        ("C", None, None),
        ("E", None, "none"),
    ]


def test_csv_long_lines_go_whatever_their_surplus(spark, tmp_path):
    text = 'a,b\n1,2\n3,4,,,,,x\n5,6,\n5,6,,\n"7,,",8\n9,"x"",""y"\n' + "1," * 60 + "\n"
    df = read_csv(spark, put(tmp_path, "a.csv", text))
    assert [tuple(r) for r in df.collect()] == [("1", "2"), ("7,,", "8"), ("9", 'x","y')]
    assert df.select("a").count() == 3


def test_csv_line_breaks_in_quotes_by_default(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n2,"p\n,q\n"\n3\n4,5,"6\n7"\n'))
    assert [tuple(r) for r in df.collect()] == [("1", "x\ny"), ("2", "p\n,q"), ("3", None)]


def test_folders_lists_and_separators_of_read_any(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one, two = put(tmp_path, "in/a.csv", "a;b\n1;2\n"), put(tmp_path, "in/b.csv", "a;b\n3;4\n")
    for path in (str(tmp_path / "in"), [one, two]):
        assert sorted(tuple(r) for r in read_any(spark, path).collect()) == [("1", "2"), ("3", "4")]
    result = clean(str(tmp_path / "in"), {"source_options": {"sep": ","}}, spark=spark)
    assert len(result.df.columns) == 1
    put(tmp_path, "in/c.json", "[]")
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "in"))


def test_csv_strict_drops_short_lines_whatever_is_selected(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n1,2\n3\n4,5,6\n"7,8",9\n')
    df = read_csv(spark, path, on_bad_lines="strict")
    assert [tuple(r) for r in df.collect()] == [("1", "2"), ("7,8", "9")]
    assert df.select("a").count() == df.count() == 2


def test_csv_bad_bytes_and_duplicate_names(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a.csv", b"a,a,b\nx\xff,1,2\n", binary=True))
    assert df.columns == ["a", "a.1", "b"]
    assert df.collect()[0][0] == "x�"


def test_csv_separator_is_found(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a;b;c\n1;2;3\n")
    assert sniff_separator(spark, path) == ";"
    assert read_csv(spark, path, sep=None).collect()[0].asDict() == {"a": "1", "b": "2", "c": "3"}


def test_row_ids_have_no_gaps(spark, tmp_path):
    many = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    ids = [r[0] for r in with_row_id(many).orderBy("v").select("_row_id").collect()]
    assert ids == list(range(1000))
    shuffled = many.orderBy(F.rand(1))
    numbered = with_row_id(shuffled, order_by="v").orderBy("v")
    assert [r[0] for r in numbered.select("_row_id").collect()] == list(range(1000))
    path = put(tmp_path, "a.csv", "v\n" + "\n".join(map(str, range(50))) + "\n")
    scanned = with_row_id(read_csv(spark, path))
    assert [(r[0], r[1]) for r in scanned.orderBy("_row_id").collect()] == [(str(i), i) for i in range(50)]


@pytest.mark.parametrize(
    "document, expected",
    [
        ([{"name": "a", "age": 1}, {"name": "b", "age": 2}], 2),
        ({"records": [{"name": "a"}, {"name": "b"}]}, 2),
        ({"rows": [{"name": "a"}], "data": [{"name": "x"}, {"name": "y"}]}, 2),
        ({"name": "a", "age": 1}, 1),
        ({"data": {"x": 1}, "name": "b"}, 1),
    ],
)
def test_json_layouts(spark, tmp_path, document, expected):
    compact = read_json(spark, put(tmp_path, "a.json", json.dumps(document)))
    pretty = read_json(spark, put(tmp_path, "b.json", json.dumps(document, indent=2)))
    assert compact.count() == pretty.count() == expected


def test_json_lines_empty_and_invalid(spark, tmp_path):
    lines = read_json(spark, put(tmp_path, "a.json", '{"a": 1}\n{"a": 2}\n'))
    assert lines.count() == 2
    assert read_json(spark, put(tmp_path, "b.json", "")).count() == 0
    for bad in ("{not json", "5", '[{"a": 1}, oops'):
        with pytest.raises(ValueError):
            read_json(spark, put(tmp_path, "c.json", bad))
    with pytest.raises(FileNotFoundError):
        read_json(spark, str(tmp_path / "none.json"))


def test_json_nested_records_flatten(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps({"data": [{"name": "a", "details": {"age": 3, "city": "Rome"}}]}))
    assert flatten(read_json(spark, path)).select("name", "details_age", "details_city").collect()[0] == ("a", 3, "Rome")


def test_text_documents(spark, tmp_path):
    path = put(tmp_path, "a.md", b"\r\n# T\r\n\n\n\n\nbody\n\n", binary=True)
    row = read_any(spark, path).collect()[0]
    assert (row["text"], row["lines"]) == ("# T\n\nbody", 3)
    assert read_text_docs(spark, path).count() == 1


def test_markdown_tables(spark, tmp_path):
    text = "# x\n\n| a | b |\n|---|:--|\n| 1 | 2 |\n| 3 | 4 |\n\ntext | no table\n\na | c\n-|-\n5 | 6\n\n|a|b|\n|-|-|\n|7|\n"
    found = read_markdown_tables(spark, put(tmp_path, "a.md", text))
    rows = [(r["table"], r["row"], r["header"], r["cells"]) for r in found.orderBy("table", "row").collect()]
    assert rows == [
        (0, 0, ["a", "b"], ["1", "2"]), (0, 1, ["a", "b"], ["3", "4"]),
        (1, 0, ["a", "c"], ["5", "6"]), (2, 0, ["a", "b"], ["7"]),
    ]
    ab = [tuple(r) for r in markdown_table(found, ["a", "b"]).collect()]
    assert sorted(ab, key=str) == [("1", "2"), ("3", "4"), ("7", None)]


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, sheets):
    """A small workbook: shared texts, a number, a date, a boolean."""
    names = "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(1, len(sheets) + 1))
    rels = "".join(
        f'<Relationship Id="r{i}" Type="x" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            f"<sheets>{names}</sheets></workbook>",
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t> Ann </t></si></sst>')
        for i, rows in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", SHEET.format(rows))


def test_excel_sheets_are_stacked(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    text = lambda ref, value: f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    first = (
        f'<row><c r="A1" t="s"><v>0</v></c>{text("B1", "age")}{text("C1", "day")}</row>'
        '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>30</v></c><c r="C2" s="1"><v>45292</v></c></row>'
        '<row><c r="B3"><v>2.5</v></c></row><row/>'
    )
    second = f'<row>{text("A1", "name")}{text("B1", "ok")}</row><row>{text("A2", "Bob")}<c r="B2" t="b"><v>1</v></c></row>'
    empty = f'<row>{text("A1", "nothing")}</row>'
    workbook(path, [first, second, empty])
    df = read_excel(spark, path)
    assert df.columns == ["name", "age", "day", "ok"]
    assert sorted(map(tuple, df.collect()), key=str) == [
        ("Ann", "30", "2024-01-01 00:00:00", None), ("Bob", None, None, "True"), (None, "2.5", None, None),
    ]


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        read_any(spark, "/tmp/file.pdf")


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", [1, 2]), (2, None, [])], "id long, s string, l array<int>")
    write(df, str(tmp_path / "c"), "csv")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "c")).orderBy("id").collect()] == [
        ("1", "a,b", "[1,2]"), ("2", None, "[]"),
    ]
    write(df, str(tmp_path / "j"), "json")
    assert read_json(spark, str(tmp_path / "j")).count() == 2
    write(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).schema["l"].dataType.simpleString() == "array<int>"
    with pytest.raises(ValueError):
        write(df, str(tmp_path / "x"), "xml")


def test_csv_to_json(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Full Name, Value\nAnn ,null\nBob,3.5\n\"\",\nCid,n/a\n")
    meta = csv_to_json(spark, path, str(tmp_path / "out")).collect()[0]
    assert (meta["source"], meta["rows"], meta["columns"]) == ("csv", 3, ["full_name", "value"])
    out = read_json(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, out.select("full_name", "value").collect())) == [("Ann", None), ("Bob", 3.5), ("Cid", None)]


def test_json_to_csv(spark, tmp_path):
    records = [{"Name": "a", "details": {"age": 3, "tags": [1]}}, {"Name": "NULL", "details": {"age": None, "tags": []}}]
    path = put(tmp_path, "a.json", json.dumps({"records": records}))
    json_to_csv(spark, path, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert sorted(back.columns) == ["details_age", "details_tags", "name"]
    assert sorted(map(tuple, back.select("name", "details_age", "details_tags").collect()), key=str) == [
        ("a", "3", "[1]"), (None, None, "[]"),
    ]
    for bad in ("[]", "", '{"other": 1}'):
        with pytest.raises(ValueError):
            json_to_csv(spark, put(tmp_path, "b.json", bad), str(tmp_path / "bad"))


JSON_ROWS = [{"id": i, "s": ['}{"', "a]b", "\\", 'q"', "é\n{"][i % 5], "o": {"x": [i, {"y": {}}]}, "e": {}} for i in range(80)]


def json_documents():
    one = [json.dumps(r) for r in JSON_ROWS]
    pretty = [json.dumps(r, indent=2, ensure_ascii=False) for r in JSON_ROWS]
    return {
        "list": json.dumps(JSON_ROWS),
        "pretty list": "\n " + json.dumps(JSON_ROWS, indent=3) + "\n",
        "lines": "\n".join(one),
        "lines, one broken over two": "\n".join(one[:50] + pretty[50:51] + one[51:]) + "\n",
        "pretty objects": "\n".join(pretty),
        "objects on one line": "".join(one),
        "wrapped": json.dumps({"n": 3, "t": "a, b", "items": JSON_ROWS, "next": None}),
        "wrapped, pretty": json.dumps({"data": JSON_ROWS}, indent=1) + "\r\n",
        "wrapped behind an object": json.dumps({"meta": {"page": 1}, "rows": JSON_ROWS}),
        "better key later": json.dumps({"rows": [{"z": 1}], "records": JSON_ROWS}),
    }


@pytest.mark.parametrize("name", list(json_documents()))
def test_json_records_of_every_layout(spark, tmp_path, name, size="997b"):
    """Cut at any byte: a range may begin inside a string, an escape or a nested object."""
    path = put(tmp_path, "a.json", json_documents()[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = read_json(spark, path)
        got = {r["id"]: (r["s"], [json.loads(x) for x in r["o"]["x"]]) for r in df.collect()}
        assert df.count() == len(JSON_ROWS) and "z" not in df.columns
        assert got == {r["id"]: (r["s"], r["o"]["x"]) for r in JSON_ROWS}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    "damage",
    [
        "a", '{"a": 1}\n{"a": oops}\n' + '{"a": 2}\n' * 50, '{"a": 1},\n{"a": 2},\n', '{"a": 1}\n{"a": 2}}\n{"a": 3}\n', '[{"a": 1} {"a": 2}]',
        '[{"a": 1}, {"a": 2},]', '[{"a": 1}] [{"a": 2}]', '{"a": 1}\n{"a": "open}\n{"a": 2}\n', '[{"a": 1}, 5]', '{"data": [{"a": 1}], oops',
    ],
)
def test_damaged_json_is_an_error(spark, tmp_path, damage):
    with pytest.raises(ValueError):
        read_json(spark, put(tmp_path, "a.json", damage)).collect()


def test_json_folder_of_mixed_layouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path, "in/a.json", '{"a": 1}\n{"a": 2}\n')
    put(tmp_path, "in/b.json", json.dumps([{"a": 3}, {"a": 4}], indent=2))
    put(tmp_path, "in/c.json", json.dumps({"items": [{"a": 5}]}))
    put(tmp_path, "in/d.json", '{"a": 6}')
    put(tmp_path, "in/e.json", "[]")
    got = read_json(spark, str(tmp_path / "in"))
    assert sorted(r["a"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]


def test_one_large_list_is_read_by_many_tasks(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps(JSON_ROWS))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        from sparkprep.sources.json_records import _pieces

        assert _pieces(spark, path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_folder_maps_columns_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path, "in/a.csv", "a,b\n1,x\n2,y\n")
    put(tmp_path, "in/b.csv", 'b,a\n"z, q",3\n')
    put(tmp_path, "in/c.csv", "a,b\n4,w\n")
    got = read_csv(spark, str(tmp_path / "in"))
    assert got.columns == ["a", "b"] or got.columns == ["b", "a"]
    assert sorted(got.select("a", "b").collect()) == [("1", "x"), ("2", "y"), ("3", "z, q"), ("4", "w")]
    put(tmp_path, "in/d.csv", "a,c\n5,v\n")
    with pytest.raises(ValueError, match="columns"):
        read_csv(spark, str(tmp_path / "in"))


def plain_tables(text):
    """(table, row, header, cells) of a document, by a loop over its lines."""
    rule = lambda x: "|" in x and re.match(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$", x.strip(" "))
    cells = lambda x: [c.strip(" ") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||\|$", "", x.strip(" ")))]
    lines, header, tables = re.split("\r?\n", text), None, []
    for at, line in enumerate(lines):
        if "|" not in line:
            header = None
        elif not rule(line) and at + 1 < len(lines) and rule(lines[at + 1]):
            header = cells(line)
            tables.append((header, []))
        elif header is not None and not rule(line):
            tables[-1][1].append(cells(line))
    full = [t for t in tables if t[1]]
    return [(k, i, head, row) for k, (head, rows) in enumerate(full) for i, row in enumerate(rows)]


def test_markdown_tables_stay_in_their_row(spark):
    rng = random.Random(9)
    kinds = ["a | b", "|x|y|z|", "|---|---|", ":-: | -", "text", "", "| p \\| q | r |", "---", " |1| 2|", "|"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += ["", "|a|b|\r\n|-|-|\r\n|1|2|", "|a|\n|-|", "|h|g|\n|-|-|\n" + "| 1 | 2 |\n" * 20_000]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "path string, text string")
    rows = markdown_rows(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in rows.collect():
        found.setdefault(r["path"], []).append((r["table"], r["row"], r["header"], r["cells"]))
    want = {str(i): plain_tables(t) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
    # Documents of the same name stay apart.
    twice = markdown_rows(spark.createDataFrame([("p", "|a|b|\n|-|-|\n|1|2|")] * 2, "path string, text string"))
    assert [(r["table"], r["row"], r["cells"]) for r in twice.collect()] == [(0, 0, ["1", "2"])] * 2
    assert markdown_rows(docs.limit(0)).count() == 0


def test_csv_encodings_are_found_for_each_file(spark, tmp_path):
    text = "name,city\nJosé,Århus\nZoë,\"Kö,ln\"\n"
    written = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
    want = [("José", "Århus"), ("Zoë", "Kö,ln")]
    for name in written:
        path = put(tmp_path, f"{name}.csv", text.encode(name), True)
        assert list(detect_encodings(spark, path)) == [written[name]], name
        df = read_csv(spark, path, encoding=None)
        assert (df.columns, [tuple(r) for r in df.collect()]) == (["name", "city"], want), name
    # A byte that is not UTF-8 in the last line decides as well; another order of columns; a file without bytes.
    put(tmp_path, "late.csv", b"city,name\n" + b"Rome,Ann\n" * 5000 + b"K\xf6ln,Zo\xeb\n", True)
    put(tmp_path, "none.csv", b"", True)
    rows = read_csv(spark, str(tmp_path), encoding=None).groupBy("name", "city").count().collect()
    assert {(r["name"], r["city"]): r["count"] for r in rows} == {want[0]: 6, want[1]: 6, ("Ann", "Rome"): 5000, ("Zoë", "Köln"): 1}
    put(tmp_path, "other.csv", "name,town\nJosé,x\n".encode("latin-1"), True)
    with pytest.raises(ValueError, match="share their columns"):
        read_csv(spark, str(tmp_path), encoding=None)
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "absent.csv"), encoding=None)


@pytest.mark.parametrize("name", ["json_lists", "json_wrapped", "json_concatenated"])
def test_json_queries_hold_one_document_a_file(spark, tmp_path, name):
    """Events in many partitions: no file may get two lists, and none is left without its rows."""
    text = F.concat(F.lit("t"), F.col("id").cast("string"))
    events = spark.range(0, 2_000_300, 2_003).select(
        F.col("id").alias("event_id"), (F.col("id") % 13).alias("user_id"), text.alias("event_type"),
        (F.col("id") / 4).alias("value"), F.format_string('{"k": "a}b, %s"}', text).alias("props"),
    )
    events.repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(got.collect()) == sorted(events.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
