from sparkprep.llm import licenses

from .helpers import prose
from .test_decontamination import cut

SCHEMA = "doc_id long, text string, license string, band int"


def plain(text):
    """Licenses of which some run of words holds enough shingles: here whole templates only."""
    w, found = cut(text), set()
    for name, template in licenses.TEMPLATES:
        t = cut(template)
        for s in range(len(w) - len(t) + 1):
            if w[s : s + len(t)] == t:
                found.add((name, s, s + len(t)))
    return found


def test_every_template_is_found_anywhere(spark):
    rows = [(10 * i + k, prose(i, 37 * k) + "\n" + t.upper() + "\n" + prose(k, 50), "l", 1) for i, (_, t) in enumerate(licenses.TEMPLATES) for k in range(4)]
    rows += [(900, None, None, None), (901, "", "", 0), (902, prose(3, 5000), "", 0), (903, "All rights reserved.", "", 0), (None, rows[5][1], "", 0), (None, rows[5][1], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "_licenses"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        have = {(x["license"], x["start"], x["stop"]) for x in r["_licenses"]["found"]} if r["_licenses"] else set()
        want = plain(r["text"])
        assert want <= have, (want, have)
        assert {h[0] for h in have} == {w[0] for w in want} and all(x["containment"] >= 0.8 for x in (r["_licenses"] or {"found": []})["found"])


def test_a_changed_notice_is_found_and_a_far_one_is_not(spark):
    long = licenses.TEMPLATES[2][1].split()
    near = " ".join(w if i != 30 else "thing" for i, w in enumerate(long))
    far = " ".join(w if i % 6 else "thing" for i, w in enumerate(long))
    df = spark.createDataFrame([(1, near, "", 0), (2, far, "", 0)], SCHEMA)
    got = {r["doc_id"]: r["_licenses"] for r in licenses.scan(df).collect()}
    assert got[1]["found"][0]["license"] == "MIT" and got[2] is None
    assert licenses.scan(df.where("false")).count() == 0


def test_related_licenses_are_told_apart(spark):
    header = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    kinds = {"GPL-2.0": ("program", "General Public License", "2"), "GPL-3.0": ("program", "General Public License", "3"), "AGPL-3.0": ("program", "Affero General Public License", "3"),
             "LGPL-2.1": ("library", "Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "Lesser General Public License", "3")}
    df = spark.createDataFrame([(i, prose(i, 90) + "\n" + header.format(*k), "", 0) for i, k in enumerate(kinds.values())], SCHEMA)
    got = {r["doc_id"]: {x["license"] for x in r["_licenses"]["found"]} for r in licenses.scan(df).collect()}
    assert got == {i: {name} for i, name in enumerate(kinds)}
