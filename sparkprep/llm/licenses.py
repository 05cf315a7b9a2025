"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of n words is looked for in windows of ``2 s`` words that start every ``s`` words, s being the smallest
power of two that is at least n and 4, so every occurrence lies whole in a window. From the number of its shingles
follows the least similarity j that a window with an occurrence can have. Bands have one row each, and a template
gets so many that such a window is retrieved with probability ``1 - (1 - j)^bands >= RECALL``. What is retrieved is
verified: at least ``CONTAINMENT`` of the template's shingles must stand in the window.

A band of a window equals the template's exactly if the shingle that gives the template's value stands in the
window and no shingle there has a smaller value. So only windows around such a shingle need their MinHash
value; they are found by joining the shingles of a text with the few that give the templates' values, and
the value of the window is computed there. Texts are read once more to attach the result, and never shuffled. The
templates are a list given to the driver, so what is broadcast (some dozens of rows for each) does not grow with the data.

Defined results: null and empty texts match nothing. A template of fewer than five words is one shingle of all its words;
one without words is left out. Equal documents get equal results. An empty table gives an empty result. Other columns stay as they are;
the result is a struct column, null where nothing matches.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontamination import item_words, rolled
from .text import attach, column, doc_keys, keep, whole

SHINGLE = 5
RECALL = 0.9999
CONTAINMENT = 0.8

#: Documents with a license (some 200 bytes each) up to which they are broadcast to the documents.
BROADCAST_HITS = 200_000

# Notices as they are written in practice.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("reserved", "All rights reserved."),
)

#: Words that tell related licenses apart: where a template has them, a shingle of it that does must be found.
NEEDED = ("gnu general public", "gnu affero general", "gnu lesser general", "version 3", "version 2 1", "version 2 of")


def _templates(spark: SparkSession, templates, size: int) -> DataFrame:
    """Templates whose shingles have ``size`` words: license, stride, distinct shingles."""
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in templates])
    rows = spark.range(1).select(F.explode(listed).alias("t")).select("t.license", item_words(F.col("t.text")).alias("w"))
    rows = rows.where(F.least(F.size("w"), F.lit(SHINGLE)) == size)
    stride = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("w"), F.lit(4))))).cast("int")
    rows = rows.select("license", "w", stride.alias("stride"), rolled(F.col("w"), size).alias("all"))

    def having(words: str):  # shingles of the template that hold these words
        at = lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i + 1, size), " "), F.lit(" "))
        return F.filter("all", lambda h, i: F.contains(at(i), F.lit(f" {words} ")))

    must = F.filter(F.array(*[having(words) for words in NEEDED]), lambda m: F.size(m) > 0)
    return rows.select("license", "stride", F.array_distinct("all").alias("wanted"), must.alias("must"))


def _bands(templates: DataFrame, size: int, containment: float, recall: float) -> DataFrame:
    """For each template and band the least value and the shingle that gives it."""
    held = containment * F.size("wanted")
    least = held / (2 * F.col("stride") - size + 1 + F.size("wanted") - held)
    bands = F.ceil(math.log(1 - recall) / F.ln(1 - F.least(least, F.lit(0.999)))).cast("int")
    each = templates.withColumn("band", F.explode(F.sequence(F.lit(1), bands)))
    least = F.array_min(F.transform("wanted", lambda x: F.struct(F.xxhash64(x, F.col("band")).alias("value"), x.alias("h"))))
    each = each.select("license", "stride", "wanted", "must", "band", least.alias("least"))
    return each.select("license", "stride", "wanted", "must", "band", "least.value", "least.h")


def find(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """One row for each document with a license: _k1, _k2 and ``found``, a sorted array of license, start and stop
    (words, end exclusive) and containment."""
    spark = docs.sparkSession
    scanned = docs.select(*doc_keys(key, text), item_words(whole(column(text))).alias("words"))
    matches = [_matches(scanned, _templates(spark, templates, m), m, containment, recall) for m in _sizes(spark, templates)]
    found = functools.reduce(DataFrame.unionByName, matches).groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_set("found")).alias("found")
    )
    # of different licenses on the same words (half of the shorter span) the best stays, equal ones all
    shared = lambda a, b: 2 * (F.least(a["stop"], b["stop"]) - F.greatest(a["start"], b["start"])) >= F.least(a["stop"] - a["start"], b["stop"] - b["start"])
    beaten = lambda a: F.exists("found", lambda b: (a["license"] != b["license"]) & (b["containment"] > a["containment"]) & shared(a, b))
    return found.withColumn("found", F.filter("found", lambda a: ~beaten(a)))


def _sizes(spark: SparkSession, templates) -> list[int]:
    """Lengths of shingles that the templates need: five words, or all of a shorter one."""
    listed = F.array(*[F.lit(t) for _, t in templates])
    n = F.least(F.size(item_words(F.col("t"))), F.lit(SHINGLE)).alias("n")
    sizes = spark.range(1).select(F.explode(listed).alias("t")).select(n).where("n > 0").distinct().collect()
    return sorted(r["n"] for r in sizes) or [SHINGLE]


def _matches(scanned: DataFrame, templates: DataFrame, size: int, containment: float, recall: float) -> DataFrame:
    placed = scanned.select("_k1", "_k2", rolled(F.col("words"), size).alias("hashes"))
    # outer, as a filter on the array's size would compute the array a second time
    at = placed.select("_k1", "_k2", "hashes", F.posexplode_outer("hashes").alias("place", "h"))
    near = at.join(F.broadcast(_bands(templates, size, containment, recall)), "h")
    number = F.floor(F.col("place") / F.col("stride")).cast("int")
    near = near.withColumn("number", F.explode(F.array(number, number - 1)))
    first = F.col("number") * F.col("stride")
    near = near.withColumn("first", first).where((first >= 0) & (F.col("place") <= first + 2 * F.col("stride") - size))
    window = F.slice("hashes", F.col("first") + 1, 2 * F.col("stride") - size + 1)
    near = near.select("_k1", "_k2", "license", "wanted", "must", "band", "value", "first", window.alias("window"))
    near = near.where(F.array_min(F.transform("window", lambda x: F.xxhash64(x, F.col("band")))) == F.col("value"))
    near = near.where(F.forall("must", lambda m: F.arrays_overlap(m, F.col("window"))))
    share = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
    here = F.filter(F.transform("window", lambda x, i: F.when(F.array_contains("wanted", x), i)), lambda i: i.isNotNull())
    near = near.select("_k1", "_k2", "license", "first", share.alias("share"), here.alias("here")).where(F.col("share") >= containment)
    start = F.col("first") + F.array_min("here")
    stop = F.col("first") + F.array_max("here") + size
    found = F.struct("license", start.alias("start"), stop.alias("stop"), F.col("share").alias("containment"))
    return near.select("_k1", "_k2", found.alias("found"))


def scan(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text", into: str = "_licenses", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``into`` whose field ``found`` lists the licenses with their spans of words; null
    if there are none. ``columns``: those of ``docs`` to return, all if not given."""
    found = keep(find(docs, templates, key, text), "license-hits")
    return attach(docs, found, key, text, docs.columns if columns is None else columns, into, BROADCAST_HITS)
