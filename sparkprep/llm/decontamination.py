"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (one window of all words if it has fewer).
A window occurs in a document if all its shingles do, in place; as all of them are necessary, the prefix that
has to be joined is one shingle, and the rarest is taken: shingles are ordered by how often the documents
hold them. A matching shingle gives the place where the window must start; windows that would begin before the
document or end after it are left out by their length and position, and the words there are compared with the
window's own, so hits are exact whatever the hashes.

Documents are scanned twice (rarity, join) and never shuffled: both scans meet the benchmark's side by
broadcast, in blocks of at most ``BLOCK`` pairs of window and item, so a larger benchmark takes more scans, not
more memory. Only hits are grouped, by document, and were put together inside their task before. A passage that
a third of all documents share is therefore found in each by the task that reads it.

Defined results: null and empty texts have no words and no hits; an item without words has no windows. Repeated
documents are marked alike. Items without id mark words, but are not listed or counted; equal ids count as one
item. An empty benchmark or an empty table of documents gives no hits. Other columns stay as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from .text import attach, column, doc_keys, keep, whole

WINDOW = 10
SHINGLE = 5

#: Pairs of window and item in one broadcast (some 200 bytes each).
BLOCK = 250_000

#: Contaminated documents (some 100 bytes each) up to which they are broadcast to the documents.
BROADCAST_HITS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def rolled(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows with their words, length and the ids of the items that hold them."""
    w = benchmark.select(column(item).alias("item"), item_words(whole(column(text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row for each document that holds a window: its keys (see ``doc_keys``), the spans of words (start
    inclusive, end exclusive, sorted, they may overlap) and the items' ids."""
    wins = benchmark_windows(benchmark, item, item_text, window)
    wins = wins.withColumn("length", F.size("words")).withColumn("window", F.array_join("words", " "))
    wins = keep(wins.withColumn("block", F.xxhash64("window")), "decontamination-windows")
    size = wins.select(F.sum(F.size("items") + 1).alias("n")).first()["n"] or 0
    lengths = [r["m"] for r in wins.select(F.least("length", F.lit(SHINGLE)).alias("m")).distinct().collect()]
    blocks = max(1, -(-size // BLOCK))
    found = [
        _find_block(docs, wins.where(F.pmod("block", F.lit(blocks)) == b), sorted(lengths), key, text)
        for b in range(blocks)
    ]
    hits = functools.reduce(DataFrame.unionByName, found)
    if blocks > 1:
        hits = hits.groupBy("_k1", "_k2").agg(
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return hits.withColumn("spans", F.array_sort("spans"))


def _find_block(docs: DataFrame, wins: DataFrame, lengths: list[int], key: str, text: str) -> DataFrame:
    lengths = lengths or [SHINGLE]
    own = [rolled(F.col("words"), m) for m in lengths]
    scanned = docs.select(*doc_keys(key, text), item_words(whole(column(text))).alias("words"))
    placed = scanned.select("_k1", "_k2", "words", *[h.alias(f"_h{m}") for m, h in zip(lengths, own)])

    # the shingles of each window, with their places
    per_window = F.coalesce(*[F.when(F.least("length", F.lit(SHINGLE)) == m, h) for m, h in zip(lengths, own)])
    tokens = wins.select("window", F.posexplode(per_window).alias("offset", "h"))

    # how often documents hold them; outer, as a filter on the array's size would compute it a second time
    wanted = F.broadcast(tokens.select("h").distinct())
    held = functools.reduce(
        DataFrame.unionByName, [placed.select(F.explode_outer(f"_h{m}").alias("h")).join(wanted, "h", "left_semi") for m in lengths]
    )
    counts = keep(held.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "decontamination-counts")

    # the rarest shingle of each window; windows with one that no document holds cannot occur
    rarest = (
        tokens.join(counts, "h", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("r"))
        .where("r.n > 0")
    )
    prefix = F.broadcast(wins.join(rarest, "window").select("window", "length", "items", "r.h", "r.offset"))
    matches = []
    for m in lengths:
        at = placed.select("_k1", "_k2", "words", F.posexplode_outer(f"_h{m}").alias("place", "h"))
        start = F.col("place") - F.col("offset")
        joined = at.join(prefix.where(F.least("length", F.lit(SHINGLE)) == m), "h")
        fits = (start >= 0) & (start + F.col("length") <= F.size("words"))
        same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("window")
        span = F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span")
        matches.append(joined.where(fits).where(same).select("_k1", "_k2", span, "items"))
    hits = functools.reduce(DataFrame.unionByName, matches)
    return hits.groupBy("_k1", "_k2").agg(
        F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )


def covered(spans: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", into: str = "_hits", columns: list[str] | None = None, **named) -> DataFrame:
    """``docs`` with a struct column ``into``: n_hit, n_items and items_text (the ids, sorted as strings, joined
    by commas); null for documents without hits. ``columns``: those of ``docs`` to return, all if not given; if
    the text is not among them, it is not carried through the join."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    found = find(docs, benchmark, key, text, **named).select(
        "_k1", "_k2", covered(F.col("spans")).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.array_join(ids, ",").alias("items_text"),
    )
    found = keep(found, "decontamination-hits")
    return attach(docs, found, key, text, docs.columns if columns is None else columns, into, BROADCAST_HITS)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    marked = mark(docs, benchmark, key, text, into="_hits_of_benchmark", **named)
    return marked.where(F.col("_hits_of_benchmark").isNull()).drop("_hits_of_benchmark")
