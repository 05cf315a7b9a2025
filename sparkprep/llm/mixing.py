"""Mixing sources to target weights by weighted sampling without replacement.

Every source has a weight and shares the whole budget of words by it. No source is asked for more than ``cap``
times its own words; what it cannot take is shared again among the others by weight. A source first takes as
many complete epochs as fit into its target. The fraction that remains is drawn by exponential keys
``-ln(u) / quality`` (Efraimidis and Spirakis): in the order of the keys documents are taken whole until the
budget is reached; of the document at the boundary only the missing words count as taken. ``u`` comes from a
digest of the document's id, so the same documents give the same mix, whatever the partitions.

Only (source, size, key) of each document is ever shuffled. The keys of a source with n documents are dealt to
about sqrt(n) buckets in the order of the keys, and only the bucket that holds the boundary is sorted; so a
source with a third of all rows is neither sorted nor gathered by one task. What goes back to the documents is one
row per source: it is broadcast up to ``BROADCAST_SOURCES`` sources and left to the optimiser beyond.

Defined results: a null source is a source of its own, last in order. A null or empty text has size 0 and is
taken 0 times; a source with no words has target 0. Documents with equal keys at the boundary (repeated rows,
equal or null ids) share the missing words by size, rounded down. A null quality counts as the lowest. An empty table gives an empty
result. Other columns stay as they are; the mix is one struct column, whose name is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import column, keep, whole, words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0

#: Quality weights are held between these bounds, which also bound how uneven the buckets of keys are.
LOWEST, HIGHEST = 0.25, 1.0

#: Beyond so many sources (some 100 bytes each) the table of sources is no longer broadcast by a hint.
BROADCAST_SOURCES = 200_000


def quality_of(text: Column) -> Column:
    """Default quality: one less the symbols per word."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return 1 - F.try_divide(symbols, F.size(words(text)))


def _drawn(docs: DataFrame, source: str, text: str, key: str, quality: Column | None, seed: str) -> DataFrame:
    """``docs`` with source key, size and sampling key in the columns _k, _size and _key, as a struct _d."""
    t, s = whole(column(text)), column(source).cast("string")
    w = quality_of(t) if quality is None else quality
    w = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.coalesce(F.nanvl(w.cast("double"), F.lit(None)), F.lit(LOWEST))))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(column(key).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)
    return docs.withColumn(
        "_d",
        F.struct(
            F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s)).alias("k"),
            F.size(words(t)).cast("bigint").alias("size"),
            (-F.ln(u) / w).alias("key"),
        ),
    )


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of sources given by key ``k``, documents ``n`` and words ``source_size``.

    A source is full if its cap is not above what its weight gives it once all sources with a smaller
    cap per weight are full; those before the first that is not full take their cap, the others share the rest.
    There is one row per source, so one task orders them all.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_r", F.row_number().over(Window.orderBy("k")) - 1)
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("_w", given).withColumn("_cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    filled = filled.withColumn("_level", rest / F.sum("_w").over(onward))
    filled = filled.withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w"))
    return filled.select("k", "n", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weights=WEIGHTS,
    cap: float = CAP,
    quality: Column | None = None,
    seed: str = "mix",
    into: str = "_mix",
) -> DataFrame:
    """``docs`` with a struct column ``into``: size, source_size, target and taken of every document.

    ``weights`` go to the sources in the order of their names, again and again. ``quality`` is an expression
    over the documents' columns.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {name: f"_c{i}" for i, name in enumerate(names)}
    if quality is not None:
        numbered = docs.select(*[column(c).alias(at[c]) for c in names], quality.alias("_q"))
        quality = F.col("_q")
    drawn = _drawn(numbered, at[source], at[text], at[key], quality, seed)
    narrow = keep(drawn.select("_d.k", "_d.size", "_d.key"), "mix-keys")
    totals = narrow.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    shares = keep(targets(totals, weights, cap), "mix-targets")
    few = shares.count() <= BROADCAST_SOURCES
    per_source = F.broadcast if few else (lambda df: df)

    # a target in whole words, the epochs that fit into it, and the words that remain
    goal = F.rint("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = shares.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))

    # the bucket of the boundary: keys rise with buckets, and no bucket holds many times the mean
    share = 1 - F.exp(-F.col("key") * LOWEST)
    many = F.ceil(F.sqrt("n"))
    bucket = F.least(F.floor(share * many), many - 1).alias("bucket")
    dealt = narrow.join(per_source(plan.where("rest > 0").select("k", "n", "rest")), "k").select("k", "rest", "size", "key", bucket)
    sums = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = sums.where("before < rest and before + words >= rest").select("k", "bucket", "before")

    # the key of the boundary inside it
    inside = dealt.join(per_source(last), ["k", "bucket"]).groupBy("k", "key", "rest", "before").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("k").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = inside.where("before < rest and before + words >= rest").select(
        "k", F.col("key").alias("edge"), (F.col("rest") - F.col("before")).alias("part"), F.col("words").alias("edge_words")
    )
    plan = keep(plan.join(edge, "k", "left").drop("n", "rest"), "mix-plan")

    joined = drawn.join(per_source(plan), F.col("_d.k") == plan["k"], "left")
    size = F.col("_d.size")
    more = (
        F.when(F.col("_d.key") < F.col("edge"), size)
        .when(F.col("_d.key") == F.col("edge"), F.floor(F.col("part") * size / F.col("edge_words")))
        .otherwise(F.lit(0))
    )
    taken = F.when(size > 0, F.col("epochs") * size + more).otherwise(0).cast("bigint")
    result = F.struct(size.alias("size"), F.col("source_size"), F.col("target"), taken.alias("taken"))
    return joined.select(*[F.col(at[c]) for c in names], result.alias("_m")).toDF(*names, into)
