"""Phrase collocations by top-order marginalisation.

Every word begins exactly one window: itself and the ``longest - 1`` words after it in its piece, padded with null
where the piece ends. The following words are lead columns, made by shifting the word column inside Arrow batches that hold
whole texts, so neither a sort nor a shuffle is needed for them. Only these longest windows are counted, with map-side
combining. A shorter phrase begins as many windows as it occurs, so one ROLLUP over the window's words, its last left out, sums
the counted windows to all shorter phrases, single words and all words of each language: no phrase length is exploded apart.

Words are counted first. Those that occur ``least`` times, at most ENTRIES of them, get numbers by falling frequency, and windows are
counted as numbers. A phrase holds no word rarer than itself, so a window may end before a word without a number; if its
first word has none, it still counts for its language. Should more words than ENTRIES occur ``least`` times, the windows
that hold a word without a number are counted a second time, as text and by the same ROLLUP, and give the phrases with
such words: nothing is left out.

Windows are dealt out by their first words, so that the ROLLUP finds what it sums together. The word of rank k has at most one in
k of all occurrences, so a pair of words that are not both among the first FIRST has at most one in FIRST; the other
pairs are dealt out by the third word too. Each cut of a candidate looks up its two parts: those that at least one word in
HOT begins are at most HOT for each length and are broadcast, the others are joined by (lang, part). The list is
cut in two steps, in SALTS parts for each language and then whole.

Scores are exact: counts are decimals of 14 digits (up to 10^14 - 1 occurrences), products of up to 37, divided
without rounding. Results of long steps are written to the shared folder, so lost executors cost only their tasks.

Defined results: A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and at line feed, vertical tab, form feed and carriage
return, words at space and tab. A null or empty text has no words, a null ``lang`` is ``und``; repeated rows count
each; ties go to the smaller phrase in UTF-8 order; an empty table gives an empty list. Other columns are not
read. Texts are counted whole; memory grows with the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .text import column, keep, whole

#: Most words with numbers, and so most rows that go to the driver and out again.
ENTRIES = 1 << 20

#: Steps of the thresholds among which the least frequency of a word with a number is found.
STEPS = 8

FIRST, PARTS = 1_000, 16

HOT = 10_000

SALTS = 64

#: Words that a task cuts, numbers and combines at a time, and rows of a batch that is handed on.
WORDS, ROWS = 1_000_000, 50_000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _PIECE_ENDS, _UPPER.lower() + b" " + b"\n" * len(_PIECE_ENDS))


def cut(text: str | None) -> list[bytes]:
    """Words of a text in order, with a line feed after each piece."""
    if not text:
        return []
    folded = text.encode().translate(_FOLD).replace(b"\n", b" \n ")
    return [w for w in folded.split(b" ") if w] + [b"\n"]


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), whole(column(text)).alias("text"))


def _cut_batches(batches: Iterator) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Languages, words and numbers of words of about WORDS words of whole texts."""
    langs, words, sizes = [], [], []
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            part = batch.slice(start, 100)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = cut(text)
                langs.append(lang)
                words += own
                sizes.append(len(own))
            if len(words) >= WORDS:
                yield langs, words, sizes
                langs, words, sizes = [], [], []
    if words:
        yield langs, words, sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n, over all languages."""

    def count(batches: Iterator) -> Iterator:
        for _, words, _ in _cut_batches(batches):
            found = Counter(words)
            del found[b"\n"]
            table = pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"]
            )
            for at in range(0, table.num_rows, ROWS):
                yield table.slice(at, ROWS)

    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(counts: DataFrame, least: int, entries: int) -> tuple[list[str], bool]:
    """At most ``entries`` words, the most frequent first, and whether these are all that occur ``least`` times.

    Words of one step of the thresholds are taken together or not at all, so nothing is ranked in one task.
    """
    frequent = counts.where(F.col("n") >= least).withColumn("step", F.floor(F.log2("n") * STEPS))
    steps = sorted(frequent.groupBy("step").count().collect(), reverse=True)  # STEPS for each doubling
    taken, total = None, 0
    for step, n in steps:
        total += n
        if total > entries:
            break
        taken = step
    if taken is None:
        return [], not steps
    found = frequent.where(F.col("step") >= taken).select("word", "n").toArrow().to_pydict()
    ranked = sorted(zip(found["n"], found["word"]), key=lambda x: (-x[0], x[1]))
    return [w for _, w in ranked], taken == steps[-1][0]


def windows(texts: DataFrame, words: list[str], longest: int, spelled: bool = False) -> DataFrame:
    """lang, w1, w2, ... and n of the windows, combined in each task.

    Words are their places in ``words`` and a window ends before any other word; if the first has no place, all are null.
    ``spelled``: only the windows that hold a word without a place, whole and as text.
    """
    names = [f"w{k + 1}" for k in range(longest)]
    known = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def shift(batches: Iterator) -> Iterator:
        entries = known.value
        for langs, tokens, sizes in _cut_batches(batches):
            n = len(tokens)
            told = pa.array(tokens, pa.binary()).cast(pa.string())
            code = pc.index_in(told, value_set=entries).fill_null(-1).to_numpy() if len(entries) else np.full(n, -1)
            inside = np.append(np.fromiter((w != b"\n" for w in tokens), bool, n), np.zeros(longest, bool))
            code = np.append(code, np.full(longest, -1))
            begins = np.flatnonzero(inside)
            lead, on = [], np.ones(len(begins), bool)
            unknown = np.zeros(len(begins), bool)
            for k in range(longest):
                on = on & inside[begins + k]
                if not spelled:
                    on = on & (code[begins + k] >= 0)
                unknown |= on & (code[begins + k] < 0)
                lead.append(on)
            of = np.repeat(np.arange(len(sizes)), sizes)[begins]
            names_of, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
            lang_of = lang_of[of]
            if spelled:
                at = np.flatnonzero(unknown)
                columns = [told.take(pa.array(np.minimum(begins[at] + k, n - 1), mask=~lead[k][at])) for k in range(longest)]
                count = np.ones(len(at), np.int64)
                lang_of = lang_of[at]
            else:
                # rows in order, then a row wherever one differs from the one before
                rows = [lang_of] + [np.where(on, code[begins + k], -1).astype(np.int32) for k, on in enumerate(lead)]
                order = np.lexsort(rows[::-1])
                rows = [r[order] for r in rows]
                new = np.ones(len(order), bool)
                new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(order)))
                columns = [pa.array(r[first], mask=r[first] < 0) for r in rows[1:]]
                lang_of = rows[0][first]
            langs_told = pa.array(names_of.tolist(), pa.string()).take(pa.array(lang_of))
            made = pa.RecordBatch.from_arrays([langs_told, *columns, pa.array(count, pa.int64())], names=["lang", *names, "n"])
            for at in range(0, made.num_rows, ROWS):
                yield made.slice(at, ROWS)

    kind = "string" if spelled else "int"
    return texts.mapInArrow(shift, "lang string, " + ", ".join(f"{w} {kind}" for w in names) + ", n bigint")


def marginals(windows: DataFrame, longest: int, least: int, spelled: bool = False) -> DataFrame:
    """lang, w1, w2, ..., n_words (0: all words of the language) and n of all phrases that occur ``least`` times."""
    names = [f"w{k + 1}" for k in range(longest)]
    if spelled:
        top = windows.groupBy(*names[::-1], "lang").agg(F.sum("n").alias("n"))
    else:
        often = F.lit(longest > 2) & (F.col("w1") < FIRST) & (F.col("w2") < FIRST)
        dealt = windows.withColumn("part", F.when(often, F.pmod(F.col(names[-1]), F.lit(PARTS))))
        prefix = ["lang", *names[:2], "part"]
        top = dealt.repartition(*prefix).groupBy(*prefix, *names[2:]).agg(F.sum("n").alias("n")).drop("part")
    top = keep(top.sortWithinPartitions("lang", *names), "phrase-windows", compression="zstd")
    shorter = top.rollup("lang", *names[:-1]).agg(F.sum("n").alias("n"), F.grouping_id().alias("without"))
    n_words = F.coalesce(*[F.when(F.col("without") == 2 ** (longest - 1 - k) - 1, k) for k in range(longest)])
    # a null word is padding in a window; in a sum it may also stand for what was summed over
    padded = [(F.col("n_words") > k) & F.col(name).isNull() for k, name in enumerate(names[:-1])]
    shorter = shorter.withColumn("n_words", n_words).where("n_words is not null").drop("without")
    for one in padded:
        shorter = shorter.where(~one)
    full = top.where(F.col(names[-1]).isNotNull()).withColumn("n_words", F.lit(longest))
    return full.unionByName(shorter, allowMissingColumns=True).where(F.col("n") >= least)


def phrase_counts(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, n_words (0: all words of the language) and n of all phrases that occur ``least`` times."""
    words, complete = numbered(keep(word_counts(texts), "word-counts"), least, ENTRIES)
    names = [f"w{k + 1}" for k in range(longest)]
    known = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))
    kinds = "lang string, " + ", ".join(f"{w} string" for w in names) + ", n_words int, n bigint"

    def spell(batches: Iterator) -> Iterator:
        entries = known.value
        for b in batches:
            told = [entries.take(w) for w in b.columns[1 : 1 + longest]]
            yield pa.RecordBatch.from_arrays([b.column(0), *told, *b.columns[1 + longest :]], names=b.schema.names)

    def unnumbered(batches: Iterator) -> Iterator:
        """Phrases that hold a word without a number; the others are counted whole elsewhere."""
        entries = known.value
        for b in batches:
            told = b.columns[1 : 1 + longest]
            new = [w.is_valid().to_numpy(False) & ~pc.is_in(w, value_set=entries).to_numpy(False) for w in told]
            yield b.filter(pa.array(np.any(new, axis=0)))

    columns = ["lang", *names, "n_words", "n"]
    counts = marginals(windows(texts, words, longest), longest, least).select(*columns).mapInArrow(spell, kinds)
    if not complete:
        rest = marginals(windows(texts, words, longest, spelled=True), longest, least, spelled=True)
        counts = counts.unionByName(rest.select(*columns).mapInArrow(unnumbered, kinds))
    return counts.select("lang", F.concat_ws(" ", *names).alias("phrase"), "n_words", "n")


def _look_up(cuts: DataFrame, counts: DataFrame, part: str, into: str, words: int) -> DataFrame:
    """``cuts`` with the count of the phrase in the column ``part``."""
    table = counts.select(F.col("lang"), F.col("phrase").alias(part), F.col("n").alias(into))
    often = F.broadcast(table.where(F.col(into) * HOT >= words))  # at most HOT phrases of each length
    seldom = table.where(F.col(into) * HOT < words)
    rest = cuts.join(often.select("lang", part), ["lang", part], "left_anti")
    return cuts.join(often, ["lang", part]).unionByName(rest.join(seldom, ["lang", part]))


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _slice(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact."""
    a, l, r = (x.cast("decimal(14,0)") for x in (a, l, r))  # noqa: E741
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    ``l`` and ``r`` are the counts of the parts at the lowest-scoring cut. A phrase is left out if a longer candidate
    that holds it has at least ``share`` percent of its occurrences.
    """
    counts = keep(phrase_counts(_texts(docs, text, lang), longest, least), "phrase-counts")
    totals = counts.where("n_words = 0").select("lang", "n")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates = counts.where("n_words >= 2").withColumnRenamed("n", "a")

    held = candidates.where("n_words >= 3").select(
        "lang", "a", "n_words", _words(F.col("phrase")).alias("w"), F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size")
    )
    held = held.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("start"))
    held = held.select("lang", _slice(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "a")
    longer = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )

    w, k = _words(F.col("phrase")), F.col("k")
    cuts = left.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _slice(w, F.lit(1), k).alias("first"), _slice(w, k + 1, F.col("n_words") - k).alias("second")
    )
    cuts = _look_up(_look_up(cuts, counts, "first", "l", words), counts, "second", "r", words)
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("m"))
    scored = worst.select("lang", "phrase", "a", "m.l", "m.r", "m.score")

    order = "ORDER BY score DESC, a DESC, phrase"
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY lang, _salt {order})")).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= HOT else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
