"""Quality rules: a threshold table compiled into one projection of ratios.

``measure`` adds the metrics of a text as columns, ``compile_rules`` turns a table of thresholds into one
expression that names the rules a row breaks, ``apply_rules`` does both. No row leaves its partition: no
shuffle, no join, no user function, whatever the size of the table. Within a row all work is linear in the
text but for one sort of its windows.

Defined results: a null or empty text has no words, so every count is 0 and every ratio null; a ratio that is
null breaks no rule (the rule on the number of words rejects such rows). Repeated rows are judged alike, each
by itself; there is nothing to tie. An empty table gives an empty result. Other columns, whatever their names,
stay as they are; measures are returned in one struct column, whose name is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from .text import column, settled, whole, words

# Frequent words of four languages.
STOP_WORDS = (
    "a an and are as at be by for from have in is it of on or that the this to was were with "
    "das dem den der des die ein eine er im ist mit nicht sich und von zu auf als für "
    "au avec dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rows whose ``metric`` is below ``low`` or above ``high`` break the rule; ``base`` marks the fixed part.

    It holds for rows of at least ``lines`` lines and, if ``languages`` are named, of one of these.
    """

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    base: bool = False
    lines: int = 0
    languages: tuple[str, ...] = ()


#: The threshold table. Metrics: see ``RATIOS`` and the counts of ``measure``.
RULES = (
    Rule("too_few_words", "n_words", low=50, base=True),
    Rule("repeated_windows", "repeat_share_pct", high=50, base=True),
    Rule("word_length", "mean_word_chars", low=2.5, high=10),
    Rule("symbols", "symbols_per_word", high=0.15),
    Rule("stop_words", "stop_share", low=0.05),
    Rule("repeated_lines", "dup_line_share", high=0.4),
    Rule("open_lines", "ended_line_share", low=0.1),
)

#: The table for a corpus: lines say something only if there are several, stop words only where the lists cover the language.
CORPUS_RULES = tuple(
    replace(r, lines=10) if r.name == "open_lines" else replace(r, languages=("de", "en", "es", "fr")) if r.name == "stop_words" else r
    for r in RULES
)

#: Ratios over the counts. A division by zero gives null.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_share": ("n_stop", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "ended_line_share": ("n_ended_lines", "n_lines"),
}


def _repeated(sorted_windows: Column) -> Column:
    """Places of the windows that occur twice or more, from (hash, place) pairs in order."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(
        sorted_windows,
        lambda x, i: same(x, F.get(sorted_windows, i - 1)) | same(x, F.get(sorted_windows, i + 1)),
    )
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def _covered(places: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that start at the sorted places."""
    step = lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def measure(docs: DataFrame, text: str = "text", into: str = "_measures") -> DataFrame:
    """``docs`` with a struct column ``into`` of counts and ratios of every whole text."""
    names = docs.columns
    kept = [column(c).alias(f"_c{i}") for i, c in enumerate(names)]
    back = [F.col(f"_c{i}") for i in range(len(names))]
    one = docs.select(*kept, whole(column(text)).alias("_t")).withColumn("_w", words(F.col("_t")))
    w = F.col("_w")
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    known = sorted({v for s in STOP_WORDS for v in (s, s.capitalize())})
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select(
        *back,
        F.size(w).alias("n_words"),
        F.length(F.array_join(w, "")).alias("word_chars"),
        F.regexp_count(F.col("_t"), F.lit(SYMBOLS)).alias("n_symbols"),
        F.size(F.filter(w, lambda x: x.isin(known))).alias("n_stop"),
        lines.alias("_lines"),
        F.sort_array(windows).alias("_s"),
    )
    three = two.select(
        *back, "n_words", "word_chars", "n_symbols", "n_stop",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"”»…。！？][\x20\x09-\x0D]*$"))).alias("n_ended_lines"),
        _repeated(F.col("_s")).alias("_places"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_stop", "n_lines", "n_dup_lines", "n_ended_lines"]
    values = [F.col(c).cast("bigint").alias(c) for c in counts]
    repeats = _covered(F.col("_places"), 3).cast("bigint")
    four = three.select(*back, *values, repeats.alias("n_repeat_words"))
    ratios = [F.try_divide(F.col(a), F.col(b)).alias(name) for name, (a, b) in RATIOS.items()]
    share = F.try_divide(100 * F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share_pct")
    return four.select(*back, settled(F.struct(*counts, "n_repeat_words", share, *ratios)).alias("_m")).toDF(*names, into)


def compile_rules(rules, into: str = "_measures", language: str = "lang") -> Column:
    """The names of the rules that a row breaks, as one expression over the measures.

    Column ``language`` is read only by rules that name languages; its part before ``-`` or ``_`` counts, and where it
    is null they do not hold.
    """
    broken = []
    for rule in rules:
        value, hits = column(into)[rule.metric], []
        if rule.low is not None:
            hits.append(value < rule.low)
        if rule.high is not None:
            hits.append(value > rule.high)
        if rule.lines:
            hits = [hit & (column(into)["n_lines"] >= rule.lines) for hit in hits]
        if rule.languages:
            spoken = F.lower(F.regexp_extract(column(language), "^[A-Za-z]*", 0)).isin(*rule.languages)
            hits = [hit & spoken for hit in hits]
        for hit in hits:
            broken.append(F.when(hit, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(
    docs: DataFrame, rules=RULES, text: str = "text", measures: str = "_measures", broken: str = "_broken",
    language: str = "lang",
) -> DataFrame:
    """``docs`` with the measures and the list of broken rules; a row is good if the list is empty."""
    return measure(docs, text, measures).withColumn(broken, compile_rules(rules, measures, language))
