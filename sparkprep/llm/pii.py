"""Personal data: patterns propose spans, labelers vote, expectation-maximisation weighs them, a classifier decides.

``detect`` finds candidates in whole texts: strict ones (the base, always kept) and loose ones, which are kept
only if the span classifier says so. Four labelers vote for, against or not at all on every candidate: its
shape, a gazetteer, the words before it and the characters next to it. ``fit`` counts the vote patterns of all documents
(at most ``3^4`` for each kind and strictness, whatever the data), estimates the labelers' reliabilities by
expectation-maximisation without any labels, and fits a logistic classifier on the votes, kind and
strictness to the posteriors. ``label`` applies it as one expression. Everything is a projection of the row but
for that one small aggregate: no shuffle of texts, no join, no user function.

Places are code points, ends exclusive. They are sums of the lengths of what stands between the matches, taken in
chunks, so the work on a text is linear in its length and nearly so in its matches.

Defined results: a null or empty text has no spans. Repeated rows have equal spans. Without candidates (an empty
table, clean texts) there is no model and nothing is added. Other columns stay as they are; the result is
one struct column, whose name is a parameter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .text import column, settled, whole

KINDS = ("email", "ip", "card", "phone")

# Top-level domains, card issuers' first digits, words that go with a kind or speak against one.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp ch at be se no pl pt br mx in cn ru".split()
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6)"
NETWORKS = "^(2[0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):"
CUES = {
    "email": "e-?mail|mail|contact|write|courriel|correo|kontakt",
    "ip": r"\bips?\b|address|server|host|login|client|adresse",
    "card": "card|visa|master|credit|debit|carte|tarjeta|karte",
    "phone": r"phone|call|\btel|mobile|\bcell|fax|sms|whatsapp|contact|appel|llam|anruf",
}
AGAINST = r"version|\bv[0-9. ]*$|isbn|issn|doi|order|invoice|serial|\bsku\b|part no|page|section|\bid\b|license|licence"

#: Characters before a span that the context labeler reads.
CONTEXT = 40

#: Code points in a piece of a text that is cut.
CHUNK = 256

#: Loose spans are kept from this probability on.
ACCEPT = 0.9


@dataclass(frozen=True)
class Pattern:
    """A way to write a kind. ``regex`` never backtracks over more than a bounded run of characters."""

    name: str
    kind: str
    regex: str
    strict: bool
    #: Every match holds one of these; texts without any are not searched.
    guard: tuple[str, ...] = ()


_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    # possessive runs and the look-behind give the same leftmost matches as the plain forms, without quadratic work
    Pattern("email", "email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, ("@",)),
    Pattern("ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, (".",)),
    Pattern("card", "card", r"[0-9](?:[\x20-]?[0-9])++", True),
    Pattern("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, ("+",)),
    Pattern(
        "email_spelled", "email",
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[({{]\x20?(?:at|AT)\x20?[\])}}]\x20?[A-Za-z0-9-]{{1,63}}"
        r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9])", False, ("at", "AT"),
    ),
    Pattern("ip_six", "ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", False, (":",)),
    Pattern("card_short", "card", r"(?<![0-9A-Za-z.+-])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5}(?![0-9A-Za-z-])", False),
    Pattern("phone_local", "phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", False),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most a few dozen digits passes the checksum."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def valid(pattern: Pattern, value: Column) -> Column:
    """Whether a strict match is what it looks like; loose matches are judged by the labelers."""
    if not pattern.strict or pattern.kind == "email":
        return F.lit(True)
    if pattern.kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = _digits(value)
    if pattern.kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)


def votes(pattern: Pattern, m: Column) -> list[Column]:
    """Shape, gazetteer, context and neighbourhood: 1 for, -1 against, 0 neither."""
    value, digits = m["value"], _digits(m["value"])
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    if pattern.strict:
        shape = yes
    elif pattern.kind == "card":
        shape = F.when(luhn(digits), yes).otherwise(no)
    elif pattern.kind == "phone":
        shape = F.when(value.rlike(r"^\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\1"), yes).otherwise(none)
    else:
        shape = yes
    if pattern.kind == "email":
        ends = "(?i)[^a-z](" + "|".join(DOMAINS) + ")$"
        known = F.when(value.rlike(ends), yes).otherwise(no)
    elif pattern.kind == "ip":
        if pattern.strict:
            known = F.when(value.rlike(r"^(0|255)\."), no).otherwise(none)
        else:
            known = F.when(F.lower(value).rlike(NETWORKS), yes).otherwise(no)
    elif pattern.kind == "card":
        known = F.when(digits.rlike(ISSUERS), yes).otherwise(no)
    elif pattern.strict:
        known = F.when(value.rlike(r"^\+[1-9]"), yes).otherwise(no)
    else:
        known = F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), yes).otherwise(no)
    before = F.lower(m["before"])
    context = F.when(before.rlike(AGAINST), no).when(before.rlike(CUES[pattern.kind]), yes).otherwise(none)
    joined = m["before"].rlike(r"[\p{L}\p{N}_=/#-]$") | m["after"].rlike(r"^[\p{L}\p{N}_=/#]")
    return [shape, known, context, F.when(joined, no).otherwise(none)]


def running(lengths: Column, chunk: int = 256, plus=lambda a, b: a + b) -> Column:
    """Sums (or what ``plus`` makes, from 0 on) of all earlier items of an array of integers, in chunks."""

    def inside(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, n: F.struct(
            plus(acc["sum"], n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")
        )
        return F.aggregate(items, start, step, lambda acc: acc["out"])

    last = F.floor((F.size(lengths) - 1) / chunk).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(lengths, c * chunk + 1, chunk))
    offsets = inside(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), plus)))
    return F.flatten(F.zip_with(chunks, offsets, lambda c, o: F.transform(inside(c), lambda x: plus(x, o))))


def _guarded(pattern: Pattern, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    if not pattern.guard:
        return found
    held = [F.contains(text, F.lit(g)) for g in pattern.guard]
    return F.when(reduce(or_, held), found).otherwise(F.array().cast("array<string>"))


def _matches(docs: DataFrame, patterns, keep: list[str]) -> DataFrame:
    """For each pattern a column of its name: all matches with start, stop, value, before and after. The text
    is in ``_t``; ``keep`` names the columns to go on with."""
    rows = docs.select(*keep, "_t", *[_guarded(p, F.col("_t")).alias(f"m_{p.name}") for p in patterns])
    some = {p.name: F.size(f"m_{p.name}") > 0 for p in patterns}
    rows = rows.select("*", *[F.when(some[p.name], F.split("_t", p.regex)).alias(f"p_{p.name}") for p in patterns])
    columns = []
    for p in patterns:
        m, pieces = F.col(f"m_{p.name}"), F.col(f"p_{p.name}")
        lengths = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        columns += [
            m, pieces, F.when(some[p.name], F.slice(pieces, 1, F.size(m))).alias(f"a_{p.name}"),
            F.when(some[p.name], F.slice(pieces, 2, F.size(m))).alias(f"z_{p.name}"), lengths.alias(f"l_{p.name}"),
        ]
    rows = rows.select(*keep, "_t", *columns)
    rows = rows.select(
        *keep, "_t", *[f"{x}_{p.name}" for p in patterns for x in "mpaz"],
        *[F.when(some[p.name], running(F.col(f"l_{p.name}"))).alias(f"r_{p.name}") for p in patterns],
    )
    found = []
    for p in patterns:
        zipped = F.arrays_zip(f"m_{p.name}", f"a_{p.name}", f"z_{p.name}", f"r_{p.name}")

        def place(x: Column) -> Column:  # used at once, so it sees this p
            start = x[f"r_{p.name}"] + F.length(x[f"a_{p.name}"])
            return F.struct(
                start.alias("start"), (start + F.length(x[f"m_{p.name}"])).alias("stop"), x[f"m_{p.name}"].alias("value"),
                F.right(x[f"a_{p.name}"], F.lit(CONTEXT)).alias("before"), F.left(x[f"z_{p.name}"], F.lit(1)).alias("after"),
            )

        found.append(F.when(some[p.name], F.transform(zipped, place)).alias(p.name))
    return rows.select(*keep, "_t", *[f"p_{p.name}" for p in patterns], *found)


def _candidate(pattern: Pattern, m: Column) -> Column:
    names = ("shape", "known", "context", "joined")
    return F.struct(
        F.lit(KINDS.index(pattern.kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
        F.lit(pattern.strict).alias("strict"), *[v.alias(n) for n, v in zip(names, votes(pattern, m))],
    )


def detect(docs: DataFrame, text: str = "text", into: str = "_candidates") -> DataFrame:
    """``docs`` with an array column of candidates: kind (its place in ``KINDS``), start, stop, strict and votes,
    strict ones first and each by kind and start. Loose ones that touch a strict one are left out."""
    names = docs.columns
    kept = [f"_c{i}" for i in range(len(names))]
    rows = docs.select(*[column(c).alias(k) for c, k in zip(names, kept)], whole(column(text)).alias("_t"))
    rows = _matches(rows, PATTERNS, kept)

    def listed(p: Pattern) -> Column:
        good = F.filter(p.name, lambda m: valid(p, m["value"])) if p.strict else F.col(p.name)
        none = F.array().cast("array<struct<kind:int,start:int,stop:int,strict:boolean,shape:int,known:int,context:int,joined:int>>")
        return F.coalesce(F.transform(good, lambda m: _candidate(p, m)), none)

    strict = F.concat(*[listed(p) for p in PATTERNS if p.strict])
    loose = F.concat(*[listed(p) for p in PATTERNS if not p.strict])
    rows = rows.select(*kept, strict.alias("_strict"), loose.alias("_loose"))
    touches = lambda a: F.exists("_strict", lambda b: (b["start"] < a["stop"]) & (a["start"] < b["stop"]))
    free = F.filter("_loose", lambda a: ~touches(a))
    return rows.select(*kept, settled(F.concat(F.col("_strict"), F.array_sort(free))).alias("_m")).toDF(*names, into)


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by feature, and what was learnt about the labelers."""

    weights: dict[str, float]
    reliability: dict[str, tuple[float, float]]


LABELERS = ("shape", "known", "context", "joined")


def _features(row) -> list[str]:
    names = [f"{n}:{row[n]}" for n in LABELERS if row[n]]
    return ["all", f"kind:{row['kind']}", f"strict:{row['strict']}", *names]


def fit(detected: DataFrame, candidates: str = "_candidates", rounds: int = 50, steps: int = 400) -> Model:
    """Count vote patterns over all documents, estimate reliabilities, train the classifier on the posteriors.

    At most ``3^4 * 4 * 2`` counts come back to the driver, whatever the number of documents.
    """
    # outer, as a filter on the array's size would compute the array a second time
    each = detected.select(F.explode_outer(column(candidates)).alias("c")).where("c is not null")
    fields = ["kind", "strict", *LABELERS]
    rows = each.groupBy(*[F.col(f"c.{n}").alias(n) for n in fields]).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: [r[f] for f in fields])

    # how often a labeler is right on true and on false spans, when it votes; a prior keeps rare votes sane
    right = {n: (0.8, 0.8) for n in LABELERS}
    prior, posterior = 0.5, []
    for _ in range(rounds):
        posterior = []
        for r in rows:
            true, false = math.log(prior), math.log(1 - prior)
            for n in LABELERS:
                a, b = right[n]
                if r[n]:
                    true += math.log(a if r[n] > 0 else 1 - a)
                    false += math.log(1 - b if r[n] > 0 else b)
            posterior.append(1 / (1 + math.exp(false - true)))
        everything = sum(r["n"] for r in rows)
        prior = (1 + sum(q * r["n"] for q, r in zip(posterior, rows))) / (2 + everything)
        for n in LABELERS:
            a = sum(q * r["n"] for q, r in zip(posterior, rows) if r[n] > 0), sum(q * r["n"] for q, r in zip(posterior, rows) if r[n] < 0)
            b = sum((1 - q) * r["n"] for q, r in zip(posterior, rows) if r[n] < 0), sum((1 - q) * r["n"] for q, r in zip(posterior, rows) if r[n] > 0)
            right[n] = ((8 + a[0]) / (10 + sum(a)), (8 + b[0]) / (10 + sum(b)))

    # logistic regression on the posteriors; frequent patterns count by the root of their number
    weights: dict[str, float] = {}
    for _ in range(steps):
        slope: dict[str, float] = {}
        mass = sum(math.sqrt(r["n"]) for r in rows) or 1.0
        for q, r in zip(posterior, rows):
            names = _features(r)
            p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in names)))
            for f in names:
                slope[f] = slope.get(f, 0.0) + math.sqrt(r["n"]) * (q - p) / mass
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * 0.999 + g
    return Model(weights, right)


def probability(c: Column, model: Model) -> Column:
    """The classifier as an expression over a candidate."""
    score = F.lit(model.weights.get("all", 0.0))
    for name, weight in sorted(model.weights.items()):
        if name != "all":
            field, value = name.split(":")
            hit = c[field] == (value == "True") if field == "strict" else c[field] == int(value)
            score = score + F.when(hit, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def accepted(c: Column, model: Model) -> Column:
    """Strict candidates stay; of the loose ones those that the classifier and at least one cue speak for."""
    if not model.weights:
        return c["strict"]
    cue = (c["context"] >= 0) & (c["joined"] >= 0) & (c["shape"] + c["known"] + c["context"] >= 2)
    return c["strict"] | (cue & (probability(c, model) >= ACCEPT))


def label(detected: DataFrame, model: Model, candidates: str = "_candidates", into: str = "_spans") -> DataFrame:
    """``detected`` with the accepted spans by kind and start: kind, start, stop and strict."""
    kept = F.filter(column(candidates), lambda c: accepted(c, model))
    spans = F.array_sort(F.transform(kept, lambda c: F.struct(c["kind"], c["start"], c["stop"], c["strict"])))
    return detected.withColumn(into, spans)


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _cut(chunks: Column, start: Column, stop: Column) -> Column:
    """The text from ``start`` to ``stop``, from its chunks of ``CHUNK`` code points; only theirs are read."""
    first = F.floor(start / CHUNK).cast("int")
    number = F.ceil(stop / CHUNK).cast("int") - first
    return F.substring(F.array_join(F.slice(chunks, first + 1, F.greatest(number, F.lit(0))), ""), start - first * CHUNK + 1, stop - start)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``label`` in ``text`` replaced by their kind in brackets; null texts stay null.

    Spans that overlap become one, of the kind of the first, or of the longest of those that start there.
    """
    names = docs.columns
    kept = [f"_c{i}" for i in range(len(names))]
    rows = docs.select(*[column(c).alias(k) for c, k in zip(names, kept)])
    changed = F.col(kept[names.index(text)])
    spans = label(detect(rows, kept[names.index(text)]), model).select(*kept, settled(F.col("_spans")).alias("_s"))
    in_order = F.sort_array(F.transform("_s", lambda s: F.struct(s["start"], (-s["stop"]).alias("back"), s["kind"])))
    some = F.when(F.size("_s") > 0, F.struct(
        in_order.alias("spans"), F.regexp_extract_all(changed, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks")))
    rows = spans.select(*kept, settled(some).alias("_m"))
    before = running(F.transform("_m.spans", lambda s: -s["back"]), plus=lambda a, b: F.greatest(a, b))
    placed = F.zip_with("_m.spans", before, lambda s, b: F.struct(s["start"], s["kind"], b.alias("before")))
    heads = F.filter(placed, lambda s: s["start"] >= s["before"])
    tags, chunks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("_m.chunks")
    parts = F.transform(heads, lambda s: F.concat(_cut(chunks, s["before"], s["start"]), F.get(tags, s["kind"])))
    end = -F.array_min(F.transform("_m.spans", lambda s: s["back"]))
    new = F.concat(F.array_join(parts, ""), _cut(chunks, end, F.length(changed)))
    result = [F.when(F.col("_m").isNotNull(), new).otherwise(F.col(k)).alias(k) if c == text else F.col(k) for c, k in zip(names, kept)]
    return rows.select(*result).toDF(*names)
