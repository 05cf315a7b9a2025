"""The registered queries of the operators, and their SQL where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat, collocations, decontamination, digest_index, gam, licenses, mixing, near_duplicates, pii, quality_rules, token_alignment,
    token_counts, url_filters,
)
from sparkprep.session import shared_folder

from .text import keep, read, sha256, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    """Register a query under its name."""
    QUERIES[function.__name__] = function
    return function


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    judged = quality_rules.apply_rules(docs)
    base = F.array(*[F.lit(r.name) for r in quality_rules.RULES if r.base])
    m = F.col("_measures")
    return judged.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.arrays_overlap("_broken", base).alias("base_failed"),
        (F.size("_broken") == 0).alias("kept"),
        F.array_join("_broken", ",").alias("broken_rules"),
    )


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(whole(F.col("text"))).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


# Each in plain SQL: every window of every text as a row, and sources filled one after the other by running sums.
ORACLES["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT rid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
  FROM (SELECT rid, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
c AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat
  FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM r WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '[.!?:;"\x{201D}\x{00BB}\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x20\x09-\x0D]*$')) AS n_ended
  FROM l GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains([STOPS], x))) AS n_stop, n_lines, n_ended
  FROM d LEFT JOIN c USING (rid) LEFT JOIN lc USING (rid)),
b AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'too_few_words' END,
    CASE WHEN n_words > 0 AND 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows' END,
    CASE WHEN n_words > 0 AND (word_chars / n_words < 2.5 OR word_chars / n_words > 10) THEN 'word_length' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.15 THEN 'symbols' END,
    CASE WHEN n_words > 0 AND n_stop / n_words < 0.05 THEN 'stop_words' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.4 THEN 'repeated_lines' END,
    CASE WHEN n_lines > 0 AND n_ended / n_lines < 0.1 THEN 'open_lines' END], lambda x: x IS NOT NULL) AS broken
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  list_contains(broken, 'too_few_words') OR list_contains(broken, 'repeated_windows') AS base_failed,
  len(broken) = 0 AS kept, coalesce(array_to_string(broken, ','), '') AS broken_rules FROM b
""".replace("STOPS", ", ".join(f"'{v}'" for w in quality_rules.STOP_WORDS for v in (w, w.capitalize())))

ORACLES["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1)
      / CAST(4503599627370497 AS DOUBLE) AS u
  FROM documents),
k AS (
  SELECT *, CASE WHEN size > 0 THEN -ln(u) / greatest(0.25, least(1, 1 - symbols / size)) ELSE -ln(u) / 0.25 END AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size,
    CASE WHEN level * w >= cap THEN cap ELSE max(CASE WHEN level * w < cap THEN level END) OVER () * w END AS target FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // source_size ELSE 0 END AS epochs,
    CAST(round_even(target, 0) AS BIGINT) AS goal FROM t),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.goal - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


ORACLES["op8_decontamination"] = r"""
WITH i AS (
  SELECT item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT n FROM v) WHERE s + n - 1 <= len(w)),
h AS (SELECT rid, s, p.n, item_id FROM p JOIN v USING (win)),
c AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS word FROM h) GROUP BY rid),
t AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    # as ``item_words`` counts them, without lower-casing the text
    n_words = F.size(F.array_remove(F.split(whole(F.col("text")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    docs = read(spark, folder, "documents").select("doc_id", "text", n_words.cast("bigint").alias("n_words"))
    marked = decontamination.mark(docs, read(spark, folder, "benchmark"), columns=["doc_id", "n_words"])
    hits = F.coalesce("_hits.n_hit", F.lit(0))
    return marked.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.coalesce("_hits.n_items", F.lit(0)).alias("n_items"),
        sha256(F.coalesce("_hits.items_text", F.lit(""))).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@query
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("near_group").alias("class_id"), F.col("copy_class").alias("copy_class_id"),
        "n_links", "n_linked_texts", "n_copies",
    )


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    detected = keep(pii.detect(docs).select("doc_id", "_candidates"), "pii-candidates")
    spans = pii.label(detected, pii.fit(detected))
    base = F.filter("_spans", lambda s: s["strict"])
    counts = [
        F.size(F.filter("_spans", lambda s: s["strict"] & (s["kind"] == k))).cast("bigint").alias(f"n_{name}")
        for k, name in enumerate(pii.KINDS)
    ]
    return spans.select(
        "doc_id", *counts, sha256(pii.spans_text(base)).alias("base_sha256"), pii.spans_text(F.col("_spans")).alias("spans")
    )


ORACLES["op2_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM o GROUP BY conv_id
"""


@query
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), marks.alias("text"))
    return chat.digests(chat.expand(turns.unionByName(more)))


#: Rules of the query on pages.
RULES = (
    url_filters.Rule("org/", True),
    url_filters.Rule("example.org/es/", False),
    url_filters.Rule("example.org/en/1", False),
    url_filters.Rule("com/fr/", True),
    url_filters.Rule("com/de/", False),
)


@query
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(read(spark, folder, "pages").select("page_id", "url", "html"), RULES)


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scanned = licenses.scan(docs, columns=["doc_id"])
    found = F.col("_licenses.found")
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"])))
    one = lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["stop"].cast("string"))
    return scanned.select(
        "doc_id",
        F.coalesce(F.size(names), F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_join(F.transform(found, one), ","), F.lit("")).alias("spans"),
    )


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = gam.classify(docs, read(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    index = digest_index.open_index(spark, f"{shared_folder(spark)}/llm-digest-index-{uuid.uuid4().hex}")
    # two deliveries, so that the second is held against what the first has left in the index
    delivery = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in range(2):
        digest_index.add(index, docs.where(delivery == k), f"{k}", columns=["doc_id"])
    return digest_index.verdicts(index).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLES["op11_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents").select("lang", "text"))


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
h AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
v AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT v.lang, v.phrase, a, cut, gx.f AS l, gy.f AS r,
    (1000000::HUGEINT * a * a) // (gx.f::HUGEINT * gy.f) AS score
  FROM v JOIN g gx ON gx.lang = v.lang AND gx.phrase = x JOIN g gy ON gy.lang = v.lang AND gy.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
k AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h USING (lang, phrase) WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
SELECT k.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = token_alignment.aligned(docs, *paths, columns=["doc_id"], into="_x")
    groups = F.col("_x.groups")
    digest = F.when(groups == "", "").otherwise(sha256(groups))
    found = found.withColumn("_x", F.col("_x").dropFields("groups").withField("groups_sha256", digest))
    return token_alignment.scored(found, "_x").select("doc_id", "_x.*", "_links.*")
