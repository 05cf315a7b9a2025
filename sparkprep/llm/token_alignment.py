"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Both tokenizers' tokens become arrays of byte ends over the same bytes. Where token i of A and token j of B end together, so
mostly do the next ones at the same shift j - i: ``align`` compares slices of the two arrays at that shift, twice
as long each time while they are equal, then halves, and so jumps over a stretch of one-to-one tokens in a few
comparisons. Where the ends differ, the smaller one is advanced until both meet; that closes an irregular group, whose overlapping
pairs are noted on the way, and sets the shift for the next stretch.

``aligned`` encodes and aligns texts in Arrow batches without a shuffle. ``scored`` counts, for each pair of ids, the documents
that link it (equal pairs of a task are combined before the shuffle) and brings the counts back: a pair with at least 1/HOT
of all links is one of at most HOT pairs, which are broadcast and looked up in sorted arrays; the links of the others
are joined by pair. The highest count of each A id is at most one number for each entry of A's vocabulary. Results of long
steps are written to the shared folder; a lost executor costs its tasks only.

A is the byte-level tokenizer of a ``tokenizers`` file and B a ``sentencepiece`` model, each by its file. A's merges are run by
``tiktoken`` over the vocabulary of that file, whose ids rank its merges; code points for which a comparison with the
library does not show the same tokens, and all from U+2100 on, leave the text to the library itself.

Defined results: null and empty texts, and those whose tokens' bytes do not join to a space and the text (B
normalises some), have no tokens: zeros and an empty groups text. Special strings inside texts are plain text. Repeated rows
are documents of their own. Very long texts are aligned whole; memory grows with the longest text. An empty table gives an
empty result. Other columns, whatever their names, come back unchanged; all columns that are added are in one struct.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from .text import column, keep, whole
from .token_counts import pattern

#: At most this many pairs are broadcast: those that at least one link in HOT has.
HOT = 200_000

#: Texts that a task encodes and hands on at a time.
TEXTS = 200

#: Code points that are compared with the library one by one; texts with others are encoded by the library.
COMPARED = 0x2100

ADDED = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups", T.StringType(), False)]
    + [T.StructField(n, T.ArrayType(T.LongType(), False), False) for n in ("pairs", "links")]
)

#: A pair of ids as one number: A's id times this, plus B's id.
WIDTH = 1 << 31


#: Length of the first slice that is compared; the next ones are twice as long each.
PROBE = 4

#: Tokens i to to_i of A and j to to_j of B; one-to-one groups, or else one group.
Stretch = tuple[int, int, int, int, bool]


def align(a: list[int], b: list[int]) -> tuple[list[Stretch], list[int], list[int]]:
    """Stretches of two arrays of increasing ends with the same last end, and the places in both of
    the linked tokens of the irregular groups."""
    stretches, at_a, at_b = [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            start_i, start_j, step = i, j, PROBE
            i, j = i + 1, j + 1
            while a[i : i + step] == b[j : j + step] and i < n:
                i, j, step = i + step, j + step, 2 * step
            if i >= n:
                stretches.append((start_i, n, start_j, len(b), True))
                break
            while step > 1:  # the slice that differs may begin alike
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            stretches.append((start_i, i, start_j, j, True))
        start_i, start_j = i, j
        x, y = a[i], b[j]
        while x != y:  # advance the smaller end until they meet
            at_a.append(i)
            at_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        at_a.append(i)
        at_b.append(j)
        i, j = i + 1, j + 1
        stretches.append((start_i, i, start_j, j, False))
    return stretches, at_a, at_b


def groups_text(stretches: list[Stretch], a: list[str], b: list[str]) -> tuple[str, int]:
    """``a1,a2|b1;a3|b2,b3`` of the groups, and how many there are. The ids in ``a`` have a bar behind them, those in
    ``b`` a semicolon."""
    parts, n = [], 0
    for i, to_i, j, to_j, alike in stretches:
        if alike:
            m = to_i - i
            both = [""] * (2 * m)
            both[::2], both[1::2] = a[i:to_i], b[j:to_j]
            parts += both
            n += m
        else:
            parts.append("".join(a[i:to_i]).replace("|", ",", to_i - i - 1))
            parts.append("".join(b[j:to_j]).replace(";", ",", to_j - j - 1))
            n += 1
    return "".join(parts)[:-1], n


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the other
    bytes in order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(others)}


def _vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes], bool]:
    """Bytes of A's entries as ranks and by id, and whether ids rank the merges."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    of, entries = byte_of(), described["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
    by_id = [b""] * (1 + max([*entries.values(), *special]))
    for entry, i in entries.items():
        by_id[i] = special[i] if i in special else bytes(of[c] for c in entry)
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in described["model"]["merges"]]
    ids = [entries[m] for m in made]
    ranked = ids == sorted(ids) and not described["normalizer"]
    return {x: i for i, x in enumerate(by_id) if i not in special and x}, by_id, ranked


@lru_cache(maxsize=2)
def library(path: str):
    """A's tokenizer as the library runs it; special strings in texts are plain text."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def ranked_merges(path: str):
    """A's vocabulary in the faster encoder, and the bytes of its entries."""
    import tiktoken

    ranks, by_id, ranked = _vocabulary(path)
    return tiktoken.Encoding("a", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={}) if ranked else None, by_id


@lru_cache(maxsize=2)
def pieces(path: str):
    """B's model and the bytes of its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    by_id = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
    return model, by_id


def doubtful(path: str) -> str:
    """A class of the code points whose texts go to the library."""
    fast, _ = ranked_merges(path)
    if fast is None:
        return r"[\s\S]"
    slow, points = library(path), []
    for point in range(COMPARED):
        probe = f"a{chr(point)} {chr(point)}1{chr(point)}{chr(point)}- {chr(point)} \n{chr(point)}"
        if slow.encode(probe, add_special_tokens=False).ids != fast.encode_ordinary(probe):
            points.append(point)
    return "[" + "".join(re.escape(chr(p)) for p in points) + f"{chr(COMPARED)}-\U0010ffff]"


def _lengths(by_id: list[bytes]) -> list[int]:
    return [len(x) for x in by_id]


def aligned(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", columns: list[str] | None = None, into: str = "_alignment"
) -> DataFrame:
    """``columns`` (default: all) and a struct: n_a, n_b, n_groups, n_links, groups (the ids of each group) and the
    text's different linked pairs of ids with the number of links of each."""
    columns = list(docs.columns) if columns is None else columns
    doubt_class = doubtful(a_path)
    rows = docs.select(*[column(c).alias(f"c{k}") for k, c in enumerate(columns)], whole(column(text)).alias("text"))
    kept = [f"c{k}" for k in range(len(columns))]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fast, a_bytes = ranked_merges(a_path)
        model, b_bytes = pieces(b_path)
        doubt = re.compile(doubt_class)
        a_size, b_size = np.array(_lengths(a_bytes)), np.array(_lengths(b_bytes))
        a_name, b_name = [f"{i}|" for i in range(len(a_bytes))], [f"{i};" for i in range(len(b_bytes))]

        def encode(value: str) -> list[int]:
            if doubt.search(value):
                return library(a_path).encode(value, add_special_tokens=False).ids
            return fast.encode_ordinary(value)

        def one(value: str, b: list[int]) -> tuple:
            want = (" " + value).encode()
            if value and b"".join([b_bytes[x] for x in b]) == want:
                a = encode(" " + value)
                of_a, of_b = np.array(a), np.array(b)
                ends = a_size[of_a].cumsum()
                # a byte-level encoder changes no byte if it loses none
                if ends[-1] == len(want):
                    stretches, at_a, at_b = align(ends.tolist(), b_size[of_b].cumsum().tolist())
                    told, n = groups_text(stretches, [a_name[x] for x in a], [b_name[x] for x in b])
                    # tokens outside irregular groups are linked in order
                    firsts, seconds = (np.concatenate([x[at], np.delete(x, at)]) for x, at in ((of_a, at_a), (of_b, at_b)))
                    pairs, links = np.unique(firsts * WIDTH + seconds, return_counts=True)
                    return len(a), len(b), n, len(firsts), told, pairs, links
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)

        def lists(items: list) -> pa.Array:
            ends = np.cumsum([0] + [len(x) for x in items]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items).astype(np.int64)))

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = part.column(len(kept)).to_pylist()
                found = list(zip(*map(one, texts, model.encode(texts, num_threads=1))))
                arrays = [pa.array(x, pa.int64()) for x in found[:4]] + [pa.array(found[4]), lists(found[5]), lists(found[6])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], names=[*kept, *ADDED.names])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], *ADDED.fields]))
    return out.select(*kept, F.struct(*ADDED.names).alias(into)).toDF(*columns, into)


def scored(df: DataFrame, alignment: str = "_alignment", into: str = "_links") -> DataFrame:
    """``df`` without the pairs of its alignments, with a struct: n_best, the links whose pair more documents link than (or
    as many as) any other pair with its A id, and count_sum, the sum over the links of the documents that link the pair."""
    columns = [c for c in df.columns if c != alignment]
    told = [f for f in df.schema[alignment].dataType.names if f not in ("pairs", "links")]
    base = keep(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            *[column(c).alias(f"c{k}") for k, c in enumerate(columns)],
            F.struct(*[column(alignment)[f].alias(f) for f in told]).alias("told"),
            column(alignment)["pairs"].alias("pairs"),
            column(alignment)["links"].alias("links"),
        ),
        "token-links",
        compression="zstd",
    )
    each = base.select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("x.pairs", "x.links")
    counts = keep(each.groupBy(F.col("pairs").alias("pair")).agg(F.count(F.lit(1)).alias("docs"), F.sum("links").alias("links")), "pair-counts")
    a_id = F.expr(f"pair div {WIDTH}")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("highest"))  # a row for each entry of A's vocabulary
    marked = counts.withColumn("a", a_id).join(F.broadcast(highest), "a")
    marked = marked.select("pair", "docs", "links", (F.col("docs") == F.col("highest")).alias("best"))
    n_links = counts.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    often = marked.where(F.col("links") * HOT >= n_links).select("pair", "docs", "best").toArrow().sort_by("pair")
    known = base.sparkSession.sparkContext.broadcast([often.column(k).to_numpy() for k in range(3)])
    kept = ["row", *[f"c{k}" for k in range(len(columns))], "told"]

    def look_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pair, docs, best = known.value
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy().astype(np.int64)
            keys = lists.values.to_numpy()[ends[0] : ends[-1]]
            links = batch.column(len(kept) + 1)
            links = links.values.to_numpy()[links.offsets[0].as_py() : links.offsets[-1].as_py()]
            ends = ends - ends[0]
            place = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            there = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
            place = np.where(there, place, 0)

            def sums(values: np.ndarray) -> pa.Array:
                upto = np.append(0, np.cumsum(values))
                return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

            n_best = np.where(there & best[place], links, 0) if len(pair) else np.zeros(len(keys), np.int64)
            count_sum = np.where(there, links * docs[place], 0) if len(pair) else np.zeros(len(keys), np.int64)
            left = pa.array(np.append(0, np.cumsum(~there))[ends].astype(np.int32))
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~there])) for x in (keys, links)]
            arrays = [*batch.columns[: len(kept)], sums(n_best), sums(count_sum), *rest]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_best", "count_sum", "pairs", "links"])

    fields = [base.schema[c] for c in kept]
    fields += [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")] + [base.schema[c] for c in ("pairs", "links")]
    first = keep(base.mapInArrow(look_up, T.StructType(fields)), "known-links", compression="zstd")
    rest = first.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.links")
    seldom = marked.where(F.col("links") * HOT < n_links).select("pair", "docs", "best")
    more = rest.join(seldom, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum")
    )
    joined = first.join(more, "row", "left")
    added = F.struct(
        *[(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    )
    return joined.select(*kept[1:], added.alias("added")).toDF(*columns, alignment, into)
