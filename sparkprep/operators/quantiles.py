"""Exact order statistics and modes without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer, and sketches of all tasks merge in one
reducer. Here a rank is found by radix selection: the bits of a double, put in order, are a 64-bit key. Each round counts
the next DIGIT bits of all values that still share their earlier bits with a wanted rank, of all columns and ranks together. A task
counts its values in arrays and hands on at most one row for each of the 2^DIGIT digits; rows of (column, prefix)
are summed by an ordinary ``groupBy``, and running sums tell which prefixes hold the ranks. When
at most COUNT_LIMIT values are left, the next round counts them whole, so tables of any size need two to four rounds, each of
which reads the wanted columns only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cells import nan_to_null, quoted

DIGIT = 16
COUNT_LIMIT = 1_000_000
BATCH = 50  # columns of one search


@dataclass
class Quantiles:
    """Non-null count, extremes and the requested quantiles (linear interpolation) of one column."""

    count: int
    minimum: float | None = None
    maximum: float | None = None
    values: dict[float, float | None] = field(default_factory=dict)
    between: bool = False  # some value lies strictly between the extremes


@dataclass(frozen=True)
class _Live:
    """Values of one column whose keys begin with ``prefix``; ``below`` others of the column are smaller."""

    column: int
    prefix: int
    below: int
    ranks: tuple[int, ...]


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float] | Mapping[str, Sequence[float]]
) -> dict[str, Quantiles]:
    """Quantiles of numeric expressions; NULL and NaN are left out. Keys are the caller's names."""
    wanted = {
        key: list(probabilities[key] if isinstance(probabilities, Mapping) else probabilities)
        for key in columns
    }
    keys, found = list(columns), {}
    for start in range(0, len(keys), BATCH):
        part = keys[start : start + BATCH]
        numbers = df.select(*[columns[key].cast("double").alias(f"c{i}") for i, key in enumerate(part)])
        found.update(zip(part, _search(numbers, [wanted[key] for key in part])))
    return found


def keys_of(values):
    """64-bit integers in the order of an array of doubles; both zeros are one."""
    import numpy as np

    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def value_of(key: int) -> float:
    """The double of a key."""
    import struct

    return struct.unpack("<d", struct.pack("<q", key ^ ((key >> 63) & 0x7FFF_FFFF_FFFF_FFFF)))[0]


def _count(numbers: DataFrame, live: Sequence[_Live], done: int, digit: int) -> DataFrame:
    """live (its place), prefix and n: how many values of each live set have these first ``done + digit`` bits."""
    shift = 64 - done - digit

    def tally(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        dense = digit <= DIGIT
        totals = [np.zeros(1 << digit, np.int64) if dense else [] for _ in live]
        for batch in batches:
            of = {}
            for k, one in enumerate(live):
                if one.column not in of:
                    column = batch.column(one.column)
                    values = column.drop_null().to_numpy(zero_copy_only=False)
                    of[one.column] = keys_of(values[~np.isnan(values)])
                key = of[one.column]
                if done:
                    key = key[key >> (64 - done) == one.prefix]
                if dense:
                    first = one.prefix << digit if done else -(1 << (digit - 1))
                    totals[k] += np.bincount((key >> shift) - first, minlength=1 << digit)
                elif len(key):
                    totals[k].append(np.unique(key, return_counts=True))
        for k, (one, total) in enumerate(zip(live, totals)):
            if dense:
                at = np.flatnonzero(total)
                prefix, n = at + (one.prefix << digit if done else -(1 << (digit - 1))), total[at]
            elif total:
                prefix, where = np.unique(np.concatenate([t[0] for t in total]), return_inverse=True)
                n = np.bincount(where, np.concatenate([t[1] for t in total])).astype(np.int64)
            else:
                continue
            for start in range(0, len(n), 10_000):
                part = slice(start, start + 10_000)
                columns = [pa.array(np.full(len(n[part]), k, np.int32)), pa.array(prefix[part].astype(np.int64)), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["live", "prefix", "n"])

    counted = numbers.mapInArrow(tally, "live int, prefix long, n long")
    return counted.groupBy("live", "prefix").agg(F.sum("n").alias("n"))


def _located(counts: DataFrame, ranks: Column) -> list:
    """The prefixes in which some rank of their live set lies, with the rows below and the rows of the set."""
    whole = Window.partitionBy("live")
    placed = counts.select(
        "live", "prefix", "n", F.sum("n").over(whole).alias("total"),
        (F.sum("n").over(whole.orderBy("prefix")) - F.col("n")).alias("below"),
    )
    holds = F.exists(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return placed.where(holds).collect()  # at most one row for each rank


def _ranks(total: int, points: Sequence[float]) -> list[int]:
    """Positions of the extremes and of the two neighbours of each quantile."""
    return sorted({0, total - 1, *(f(p * (total - 1)) for p in points for f in (math.floor, math.ceil))})


def _search(numbers: DataFrame, points: Sequence[Sequence[float]]) -> list[Quantiles]:
    live = [_Live(i, 0, 0, ()) for i in range(len(points))]
    last = F.col("total") - 1
    first = [F.array(F.lit(0).cast("long"), last, *[f(F.lit(float(p)) * last) for p in ps for f in (F.floor, F.ceil)]) for ps in points]
    rows = _located(_count(numbers, live, 0, DIGIT), F.get(F.array(*first), F.col("live")) if first else F.array())
    totals = {r["live"]: r["total"] for r in rows}
    sets = [(r["live"], r["prefix"], r["below"], r["n"], _ranks(r["total"], points[r["live"]])) for r in rows]
    done = DIGIT
    while done < 64 and sets:
        live = [_Live(c, p, below, tuple(r - below for r in ranks if below <= r < below + n)) for c, p, below, n, ranks in sets]
        digit = 64 - done if sum(s[3] for s in sets) <= COUNT_LIMIT else DIGIT
        ranks = F.get(F.array(*[F.array(*[F.lit(r).cast("long") for r in one.ranks]) for one in live]), F.col("live"))
        rows = _located(_count(numbers, live, done, digit), ranks)
        sets = [
            (one.column, r["prefix"], one.below + r["below"], r["n"], [x + one.below for x in one.ranks])
            for r in rows for one in [live[r["live"]]]
        ]
        done += digit
    return [_quantiles(totals.get(i, 0), [s for s in sets if s[0] == i], ps) for i, ps in enumerate(points)]


def _quantiles(total: int, found: Sequence[tuple], points: Sequence[float]) -> Quantiles:
    """Values at the wanted ranks, from the sets of equal values that hold them."""
    if not total:
        return Quantiles(0, values={p: None for p in points})

    def at(rank: int) -> float:
        return next(value_of(key) for _, key, below, n, _ in found if below <= rank < below + n)

    values = {}
    for p in points:
        rank = p * (total - 1)
        lower, upper = at(math.floor(rank)), at(math.ceil(rank))
        values[p] = lower if lower == upper else lower + (upper - lower) * (rank - math.floor(rank))
    ends = sum(n for _, _, below, n, _ in found if below == 0 or below + n == total)
    return Quantiles(total, at(0), at(total - 1), values, ends < total)


def exact_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on ties.

    Counts are grouped by value with map-side combining, so neither many different values nor one
    very frequent value ends up in a single task; one job per data type.
    """
    by_type: dict[str, list[str]] = {}
    for name in columns:
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    modes: dict[str, object] = dict.fromkeys(columns)
    df = nan_to_null(df)
    for names in by_type.values():
        cells = [F.struct(F.lit(i).alias("item"), quoted(n).alias("value")) for i, n in enumerate(names)]
        best = (
            df.select(F.inline(F.array(*cells)))
            .where(F.col("value").isNotNull())
            .groupBy("item", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("item")
            .agg(F.min(F.struct(-F.col("n"), F.col("value").alias("value")))["value"].alias("value"))
        )
        for item, value in best.collect():  # one row per column
            modes[names[item]] = value
    return modes
