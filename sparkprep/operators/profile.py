"""Profile tables: overview, statistics per kind of column, distributions, correlations, warnings.

Statistics of many columns come from one aggregate; distributions unpivot the columns into
(column, value) pairs that are counted with map-side combining. Exact quantiles and distinct counts
never gather a column in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.parsing import kind_of
from ..session import compiled_in_parts
from .cells import nan_to_null, quoted
from .dedupe import count_duplicates
from .missing import MissingAnalysis, analyze_missing
from .quantiles import exact_quantiles
from .rowid import ROW_ID

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema if kind_of(f.dataType) in kinds and f.name != ROW_ID]


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column: exact by grouping (column, value) pairs, one job per type.

    ``count_distinct`` over several columns would multiply every row before the shuffle without any
    combining across columns; the pairs here are combined by each task first.
    """
    df = nan_to_null(df)
    if approx:
        row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
        return {c: row[i] for i, c in enumerate(columns)}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    counts = dict.fromkeys(columns, 0)
    for names in by_type.values():
        cells = [F.struct(F.lit(i).alias("item"), quoted(c).alias("value")) for i, c in enumerate(names)]
        pairs = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
        for item, n in pairs.groupBy("item").count().collect():  # one row per column
            counts[names[item]] = n
    return counts


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs with every value as text."""
    df = nan_to_null(df)
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


# ---- overview -----------------------------------------------------------------------------------

SUMMARY_SCHEMA = "column string, dtype string, kind string, missing_count long, missing_percentage double"


def profile_columns(df: DataFrame, analysis: MissingAnalysis | None = None) -> DataFrame:
    """One row per column: type, kind, missing cells."""
    found = analysis or analyze_missing(df)
    rows = [
        (
            c,
            found.types[c].simpleString(),
            kind_of(found.types[c]),
            found.counts[c],
            100 * found.counts[c] / found.rows if found.rows else None,
        )
        for c in found.counts
    ]
    return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)


OVERVIEW_SCHEMA = (
    "total_rows long, total_columns int, total_cells long, numeric_columns int, text_columns int, "
    "missing_cells long, missing_cells_percentage double, duplicate_rows long, duplicate_percentage double"
)


def profile_overview(df: DataFrame) -> DataFrame:
    """One row about the whole table."""
    df = nan_to_null(df)
    found = analyze_missing(df)
    duplicates = count_duplicates(df).first()["duplicate_rows"]
    cells = found.rows * len(found.counts)
    row = (
        found.rows,
        len(found.counts),
        cells,
        len(columns_of(df, "numeric")),
        len(columns_of(df, "text")),
        found.total,
        100 * found.total / cells if cells else None,
        duplicates,
        100 * duplicates / found.rows if found.rows else None,
    )
    return df.sparkSession.createDataFrame([row], OVERVIEW_SCHEMA)


# ---- statistics ---------------------------------------------------------------------------------

NUMERIC_FIELDS = [
    "mean", "std", "variance", "min", "q05", "q25", "median", "q75", "q95", "max", "iqr", "cv",
    "skewness", "kurtosis", "mad", "sum",
]
NUMERIC_SCHEMA = (
    "column string, values long, missing long, distinct long, zeros long, negatives long, "
    + ", ".join(f"{name} double" for name in NUMERIC_FIELDS)
)


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Moments, quantiles and counts per numeric column; ``approx`` estimates the distinct count."""
    df = nan_to_null(df)
    names = list(columns or columns_of(df, "numeric"))
    schema = NUMERIC_SCHEMA
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    values = {c: quoted(c).cast("double") for c in names}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, x in enumerate(values.values()):
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.var_samp(x).alias(f"var{i}"),
            F.sum(x).alias(f"sum{i}"),
            F.skewness(x).alias(f"skew{i}"),
            F.kurtosis(x).alias(f"kurt{i}"),
            F.count_if(x == 0).alias(f"zero{i}"),
            F.count_if(x < 0).alias(f"neg{i}"),
        ]
    row = df.agg(*aggregates).first()
    quantiles = exact_quantiles(df, values, QUANTILES)
    centred = {
        c: F.abs(values[c] - F.lit(quantiles[c].values[0.5])) for c in names if quantiles[c].count
    }
    deviations = exact_quantiles(df, centred, [0.5]) if centred else {}
    distinct = distinct_counts(df, names, approx)
    rows = []
    for i, c in enumerate(names):
        stats, n = quantiles[c], row[f"n{i}"]
        q = [stats.values[p] for p in QUANTILES]
        mean, std = row[f"mean{i}"], row[f"std{i}"]
        rows.append(
            (
                c, n, row["rows"] - n, distinct[c], row[f"zero{i}"], row[f"neg{i}"],
                mean, std, row[f"var{i}"], stats.minimum, *q, stats.maximum,
                q[3] - q[1] if n else None,
                std / mean if mean and std is not None else None,
                _sample_skewness(row[f"skew{i}"], n),
                _sample_kurtosis(row[f"kurt{i}"], n),
                deviations[c].values[0.5] if c in deviations else None,
                row[f"sum{i}"],
            )
        )
    return df.sparkSession.createDataFrame(rows, schema)


def _sample_skewness(g: float | None, n: int) -> float | None:
    """The sample form; the built-in aggregate is the population form."""
    return g * math.sqrt(n * (n - 1)) / (n - 2) if g is not None and n > 2 else None


def _sample_kurtosis(g: float | None, n: int) -> float | None:
    if g is None or n <= 3:
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)


TEXT_SCHEMA = (
    "column string, values long, missing long, distinct long, empty long, "
    "min_length int, mean_length double, max_length int"
)


def profile_text(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    names = list(columns or columns_of(df, "text"))
    if not names:
        return df.sparkSession.createDataFrame([], TEXT_SCHEMA)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        length = F.length(quoted(c))
        aggregates += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.count_if(length == 0).alias(f"empty{i}"),
            F.min(length).alias(f"min{i}"),
            F.avg(length).alias(f"mean{i}"),
            F.max(length).alias(f"max{i}"),
        ]
    row = df.agg(*aggregates).first()
    distinct = distinct_counts(df, names, approx)
    rows = [
        (c, row[f"n{i}"], row["rows"] - row[f"n{i}"], distinct[c],
         row[f"empty{i}"], row[f"min{i}"], row[f"mean{i}"], row[f"max{i}"])
        for i, c in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, TEXT_SCHEMA)


def profile_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Earliest, latest and the range in seconds per datetime column."""
    df = nan_to_null(df)
    names = list(columns or columns_of(df, "datetime"))
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("timestamp_ntz").alias("value")) for c in names
    ]
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column")
        .agg(
            F.count("value").alias("values"),
            F.count_if(F.col("value").isNull()).alias("missing"),
            F.min("value").alias("earliest"),
            F.max("value").alias("latest"),
            (seconds(F.max("value")) - seconds(F.min("value"))).alias("range_seconds"),
        )
    )


# ---- distributions ------------------------------------------------------------------------------


def _extremes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggregates = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        aggregates += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    row = df.agg(*aggregates).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def _bin(col: Column, low: float, high: float, bins: int) -> Column:
    """The equal-width bin of a value, the maximum belonging to the last one."""
    if high == low:
        return F.when(col.isNotNull(), F.lit(0))
    width = (high - low) / bins
    place = F.floor((col.cast("double") - F.lit(low)) / F.lit(width)).cast("int")
    return F.when(col.isNotNull(), F.least(place, F.lit(bins - 1)))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins per numeric column, empty bins included."""
    df = nan_to_null(df)
    names = list(columns or columns_of(df, "numeric"))
    extremes = {c: e for c, e in _extremes(df, names).items() if e[0] is not None}
    schema = "column string, bin int, lower double, upper double"
    edges = []
    for c, (low, high) in extremes.items():
        used = bins if high > low else 1
        width = (high - low) / used
        edges += [(c, b, low + b * width, low + (b + 1) * width) for b in range(used)]
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], schema + ", count long")
    cells = [
        F.struct(F.lit(c).alias("column"), _bin(quoted(c), *extremes[c], bins).alias("bin")) for c in extremes
    ]
    counts = (
        df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull()).groupBy("column", "bin").count()
    )
    return (
        spark.createDataFrame(edges, schema)
        .join(counts, ["column", "bin"], "left")
        .select("column", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column with count and share, smallest value first on ties.

    Ranking is limited to k rows per column inside every task before the final ranking, so no task
    sees all values of a column.
    """
    df = nan_to_null(df)
    names = list(columns or columns_of(df, "text", "numeric", "boolean"))
    found = analyze_missing(df, names)
    counts = unpivot_text(df, names).where(F.col("value").isNotNull()).groupBy("column", "value").count()
    ranked = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumn("percentage", 100 * F.col("count") / F.lit(found.rows))
    )


def interactions(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Two-dimensional binned counts of a pair of numeric columns; bins without rows are left out."""
    df = nan_to_null(df)
    extremes = _extremes(df, [x, y])
    if any(low is None for low, _ in extremes.values()):
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, count long")
    both = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    return both.groupBy(
        _bin(quoted(x), *extremes[x], bins).alias("x_bin"), _bin(quoted(y), *extremes[y], bins).alias("y_bin")
    ).count()


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How often each set of columns is missing together; complete rows have an empty pattern."""
    df = nan_to_null(df)
    names = list(columns or [c for c in df.columns if c != ROW_ID])
    absent = [F.when(quoted(c).isNull(), F.lit(c)) for c in names]
    return df.groupBy(F.array_join(F.array_compact(F.array(*absent)), ",").alias("missing_columns")).agg(
        F.count(F.lit(1)).alias("rows")
    )


# ---- relations and warnings ---------------------------------------------------------------------

PAIRS = 300  # pairs of columns up to which one aggregate holds them all


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over rows where both are known."""
    names = list(columns or columns_of(df, "numeric"))
    return df.sparkSession.createDataFrame(
        [(a, b, value) for (a, b), value in _pearson(df, names).items()],
        "column_a string, column_b string, correlation double",
    )


def _pearson(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float | None]:
    pairs = list(combinations(names, 2))
    if not pairs:
        return {}
    if len(pairs) > PAIRS:
        return _pearson_of_many(df, names)
    row = nan_to_null(df).agg(*[_correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {pair: row[i] for i, pair in enumerate(pairs)}


CONSTANT = 1e-12  # share of a sum of squares that rounding may leave of a spread of zero


def _pearson_of_many(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """All pairs in one pass over the rows, after one that finds where the columns lie.

    A row goes to Python as one array, NaN where a cell is unknown. Each task multiplies its batches into matrices of columns
    by columns (32 bytes for each pair, whatever the number of rows) and gives one row of sums for each pair. Columns are moved
    to their means and scaled to at most 1 first, so the sums of distant or huge values keep their digits.
    """
    cells = [F.coalesce(quoted(name).cast("double"), F.lit(math.nan)) for name in names]
    rows, width = df.select(F.array(*cells).alias("cells")), len(names)

    def matrices(batches):
        for batch in batches:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def places(batches):
        import pyarrow as pa

        low, high, total, n = np.full(width, np.nan), np.full(width, np.nan), np.zeros(width), np.zeros(width)
        for x in matrices(batches):
            low, high = np.fmin(low, np.fmin.reduce(x, axis=0, initial=np.nan)), np.fmax(high, np.fmax.reduce(x, axis=0, initial=np.nan))
            total += np.nansum(x, axis=0)
            n += np.count_nonzero(~np.isnan(x), axis=0)
        known = np.flatnonzero(n)
        found = [known.astype(np.int32), low[known], high[known], total[known], n[known]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["i", "low", "high", "total", "n"])

    def products(batches):
        import pyarrow as pa

        known_known = None  # rows where both are known; then sums of x, of x squared and of x times y over those rows
        for x in matrices(batches):
            known = ~np.isnan(x)
            with np.errstate(invalid="ignore"):
                x = np.where(known, (x - middle) / scale, 0.0)
            known = known.astype(float)
            if known_known is None:
                known_known, sums, squares, crossed = (np.zeros((width, width)) for _ in range(4))
            known_known += known.T @ known
            sums += x.T @ known
            squares += (x * x).T @ known
            crossed += x.T @ x
        if known_known is None:
            return
        for i in range(width - 1):
            j = np.arange(i + 1, width)
            found = [known_known[i, j], sums[i, j], sums[j, i], squares[i, j], squares[j, i], crossed[i, j]]
            numbers = [np.full(len(j), i, np.int32), j.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in numbers + found], names=["i", "j", *parts])

    with compiled_in_parts(df.sparkSession):
        by_task = rows.mapInArrow(places, "i int, low double, high double, total double, n double")
        by_column = by_task.groupBy("i").agg(F.min("low"), F.max("high"), F.sum("total") / F.sum("n"))
        low, high, mean = np.full((3, width), np.nan)
        for i, *place in by_column.collect():  # one row per column
            low[i], high[i], mean[i] = place
        with np.errstate(invalid="ignore"):
            middle = np.where(low == high, low, mean)
            scale = np.maximum(high - middle, middle - low)
        scale[~(scale > 0)] = 1.0

        parts = ["n", "x", "y", "xx", "yy", "xy"]
        schema = "i int, j int, " + ", ".join(f"{part} double" for part in parts)
        added = rows.mapInArrow(products, schema).groupBy("i", "j").agg(*[F.sum(part).alias(part) for part in parts])
        spread = lambda sum_, square: F.col(square) - F.col(sum_) * F.col(sum_) / F.col("n")
        real = lambda sum_, square: spread(sum_, square) > CONSTANT * F.col(square)
        together = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
        value = F.when(real("x", "xx") & real("y", "yy"), F.try_divide(together, F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy"))))
        found = dict.fromkeys(combinations(names, 2))
        for row in added.where("n > 0").select("i", "j", value.alias("value")).collect():  # one row per pair of columns
            found[names[row["i"]], names[row["j"]]] = row["value"]
    return found


def _correlation(a: str, b: str) -> Column:
    """Pearson's coefficient; NULL where one side is constant, on which ``corr`` fails under ANSI rules."""
    x, y = quoted(a).cast("double"), quoted(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


ALERT_SCHEMA = "column string, alert string, value double"


def profile_alerts(
    df: DataFrame,
    *,
    missing_share: float = 50.0,
    cardinality: int = 50,
    zero_share: float = 50.0,
    correlation: float = 0.9,
    approx: bool = False,
) -> DataFrame:
    """Warnings: constant, unique, high_missing, high_cardinality, zeros, high_correlation."""
    names = [c for c in df.columns if c != ROW_ID]
    plain = [c for c in names if kind_of(df.schema[c].dataType) != "other"]
    numeric = columns_of(df, "numeric")
    text = columns_of(df, "text")
    zero_tests = [F.count_if(quoted(c) == 0).alias(f"z{i}") for i, c in enumerate(numeric)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *zero_tests,
    ).first()
    rows = row["rows"]
    distinct = distinct_counts(df, plain, approx)
    alerts = []
    for i, c in enumerate(names):
        present = row[f"n{i}"]
        missing = 100 * (rows - present) / rows if rows else 0.0
        if missing > missing_share:
            alerts.append((c, "high_missing", missing))
        if c not in distinct or not present:
            continue
        if distinct[c] == 1:
            alerts.append((c, "constant", 1.0))
        if distinct[c] == rows and rows > 1:
            alerts.append((c, "unique", float(rows)))
        elif c in text and distinct[c] > cardinality:
            alerts.append((c, "high_cardinality", float(distinct[c])))
        if c in numeric:
            zeros = 100 * row[f"z{numeric.index(c)}"] / rows
            if zeros > zero_share:
                alerts.append((c, "zeros", zeros))
    for (a, b), value in _pearson(df, numeric).items():
        if value is not None and abs(value) > correlation:
            alerts.append((f"{a},{b}", "high_correlation", value))
    return df.sparkSession.createDataFrame(alerts, ALERT_SCHEMA)


COMPARE_SCHEMA = (
    "column string, type_before string, type_after string, rows_before long, rows_after long, "
    "missing_before long, missing_after long"
)


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column: type, rows and missing cells before and after cleaning."""
    old, new = analyze_missing(before), analyze_missing(after)
    names = list(old.counts) + [c for c in new.counts if c not in old.counts]
    rows = [
        (
            c,
            old.types[c].simpleString() if c in old.counts else None,
            new.types[c].simpleString() if c in new.counts else None,
            old.rows,
            new.rows,
            old.counts.get(c),
            new.counts.get(c),
        )
        for c in names
    ]
    return before.sparkSession.createDataFrame(rows, COMPARE_SCHEMA)


def preview(df: DataFrame, n: int = 20, order_by: str | Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first rows, and a one-row table with the number shown and the total."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    head = df.orderBy(*keys).limit(n) if keys else df.limit(n)
    totals = df.agg(
        F.least(F.count(F.lit(1)), F.lit(n)).alias("shown"), F.count(F.lit(1)).alias("total")
    )
    return head, totals
