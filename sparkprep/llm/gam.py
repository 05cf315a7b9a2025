"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of the whole text, computed as one Spark projection. Each is cut into bins at quantiles of the
training sample, with a bin of its own for missing values. Cyclic boosting goes round the features: a tree of at
most three splits over one feature's bins is fitted to the gradient of the logistic loss and added, damped,
to that feature's table. Then the pairs whose coarse two-way tables explain most of what is left get
tables of their own in the same way. A score is the logistic of the sum of table entries.

Training takes at most ``SAMPLE`` labelled documents, those with the smallest hash of their id, whatever the size of
the corpus; everything else covers all rows. Scoring is row by row in Arrow batches of a dozen numbers, without a
shuffle; texts are read once.

Defined results: a null or empty text has missing ratios and is scored by the missing bins. A null label, a label
without document or a document without label is not used; repeated labels count again. With no labels, or
one class only, the score is the smoothed share of label 1. An empty table gives an empty result. Of other columns
only those asked for are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .quality_rules import measure
from .text import column, keep, whole, words

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 50_000

BINS = 32
COARSE = 12
ROUNDS = 150
PAIRS = 6
PAIR_ROUNDS = 60
RATE = 0.15

FEATURES = (
    "words", "word_chars", "symbols", "stop_words", "dup_lines", "ended_lines", "repeats", "upper", "digits",
    "exclaims", "line_words", "distinct", "plain",
)


def features(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and one struct column ``features`` of doubles; null where a ratio has no base."""
    rows = docs.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(carry)], whole(column(text)).alias("_t"))
    rows = measure(rows, "_t", "_m")
    m, t = F.col("_m"), F.col("_t")
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    chars = F.length(t)
    count = lambda regex: F.regexp_count(t, F.lit(regex))
    values = (
        F.log1p(m["n_words"]), m["mean_word_chars"], m["symbols_per_word"], m["stop_share"], m["dup_line_share"],
        m["ended_line_share"], share(m["n_repeat_words"], m["n_words"]), share(count("[A-Z]"), chars),
        share(count("[0-9]"), chars), share(count("!"), m["n_words"]), share(m["n_words"], m["n_lines"]),
        share(F.size(F.array_distinct(words(t))), m["n_words"]), share(count(r"[a-z,.\x20]"), chars),
    )
    packed = F.struct(*[v.cast("double").alias(n) for n, v in zip(FEATURES, values)])
    return rows.select(*[F.col(f"_c{i}") for i in range(len(carry))], packed.alias("features")).toDF(*carry, "features")


@dataclass
class Model:
    """Bin edges for each feature, a table for each, and tables for pairs with their coarse edges."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        fine = [bins(x[:, j], self.edges[j]) for j in range(len(self.tables))]
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[fine[j]]
        for a, b, table in self.pairs:
            total += table[bins(x[:, a], self.coarse[a]), bins(x[:, b], self.coarse[b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers from 1; 0 for missing values."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, side="right") + 1)


def _edges(values: np.ndarray, many: int) -> np.ndarray:
    values = values[~np.isnan(values)]
    return np.unique(np.quantile(values, np.linspace(0, 1, many + 1)[1:-1])) if len(values) else np.empty(0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: gain and the first bin on the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over bins, from their gradients and curvatures."""
    gain, cut = _split(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree_of_two(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values over two-way bins: the better first axis is cut once, each part once along the other."""

    def along(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        out, gained = np.zeros_like(g), 0.0
        best, cut = _split(g.sum(1), h.sum(1))
        for part in (slice(None, cut), slice(cut, None)) if cut else (slice(None),):
            gain, _ = _split(g[part].sum(0), h[part].sum(0))
            out[part] = _tree(g[part].sum(0), h[part].sum(0), 1)[None, :]
            gained += gain
        return best + gained, out

    one, two = along(g, h), along(g.T, h.T)
    return one[1] if one[0] >= two[0] else two[1].T


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost tables for ``y`` (0 or 1) on features ``x``, some of which may be NaN."""
    n = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges, coarse = [_edges(x[:, j], BINS) for j in range(n)], [_edges(x[:, j], COARSE) for j in range(n)]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 2) for e in edges], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    fine = [bins(x[:, j], edges[j]) for j in range(n)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size))
            model.tables[j] += step
            total += step[fine[j]]

    two = [bins(x[:, j], coarse[j]) for j in range(n)]
    shape = [len(c) + 2 for c in coarse]
    cells = lambda a, b: two[a] * shape[b] + two[b]

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cells(a, b), v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    gains = []
    for a in range(n):
        for b in range(a + 1, n):
            v, ga, ha = _tree_of_two(table(a, b, g), table(a, b, h)), table(a, b, g), table(a, b, h)
            gains.append((float(-(ga * v).sum() - 0.5 * (ha * v**2).sum()), a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 1e-6]
    tables = {pair: np.zeros((shape[pair[0]], shape[pair[1]])) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = slopes()
            step = RATE * _tree_of_two(table(a, b, g), table(a, b, h))
            tables[a, b] += step
            total += step[two[a], two[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def train(featured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``featured`` that ``labels`` has a 0 or 1 for: those with the least hashes of the key.

    They are counted first, and only those whose hash is in the lowest share that holds a fifth more than the sample are sorted.
    """
    known = labels.select(column(key).alias("k"), column(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    rows = featured.select(column(key).alias("k"), "features").join(known, "k")
    share = 1.2 * sample / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.xxhash64("k") < int(share * 2**64) - 2**63)
    rows = rows.orderBy(F.xxhash64("k"), "k", "y").limit(sample).select("features.*", "y").toPandas()
    x = rows[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(featured: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``featured`` with the model's score of every row."""

    @F.pandas_udf(DoubleType())
    def scored(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(rows[list(FEATURES)].to_numpy(np.float64)))

    return featured.withColumn(into, scored("features"))


def held_out(key: str = "doc_id", parts: int = 5):
    """Whether a row's id, by its checksum, is kept from training."""
    return F.coalesce(F.crc32(column(key).cast("string").cast("binary")) % parts == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The id and score of every document, and whether its label was kept from training."""
    featured = keep(features(docs, text, (key,)), "gam-features")
    model = train(featured.where(~held_out(key)), labels, key, sample=sample)
    return score(featured, model).withColumn("held_out", held_out(key)).drop("features")
