"""Isolation forest (Liu, Ting & Zhou 2008): trees over a bounded sample, scores by vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError, SchemaError

EULER = 0.5772156649015329


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (n - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a full binary tree of ``depth`` levels: feature and threshold of inner nodes (children of k are 2k + 1
    and 2k + 2), and the path length that each last-level node stands for. Below a leaf every row goes left."""
    inner = 2**depth - 1
    feature, threshold, length = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)

    def add(rows: np.ndarray, node: int, at: int) -> None:
        span = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        if at >= depth or len(rows) <= 1 or not span.any():
            first = node
            for _ in range(depth - at):
                first = 2 * first + 1
            length[first - inner] = at + float(expected_depth(len(rows)))
            return
        f = int(rng.choice(np.flatnonzero(span)))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        low = rows[:, f] < cut
        feature[node], threshold[node] = f, cut
        add(rows[low], 2 * node + 1, at + 1)
        add(rows[~low], 2 * node + 2, at + 1)

    add(x, 0, 0)
    return feature, threshold, length


def path_lengths(x: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Sum over the trees of each row's path length."""
    cells, rows, total = np.ascontiguousarray(x.T).ravel(), np.arange(len(x)), np.zeros(len(x))
    for feature, threshold, length in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (cells[feature[at] * len(x) + rows] >= threshold[at])
        total += length[at - len(feature)]
    return total


class IsolationForest:
    """``contamination``: "auto" flags scores above 0.5, a share flags that part of the training rows.

    Trees see at most ``trees * sample`` rows, those of the least hashes. Rows with a missing cell are no outliers.
    """

    def __init__(self, columns: list[str], *, contamination: str | float = "auto", trees: int = 100, sample: int = 256, seed: int = 0):
        if contamination != "auto" and not 0 < float(contamination) <= 0.5:
            raise ConfigurationError(f"contamination is 'auto' or a share in (0, 0.5], got {contamination!r}")
        self.columns, self.contamination, self.trees, self.sample, self.seed = columns, contamination, trees, sample, seed

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(*[number(df, c).alias(c) for c in self.columns]).na.drop()

    def fit(self, df: DataFrame) -> IsolationForest:
        names = [F.col(f"`{c}`") for c in self.columns]
        drawn = self._rows(df).withColumn("__h", F.xxhash64(F.lit(self.seed), *names))
        pool = drawn.orderBy("__h", *names).limit(self.trees * self.sample).drop("__h").toPandas().to_numpy(np.float64)
        if not len(pool):
            raise SchemaError("every row has a missing cell: there is nothing to learn from")
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(pool))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.depth_ = depth
        self.forest_ = [grow(pool[rng.choice(len(pool), size, replace=False)], rng, depth) for _ in range(self.trees)]
        self.norm_ = float(expected_depth(size)) or 1.0
        self.limit_ = 0.5
        if self.contamination != "auto":
            scores = df.select(self.score(df).alias("s"))
            self.limit_ = scores.agg(F.percentile("s", F.lit(1 - float(self.contamination)))).first()[0]
        return self

    def score(self, df: DataFrame) -> Column:
        """Anomaly score in (0, 1]; NULL for rows with a missing cell."""
        forest, norm, depth = self.forest_, self.norm_, self.depth_

        @F.pandas_udf("double")
        def scored(cells: pd.Series) -> pd.Series:
            x = np.array(cells.tolist(), np.float64).reshape(len(cells), -1)
            known = ~np.isnan(x).any(1)
            total = path_lengths(np.where(np.isnan(x), 0.0, x), forest, depth)
            return pd.Series(np.where(known, 2.0 ** (-total / len(forest) / norm), np.nan))

        made = scored(F.array(*[number(df, c) for c in self.columns]))
        return F.when(~F.isnan(made), made)

    def flag(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(self.score(df) > self.limit_, F.lit(False)))
