"""Iterative imputation: each column is modelled by the others, round after round.

Rows without gaps enter once, as cross products. Rows with gaps never need to be kept in a filled state: a
row's state is its raw cells with the fitted models replayed in order. What is learned is that sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError
from tidewater.models.gram import bayesian_ridge, gram, ridge, sum_of

#: Rows with gaps that the driver works on; beyond, every model is one aggregate over them.
DRIVER_ROWS = 50_000

#: A round that changes no cell by more than this share of the largest known one is the last.
TOLERANCE = 1e-3

ESTIMATORS: dict[str, Callable] = {"bayesian_ridge": bayesian_ridge, "ridge": lambda g, x, y: ridge(g, x, y, 1.0), "linear": lambda g, x, y: ridge(g, x, y, 1e-12)}


def replay(raw: np.ndarray, means: np.ndarray, models: list[tuple[int, float, np.ndarray]]) -> np.ndarray:
    """Fill the gaps of raw rows: means first, then each model in turn for its column."""
    gaps = np.isnan(raw)
    x = np.where(gaps, means, raw)
    for column, intercept, weights in models:
        rest = np.delete(x, column, axis=1)
        x[:, column] = np.where(gaps[:, column], intercept + rest @ weights, x[:, column])
    return x


class IterativeImputer:
    """Impute numeric ``columns``; a column that is missing throughout stays missing."""

    def __init__(self, columns: list[str], *, max_iter: int = 10, estimator: str | Callable | None = None):
        if isinstance(estimator, str) and estimator not in ESTIMATORS:
            raise ConfigurationError(f"unknown estimator {estimator!r}; known: {sorted(ESTIMATORS)}, or a function of (cross products, columns, target)")
        self.columns, self.max_iter = columns, max_iter
        self.estimate = estimator if callable(estimator) else ESTIMATORS[estimator or "bayesian_ridge"]

    def fit(self, df: DataFrame) -> IterativeImputer:
        stats = df.agg(*[F.array(F.avg(number(df, c)), F.sum(number(df, c).isNull().cast("double")), F.max(F.abs(number(df, c)))) for c in self.columns]).first()
        self.used_ = [c for c, s in zip(self.columns, stats) if s[0] is not None]
        stats = [s for s in stats if s[0] is not None]
        self.means_, self.models_ = np.array([s[0] for s in stats]), []
        order = [k for k in np.argsort([s[1] for s in stats], kind="stable") if stats[k][1] > 0]
        if len(self.used_) < 2 or not order:
            return self
        rows = df.select(*[number(df, c).alias(c) for c in self.used_])
        known = F.lit(True)
        for c in self.used_:
            known = known & F.col(f"`{c}`").isNotNull()
        whole, gappy = gram(rows.where(known)), rows.where(~known).persist()
        count = gappy.count()
        held = gappy.toPandas().to_numpy(np.float64) if count <= DRIVER_ROWS else None
        largest = max(s[2] for s in stats)
        before = replay(held, self.means_, []) if held is not None else None
        for _ in range(self.max_iter):
            for k in order:
                rest = [j + 1 for j in range(len(self.used_)) if j != k]
                self.models_.append((int(k), *self.estimate(whole + self._products(gappy, held, k), rest, k + 1)))
            change = self._change(gappy, held, before, len(order))
            before = replay(held, self.means_, self.models_) if held is not None else None
            if change < TOLERANCE * largest:
                break
        gappy.unpersist()
        return self

    def _products(self, gappy: DataFrame, held: np.ndarray | None, k: int) -> np.ndarray:
        """Cross products of the rows with gaps, as filled so far, that know column ``k``."""
        means, models, m = self.means_, list(self.models_), len(self.used_) + 1

        def of(raw: np.ndarray) -> np.ndarray:
            raw = raw[~np.isnan(raw[:, k])]
            z = np.column_stack((np.ones(len(raw)), replay(raw, means, models)))
            return z.T @ z

        return of(held) if held is not None else sum_of(gappy, (m, m), of)

    def _change(self, gappy: DataFrame, held: np.ndarray | None, before: np.ndarray | None, last: int) -> float:
        """Largest change of a cell in the last round."""
        means, models = self.means_, list(self.models_)
        if held is not None:
            return float(np.abs(replay(held, means, models) - before).max(initial=0.0))

        @F.pandas_udf("double")
        def moved(cells: pd.Series) -> pd.Series:
            raw = np.array(cells.tolist(), np.float64).reshape(len(cells), len(means))
            return pd.Series(np.abs(replay(raw, means, models) - replay(raw, means, models[:-last])).max(1))

        return gappy.agg(F.max(moved(F.array(*[F.col(f"`{c}`") for c in self.used_])))).first()[0] or 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.used_:
            return df
        means, models = self.means_, self.models_

        @F.pandas_udf("array<double>")
        def filled(cells: pd.Series) -> pd.Series:
            raw = np.array(cells.tolist(), np.float64).reshape(len(cells), len(means))
            return pd.Series(list(replay(raw, means, models)))

        cells = {c: number(df, c) for c in self.used_}
        made = df.withColumn("__filled", filled(F.array(*cells.values())))
        new = {c: F.coalesce(x, F.get(F.col("__filled"), F.lit(k))) for k, (c, x) in enumerate(cells.items())}
        return made.withColumns(new).drop("__filled")
