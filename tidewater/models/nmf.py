"""Non-negative matrix factorisation for source apportionment: V ~ W H with H (k x m) on the driver.

Given H, the weights of a row are a function of that row alone (hierarchical alternating least squares,
Cichocki & Phan 2009), so nothing about W is kept between rounds: each round is one aggregate of W'W and W'V.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number, require_numeric, resolve
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.models.gram import sum_of

TINY = 1e-12


def weights(v: np.ndarray, h: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Non-negative weights of rows for fixed factors."""
    hh, vh = h @ h.T, v @ h.T
    w = np.maximum(vh / np.maximum(np.diag(hh), TINY) / len(h), 0.0)
    for _ in range(rounds):
        for k in range(len(h)):
            w[:, k] = np.maximum(w[:, k] + (vh[:, k] - w @ hh[:, k]) / max(hh[k, k], TINY), 0.0)
    return w


class NMFApportionment:
    """Factors of non-negative columns. ``scale`` brings columns to 0..1 first. Missing cells are refused, and so are
    negative ones unless scaled (a later row below the fitted least value counts as that value)."""

    def __init__(self, n_components: int = 2, *, columns: Iterable[str] | None = None, scale: bool = True, random_state: int = 0, max_iter: int = 200, tol: float = 1e-4):
        if n_components < 1:
            raise ConfigurationError(f"n_components must be positive, got {n_components}")
        self.n_components, self.columns, self.scale, self.random_state, self.max_iter, self.tol = n_components, columns, scale, random_state, max_iter, tol
        self.h_: np.ndarray | None = None

    def fit(self, df: DataFrame) -> NMFApportionment:
        self.columns_ = resolve(df, list(self.columns) if self.columns is not None else None, numeric_only=True)
        require_numeric(df, self.columns_, "NMFApportionment")
        x = {c: number(df, c) for c in self.columns_}
        stats = df.agg(*[F.array(F.min(v), F.max(v), F.sum(v.isNull().cast("double")), F.avg(v)) for v in x.values()]).first()
        if any(s[2] for s in stats):
            raise SchemaError(f"missing cells in {[c for c, s in zip(x, stats) if s[2]]}; fill them first")
        if any(s[0] is None for s in stats):
            raise SchemaError("there are no rows")
        if not self.scale and any(s[0] < 0 for s in stats):
            raise SchemaError(f"negative values in {[c for c, s in zip(x, stats) if s[0] < 0]}; use scale=True")
        self.low_ = np.array([s[0] if self.scale else 0.0 for s in stats])
        self.span_ = np.array([(s[1] - s[0] or 1.0) if self.scale else 1.0 for s in stats])
        rows, m, k = self._rows(df).persist(), len(self.columns_), self.n_components
        mean = (np.array([s[3] for s in stats]) - self.low_) / self.span_
        h = np.random.default_rng(self.random_state).uniform(0.1, 1.0, (k, m)) * np.maximum(mean, TINY)
        last = np.inf
        for _ in range(self.max_iter):
            def of(v: np.ndarray, h: np.ndarray = h) -> np.ndarray:
                w = weights(v, h)
                return np.block([[w.T @ w, w.T @ v], [np.full((1, k), np.square(v - w @ h).sum() / k), np.zeros((1, m))]])

            total = sum_of(rows, (k + 1, k + m), of)
            ww, wv, error = total[:k, :k], total[:k, k:], float(total[k, :k].sum())
            for _ in range(10):
                for j in range(k):
                    h[j] = np.maximum(h[j] + (wv[j] - ww[j] @ h) / max(ww[j, j], TINY), TINY)
            if last - error <= self.tol * max(last if np.isfinite(last) else error, TINY):
                break
            last = error
        rows.unpersist()
        self.h_, self.reconstruction_err_ = h, float(np.sqrt(max(error, 0.0)))
        return self

    def _rows(self, df: DataFrame) -> DataFrame:
        cells = [F.greatest((number(df, c) - F.lit(float(a))) / F.lit(float(s)), F.lit(0.0)).alias(c) for c, a, s in zip(self.columns_, self.low_, self.span_)]
        return df.select(*cells)

    def transform(self, df: DataFrame) -> DataFrame:
        """Append ``factor_1`` to ``factor_k``."""
        if self.h_ is None:
            raise NotFittedError("the factorisation is not fitted")
        resolve(df, self.columns_)
        h, low, span = self.h_, self.low_, self.span_

        @F.pandas_udf("array<double>")
        def shares(cells: pd.Series) -> pd.Series:
            v = np.maximum((np.array(cells.tolist(), np.float64).reshape(len(cells), -1) - low) / span, 0.0)
            return pd.Series(list(weights(v, h)))

        made = df.withColumn("__w", shares(F.array(*[number(df, c) for c in self.columns_])))
        return made.withColumns({f"factor_{k + 1}": F.get("__w", F.lit(k)) for k in range(self.n_components)}).drop("__w")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def loadings(self) -> pd.DataFrame:
        """Factors by columns, as a small table."""
        if self.h_ is None:
            raise ConfigurationError("fit the factorisation first")
        return pd.DataFrame(self.h_, index=[f"factor_{k + 1}" for k in range(self.n_components)], columns=self.columns_)
