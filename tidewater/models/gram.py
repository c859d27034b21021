"""Sums of cross products over a distributed table: what linear methods need of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_of(df: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows' batches of ``of(matrix of the batch)``; one fixed-size array per partition is shuffled."""
    size = int(np.prod(shape))

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total = total + of(batch.to_numpy(np.float64))
        yield pd.DataFrame({"k": np.arange(size), "v": total.ravel()})

    parts = df.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for k, v in parts.collect():  # as many rows as the array has cells
        out[k] = v
    return out.reshape(shape)


def gram(df: DataFrame) -> np.ndarray:
    """Z'Z of the table's numeric columns with a column of ones put first; no cell may be missing."""
    m = len(df.columns) + 1

    def of(x: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), x))
        return z.T @ z

    return sum_of(df, (m, m), of)


#: Columns up to which the sums are one JVM aggregate; beyond, one array per partition is summed in Arrow batches.
JVM_COLUMNS = 30


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and centred cross products of the table's columns. The means are taken off first, so
    large values do not cancel."""
    names = df.columns
    first = df.agg(F.count("*"), *[F.avg(F.col(f"`{c}`")) for c in names]).first()
    n, m = first[0], len(names)
    if not n:
        return 0, np.zeros(m), np.zeros((m, m))
    means = np.array(first[1:], float)
    x = [F.col(f"`{c}`") - F.lit(float(a)) for c, a in zip(names, means)]
    if m > JVM_COLUMNS:
        return n, means, gram(df.select(*[v.alias(c) for v, c in zip(x, names)]))[1:, 1:]
    cells = [(i, j) for i in range(m) for j in range(i + 1)]
    out = np.zeros((m, m))
    for (i, j), v in zip(cells, df.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in cells]).first()):
        out[i, j] = out[j, i] = v
    return n, means, out


def elastic_net(s: np.ndarray, y: np.ndarray, n: int, alpha: float, share: float, rounds: int, tol: float) -> np.ndarray:
    """Coordinate descent on centred cross products: 1/(2n) squares + alpha share |w| + alpha (1 - share)/2 w^2."""
    w = np.zeros(len(y))
    for _ in range(rounds):
        most = 0.0
        for k in range(len(w)):
            if s[k, k] <= 0:
                continue
            pull = (y[k] - s[k] @ w + s[k, k] * w[k]) / n
            new = np.sign(pull) * max(abs(pull) - alpha * share, 0.0) / (s[k, k] / n + alpha * (1 - share))
            most, w[k] = max(most, abs(new - w[k])), new
        if most < tol:
            break
    return w


def centred(g: np.ndarray, x: list[int], y: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
    """From Z'Z: centred X'X, X'y, y'y for columns ``x`` and ``y``, their means, and the number of rows."""
    n = g[0, 0]
    mx, my = g[0, x] / n, g[0, y] / n
    xx = g[np.ix_(x, x)] - n * np.outer(mx, mx)
    return xx, g[x, y] - n * mx * my, max(g[y, y] - n * my * my, 0.0), mx, my, n


def ridge(g: np.ndarray, x: list[int], y: int, penalty: float | np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and coefficients under an L2 penalty (one number, or one for each coefficient)."""
    xx, xy, _, mx, my, _ = centred(g, x, y)
    w = np.linalg.lstsq(xx + np.diag(np.broadcast_to(penalty, len(x))), xy, rcond=None)[0]
    return float(my - mx @ w), w


def bayesian_ridge(g: np.ndarray, x: list[int], y: int, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> tuple[float, np.ndarray]:
    """Ridge regression whose noise and weight precisions maximise the evidence (MacKay 1992; gamma priors)."""
    xx, xy, yy, mx, my, n = centred(g, x, y)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ xy
    noise, weight, w = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        new = vectors @ (turned / (values + weight / noise))
        left = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        used = float((noise * values / (weight + noise * values)).sum())
        weight = (used + 2 * prior) / (float(new @ new) + 2 * prior)
        noise = (n - used + 2 * prior) / (left + 2 * prior)
        if w is not None and np.abs(new - w).sum() < tol:
            w = new
            break
        w = new
    return float(my - mx @ w), w
