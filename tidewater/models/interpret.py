"""What a fitted model goes by: permutation importance, tree Shapley values, weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError
from tidewater.core.shared import scratch
from tidewater.evaluation.metrics import score
from tidewater.models.gram import sum_of
from tidewater.models.registry import Regressor, Trees


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """The frame with one column's values shuffled among the rows: two random orders joined by position."""
    def positions(rows: DataFrame, s: int, name: str) -> DataFrame:
        mixed = rows.withColumn("__u", F.rand(s)).repartitionByRange("__u").sortWithinPartitions("__u").withColumn("__id", F.monotonically_increasing_id())
        mixed = scratch(mixed, "mixed")  # a random order: fix it
        part = F.shiftright("__id", 33)
        before, offset = 0, []
        for p, n in sorted(map(tuple, mixed.groupBy(part).count().collect())):  # one number for each partition
            offset += [F.lit(p), F.lit(before)]
            before += n
        start = F.create_map(*offset)[part] if offset else F.lit(0)
        return mixed.withColumn(name, start + F.col("__id") - F.shiftleft(part, 33)).drop("__u", "__id")

    rows = positions(df, seed, "__at")
    values = positions(df.select(F.col(f"`{column}`").alias("__value")), seed + 7919, "__from")
    return rows.join(values, F.col("__at") == F.col("__from")).withColumn(column, F.col("__value")).drop("__at", "__from", "__value").select(*df.columns)


def permutation_importance_report(
    model: Regressor, df: DataFrame, target: str, *, n_repeats: int = 5, random_state: int = 0, scoring: str | Callable[[DataFrame], float] = "r2",
) -> DataFrame:
    """``feature, importance_mean, importance_std`` (population), largest first: how much a feature's shuffling costs.

    ``scoring`` is a metric (errors are negated) or a function of the predicted frame; greater is better.
    """
    if n_repeats < 1:
        raise ConfigurationError(f"n_repeats must be positive, got {n_repeats}")
    upwards = {"r2", "pearson_r", "spearman_r", "index_of_agreement", "fac2"}

    def value(rows: DataFrame) -> float:
        predicted = model.predict(rows, "__pred")
        if callable(scoring):
            return float(scoring(predicted))
        got = score(predicted, target, "__pred", metrics=[scoring])[scoring]
        return float("nan") if got is None else got if scoring in upwards else -got

    base = value(df)
    out = []
    for k, f in enumerate(model.features_):
        costs = [base - value(permuted(df, f, random_state + 101 * k + r)) for r in range(n_repeats)]
        out.append((f, float(np.mean(costs)), float(np.std(costs))))
    out.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double")


def extract_importances(model: Regressor, names: Sequence[str] | None = None) -> dict[str, float]:
    """Weights of a model's features, under other names if given."""
    got = model.importances()
    if names is not None and len(names) != len(got):
        raise ConfigurationError(f"{len(names)} names for {len(got)} features")
    return dict(zip(names or got, got.values()))


def importance_table(df: DataFrame, importances: dict[str, float], top: int = 20) -> DataFrame:
    """The ``top`` features, largest first."""
    rows = df.sparkSession.createDataFrame(list(importances.items()), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


class _Tree:
    """A regression tree in arrays; leaves have feature -1."""

    def __init__(self, rows: list[tuple[int, int, float, float, int, int]], scale: float):
        at = {r[0]: k for k, r in enumerate(sorted(rows))}
        rows = sorted(rows)
        self.feature = [r[1] for r in rows]
        self.threshold = [r[2] for r in rows]
        self.value = [r[3] * scale for r in rows]
        self.left = [at.get(r[4], -1) for r in rows]
        self.right = [at.get(r[5], -1) for r in rows]
        self.cover = [0.0] * len(rows)

    def count(self, x: np.ndarray) -> np.ndarray:
        """Rows that pass each node."""
        out = np.zeros(len(self.feature))

        def go(node: int, rows: np.ndarray) -> None:
            out[node] = len(rows)
            if self.feature[node] >= 0 and len(rows):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                go(self.left[node], rows[low])
                go(self.right[node], rows[~low])

        go(0, np.arange(len(x)))
        return out

    def shap(self, x: np.ndarray, phi: np.ndarray) -> None:
        """Add the Shapley values of one row (Lundberg et al. 2020, algorithm 2)."""

        def extend(path: list[list[float]], zero: float, one: float, f: int) -> list[list[float]]:
            path = [p[:] for p in path] + [[f, zero, one, 1.0 if not path else 0.0]]
            size = len(path)
            for i in range(size - 2, -1, -1):
                path[i + 1][3] += one * path[i][3] * (i + 1) / size
                path[i][3] = zero * path[i][3] * (size - 1 - i) / size
            return path

        def unwind(path: list[list[float]], i: int) -> list[list[float]]:
            size, one, zero = len(path), path[i][2], path[i][1]
            nxt, out = path[-1][3], [p[:] for p in path]
            for j in range(size - 2, -1, -1):
                if one:
                    kept = out[j][3]
                    out[j][3] = nxt * size / ((j + 1) * one)
                    nxt = kept - out[j][3] * zero * (size - 1 - j) / size
                else:
                    out[j][3] = out[j][3] * size / (zero * (size - 1 - j))
            for j in range(i, size - 1):
                out[j][:3] = out[j + 1][:3]
            return out[:-1]

        def go(node: int, path: list[list[float]], zero: float, one: float, f: int) -> None:
            path = extend(path, zero, one, f)
            if self.feature[node] < 0:
                for i in range(1, len(path)):
                    total = sum(p[3] for p in unwind(path, i))
                    phi[int(path[i][0])] += total * (path[i][2] - path[i][1]) * self.value[node]
                return
            split = self.feature[node]
            hot, cold = (self.left[node], self.right[node]) if x[split] <= self.threshold[node] else (self.right[node], self.left[node])
            in_zero = in_one = 1.0
            for i in range(1, len(path)):
                if path[i][0] == split:
                    in_zero, in_one = path[i][1], path[i][2]
                    path = unwind(path, i)
                    break
            whole = self.cover[node] or 1.0
            go(hot, path, in_zero * self.cover[hot] / whole, in_one, split)
            go(cold, path, in_zero * self.cover[cold] / whole, 0.0, split)

        go(0, [], 1.0, 1.0, -1)

    def mean(self) -> float:
        leaves = [k for k, f in enumerate(self.feature) if f < 0]
        return sum(self.value[k] * self.cover[k] for k in leaves) / (self.cover[0] or 1.0)


def _trees_of(model: Trees) -> list[_Tree]:
    """The trees of a fitted Spark ML ensemble, read from the model's own node tables."""
    fitted = model.model_
    members = list(fitted.trees) if hasattr(fitted, "trees") else [fitted]
    scales = list(fitted.treeWeights) if hasattr(fitted, "treeWeights") else [1.0]
    average = len(members) if type(fitted).__name__.startswith("RandomForest") else 1
    out = []
    for tree, scale in zip(members, scales):
        rows, todo, ident = [], [(tree._call_java("rootNode"), 0)], 0
        while todo:
            node, k = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                rows.append((k, -1, 0.0, float(node.prediction()), -1, -1))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ConfigurationError("only splits of numbers can be explained")
            left, right, ident = ident + 1, ident + 2, ident + 2
            rows.append((k, int(split.featureIndex()), float(split.threshold()), 0.0, left, right))
            todo += [(node.leftChild(), left), (node.rightChild(), right)]
        out.append(_Tree(rows, scale / average if average > 1 else scale))
    return out


def tree_shap_values(model: Regressor, df: DataFrame, *, prefix: str = "shap_") -> DataFrame:
    """Append ``shap_<feature>`` and ``shap_base``: with the base they add up to the prediction.

    Branch weights are the counts of all complete rows of ``df`` that pass each node. Rows with a missing feature get
    NULL.
    """
    if not isinstance(model, Trees):
        raise ConfigurationError(f"tree Shapley values need a tree model, not {type(model).__name__}")
    trees, names = _trees_of(model), list(model.features_)
    cells = [number(df, c).alias(c) for c in names]
    nodes = sum(len(t.feature) for t in trees)
    covers = sum_of(df.select(*cells).na.drop(), (nodes,), lambda x: np.concatenate([t.count(x) for t in trees]))
    for t, cover in zip(trees, np.split(covers, np.cumsum([len(t.feature) for t in trees])[:-1])):
        t.cover = cover.tolist()
    base = sum(t.mean() for t in trees)

    @F.pandas_udf("array<double>")
    def explained(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            x, phi = np.asarray(row, np.float64), np.zeros(len(names))
            if np.isnan(x).any():
                out.append(None)
                continue
            for t in trees:
                t.shap(x, phi)
            out.append(phi.tolist())
        return pd.Series(out)

    made = df.withColumn("__phi", explained(F.array(*[number(df, c) for c in names])))
    values = {f"{prefix}{c}": F.get("__phi", F.lit(k)) for k, c in enumerate(names)}
    return made.withColumns(values | {f"{prefix}base": F.when(F.col("__phi").isNotNull(), F.lit(base))}).drop("__phi")


def shap_importance(explained: DataFrame, *, prefix: str = "shap_") -> DataFrame:
    """``feature, mean_abs_shap``, largest first."""
    names = [c for c in explained.columns if c.startswith(prefix) and c != f"{prefix}base"]
    if not names:
        raise ConfigurationError(f"the frame has no columns that begin with {prefix!r}")
    row = explained.agg(*[F.avg(F.abs(F.col(f"`{c}`"))).alias(c) for c in names])
    parts = F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("feature"), F.col(f"`{c}`").alias("mean_abs_shap")) for c in names])
    return row.select(F.inline(parts)).orderBy(F.desc("mean_abs_shap"), "feature")
