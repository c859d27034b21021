"""Small neural networks in NumPy: a perceptron over rows, and LSTM and convolution over sequences of rows.

Networks of this size learn from a bounded table: training rows are collected up to ``max_rows`` (more are
refused, not dropped); prediction runs as a vectorised UDF over any number of rows.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.axis import Axis, over_rows
from tidewater.core.columns import number, require_numeric, resolve
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.models.registry import Regressor

Weights = dict[str, np.ndarray]


def make_sequences(df: DataFrame, axis: Axis, features: Sequence[str], target: str | None = None, *, window: int = 24, horizon: int = 1) -> DataFrame:
    """Append ``sequence`` (``window`` rows of features from this one on) and ``target_next``, the target ``horizon`` rows
    after the window's last. Only rows with a whole window and an existing target row stay: n - window - horizon + 1.
    """
    if window < 1 or horizon < 1:
        raise ConfigurationError(f"window and horizon are positive, got {window} and {horizon}")
    features = resolve(df, list(features))
    require_numeric(df, features, "make_sequences")

    def build(w):
        cells = F.array(*[number(df, c) for c in features])
        out = {"sequence": F.collect_list(F.struct(cells.alias("x"))).over(w.rowsBetween(0, window - 1))}
        at = window - 1 + horizon
        out["__there"] = F.lead(F.lit(1), at).over(w) if target is not None else F.lit(1)
        if target is not None:
            out["target_next"] = F.lead(number(df, target), at).over(w)
        return out

    rows = over_rows(df, axis, build, ahead=window - 1 + horizon)
    whole = rows.where((F.size("sequence") == window) & F.col("__there").isNotNull()).drop("__there")
    return whole.withColumn("sequence", F.transform("sequence", lambda s: s["x"]))


class _Adam:
    def __init__(self, weights: Weights, rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def step(self, grads: Weights) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Network(Regressor):
    """Standardised inputs and target (population deviation, 0 counts as 1), mean squared error, Adam, early stopping
    on the last ``validation_fraction`` of the rows in time order."""

    def __init__(
        self, *, dropout: float = 0.1, learning_rate: float = 1e-3, epochs: int = 100, batch_size: int = 32, validation_fraction: float = 0.1,
        patience: int = 10, random_state: int = 0, max_rows: int = 1_000_000, axis: Axis | None = None, **more,
    ):
        if not 0 <= dropout < 1 or epochs < 1 or batch_size < 1 or not 0 <= validation_fraction < 1:
            raise ConfigurationError("dropout and validation_fraction are in [0, 1); epochs and batch_size are positive")
        super().__init__(
            dropout=dropout, learning_rate=learning_rate, epochs=epochs, batch_size=batch_size, validation_fraction=validation_fraction,
            patience=patience, random_state=random_state, max_rows=max_rows, axis=axis, **more,
        )
        self.weights_: Weights | None = None

    @abstractmethod
    def start(self, m: int, rng: np.random.Generator) -> Weights:
        """Initial weights for m features."""

    @abstractmethod
    def forward(self, w: Weights, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """Predictions and what ``backward`` needs; dropout only with ``rng``."""

    @abstractmethod
    def backward(self, w: Weights, kept: tuple, error: np.ndarray) -> Weights:
        """Gradients from the gradient of the loss by the predictions."""

    def _drop(self, h: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
        rate = self.params["dropout"]
        mask = (rng.random(h.shape) >= rate) / (1 - rate) if rng is not None and rate else np.ones_like(h)
        return h * mask, mask

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit arrays in time order: x (rows, features) or (rows, window, features)."""
        p = self.params
        if not len(x):
            raise SchemaError("there are no complete rows to learn from")
        rng = np.random.default_rng(p["random_state"])
        flat = x.reshape(-1, x.shape[-1])
        deviation = flat.std(0)
        self.x_mean_, self.x_std_ = flat.mean(0), np.where(deviation > 0, deviation, 1.0)
        self.y_mean_, self.y_std_ = float(y.mean()), float(y.std()) or 1.0
        x, y = (x - self.x_mean_) / self.x_std_, (y - self.y_mean_) / self.y_std_
        tail = int(len(x) * p["validation_fraction"])
        cut = len(x) - tail if len(x) - tail >= 1 else len(x)
        w = self.start(x.shape[-1], rng)
        adam, best, kept, idle = _Adam(w, p["learning_rate"]), np.inf, w, 0
        for _ in range(p["epochs"]):
            order = rng.permutation(cut)
            for a in range(0, cut, p["batch_size"]):
                rows = order[a : a + p["batch_size"]]
                out, held = self.forward(w, x[rows], rng)
                adam.step(self.backward(w, held, 2 * (out - y[rows]) / len(rows)))
            if cut < len(x):
                loss = float(np.mean((self.forward(w, x[cut:])[0] - y[cut:]) ** 2))
                if loss < best - 1e-9:
                    best, kept, idle = loss, {k: v.copy() for k, v in w.items()}, 0
                elif (idle := idle + 1) >= p["patience"]:
                    break
            else:
                kept = w
        self.weights_ = kept

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.weights_, (x - self.x_mean_) / self.x_std_)[0] * self.y_std_ + self.y_mean_

    def _collected(self, rows: DataFrame) -> pd.DataFrame:
        got = rows.limit(self.params["max_rows"] + 1).toPandas()
        if len(got) > self.params["max_rows"]:
            raise ConfigurationError(f"training takes at most max_rows={self.params['max_rows']} rows; sample or raise it")
        return got

    def _scorer(self, shape: tuple[int, ...]):
        @F.pandas_udf("double")
        def scored(cells: pd.Series) -> pd.Series:
            out = np.full(len(cells), np.nan)
            rows = [None if c is None else np.array([list(r) for r in c] if len(shape) > 1 else list(c), np.float64) for c in cells]
            whole = [k for k, r in enumerate(rows) if r is not None and r.shape == shape and not np.isnan(r).any()]
            if whole:
                out[whole] = self.score_rows(np.stack([rows[k] for k in whole]))
            return pd.Series(out)

        return scored


class MLPRegressor(Network):
    """A perceptron with rectified hidden layers."""

    def __init__(self, *, hidden: Sequence[int] = (64, 32), **more):
        super().__init__(hidden=tuple(hidden), **more)

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> MLPRegressor:
        axis = self.params["axis"]
        return super().fit(axis.sort(df) if axis else df, features, target)

    def learn(self, rows: DataFrame) -> None:
        got = self._collected(rows).to_numpy(np.float64)
        self.train(got[:, :-1], got[:, -1])

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        made = self._scorer((len(self.features_),))(F.array(*[number(df, c) for c in self.features_]))
        return df.withColumn(name, F.when(~F.isnan(made), made))

    def start(self, m: int, rng: np.random.Generator) -> Weights:
        sizes = [m, *self.params["hidden"], 1]
        return {f"{n}{k}": v for k, (a, b) in enumerate(zip(sizes, sizes[1:])) for n, v in (("w", rng.normal(0, np.sqrt(2 / a), (a, b))), ("b", np.zeros(b)))}

    def forward(self, w, x, rng=None):
        layers, h, kept = len(self.params["hidden"]), x, []
        for k in range(layers):
            z = h @ w[f"w{k}"] + w[f"b{k}"]
            out, mask = self._drop(np.maximum(z, 0), rng)
            kept.append((h, z, mask))
            h = out
        return (h @ w[f"w{layers}"] + w[f"b{layers}"])[:, 0], (kept, h)

    def backward(self, w, kept, error):
        (layers, h), grads, k = kept, {}, len(self.params["hidden"])
        d = error[:, None]
        grads[f"w{k}"], grads[f"b{k}"] = h.T @ d, d.sum(0)
        d = d @ w[f"w{k}"].T
        for k in range(k - 1, -1, -1):
            h, z, mask = layers[k]
            d = d * mask * (z > 0)
            grads[f"w{k}"], grads[f"b{k}"] = h.T @ d, d.sum(0)
            d = d @ w[f"w{k}"].T
        return grads


class SequenceNetwork(Network):
    """A network over the ``window`` rows before each row. The first ``window`` rows of a series predict NULL."""

    def __init__(self, *, window: int = 24, **more):
        if window < 1:
            raise ConfigurationError(f"window must be positive, got {window}")
        super().__init__(window=window, **more)

    def _windows(self, df: DataFrame) -> DataFrame:
        n, axis = self.params["window"], self.params["axis"]
        if axis is None:
            raise ConfigurationError("sequences need an axis: rows have no order of their own")

        def build(w):
            cells = F.struct(F.array(*[number(df, c) for c in self.features_]).alias("x"))
            seen = F.collect_list(cells).over(w.rowsBetween(-n, -1))
            return {"__seq": F.when(F.size(seen) == n, F.transform(seen, lambda s: s["x"]))}

        return over_rows(df, axis, build, back=n)

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> SequenceNetwork:
        self.features_ = resolve(df, list(features))
        require_numeric(df, [*self.features_, target], type(self).__name__)
        self.target_ = target
        self.learn(self.params["axis"].sort(self._windows(df)).select("__seq", number(df, target).alias("__y")) if self.params["axis"] else self._windows(df))
        return self

    def learn(self, rows: DataFrame) -> None:
        got = self._collected(rows.where("__seq is not null and __y is not null"))
        x = np.array([[list(r) for r in s] for s in got["__seq"]], np.float64).reshape(len(got), self.params["window"], len(self.features_))
        known = ~np.isnan(x).any((1, 2))
        self.train(x[known], got["__y"].to_numpy(np.float64)[known])

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        if self.weights_ is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        rows = self._windows(df)
        made = self._scorer((self.params["window"], len(self.features_)))(F.col("__seq"))
        return rows.withColumn(name, made).withColumn(name, F.when(~F.isnan(name), F.col(name))).drop("__seq")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class LSTMRegressor(SequenceNetwork):
    """Long short-term memory (Hochreiter & Schmidhuber 1997); the last state goes through dropout to one output."""

    def __init__(self, *, hidden: int = 64, **more):
        super().__init__(hidden=hidden, **more)

    def start(self, m, rng):
        h = self.params["hidden"]
        bias = np.zeros(4 * h)
        bias[h : 2 * h] = 1.0  # remember at first
        return {"x": rng.normal(0, 1 / np.sqrt(m), (m, 4 * h)), "h": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), "b": bias, "o": rng.normal(0, 1 / np.sqrt(h), (h, 1)), "c": np.zeros(1)}

    def forward(self, w, x, rng=None):
        n, size = len(x), self.params["hidden"]
        h, c, kept = np.zeros((n, size)), np.zeros((n, size)), []
        for t in range(x.shape[1]):
            z = x[:, t] @ w["x"] + h @ w["h"] + w["b"]
            i, f, o = (_sigmoid(z[:, k * size : (k + 1) * size]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * size :])
            new = f * c + i * g
            kept.append((x[:, t], h, c, i, f, o, g, new))
            c, h = new, o * np.tanh(new)
        out, mask = self._drop(h, rng)
        return (out @ w["o"] + w["c"])[:, 0], (kept, out, mask)

    def backward(self, w, kept, error):
        steps, out, mask = kept
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["o"], grads["c"] = out.T @ error[:, None], error.sum(keepdims=True)
        dh, dc = (error[:, None] @ w["o"].T) * mask, 0.0
        for x, h, c, i, f, o, g, new in reversed(steps):
            squashed = np.tanh(new)
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)), 1)
            grads["x"] += x.T @ dz
            grads["h"] += h.T @ dz
            grads["b"] += dz.sum(0)
            dh, dc = dz @ w["h"].T, dc * f
        return grads


class CNNRegressor(SequenceNetwork):
    """One-dimensional convolutions over time with rectification, then the mean over time through dropout to one output."""

    def __init__(self, *, channels: Sequence[int] = (32, 32), kernel_size: int = 3, **more):
        if kernel_size < 1:
            raise ConfigurationError(f"kernel_size must be positive, got {kernel_size}")
        super().__init__(channels=tuple(channels), kernel_size=kernel_size, **more)

    def start(self, m, rng):
        sizes, k = [m, *self.params["channels"]], self.params["kernel_size"]
        out = {f"w{n}": rng.normal(0, np.sqrt(2 / (a * k)), (k * a, b)) for n, (a, b) in enumerate(zip(sizes, sizes[1:]))}
        out |= {f"b{n}": np.zeros(b) for n, b in enumerate(sizes[1:])}
        return out | {"o": rng.normal(0, 1 / np.sqrt(sizes[-1]), (sizes[-1], 1)), "c": np.zeros(1)}

    def _columns(self, h: np.ndarray) -> np.ndarray:
        """(n, time, kernel * channels): what each place sees, edges padded with zeros."""
        k = self.params["kernel_size"]
        padded = np.pad(h, ((0, 0), (k // 2, k // 2), (0, 0)))
        places = padded.shape[1] - k + 1
        return np.concatenate([padded[:, j : j + places] for j in range(k)], 2)

    def forward(self, w, x, rng=None):
        h, kept = x, []
        for n in range(len(self.params["channels"])):
            seen = self._columns(h)
            z = seen @ w[f"w{n}"] + w[f"b{n}"]
            kept.append((h.shape, seen, z))
            h = np.maximum(z, 0)
        pooled = h.mean(1)
        out, mask = self._drop(pooled, rng)
        return (out @ w["o"] + w["c"])[:, 0], (kept, h.shape, out, mask)

    def backward(self, w, kept, error):
        layers, shape, out, mask = kept
        k, grads = self.params["kernel_size"], {"o": out.T @ error[:, None], "c": error.sum(keepdims=True)}
        d = np.broadcast_to(((error[:, None] @ w["o"].T) * mask)[:, None] / shape[1], shape)
        for n in range(len(layers) - 1, -1, -1):
            before, seen, z = layers[n]
            d = d * (z > 0)
            grads[f"w{n}"] = np.einsum("nti,ntj->ij", seen, d)
            grads[f"b{n}"] = d.sum((0, 1))
            back = d @ w[f"w{n}"].T
            padded = np.zeros((before[0], before[1] + 2 * (k // 2), before[2]))
            for j in range(k):
                padded[:, j : j + back.shape[1]] += back[:, :, j * before[2] : (j + 1) * before[2]]
            d = padded[:, k // 2 : k // 2 + before[1]]
        return grads
