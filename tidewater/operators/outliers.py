"""Outliers: bounds from the data, and what to do with cells beyond them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.core.axis import Axis, over_rows
from tidewater.core.columns import number, require_numeric
from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.core.step import Step, configurable
from tidewater.functions.quantiles import quantile_values

METHODS = ("iqr", "zscore", "modified_zscore", "quantile", "rolling_sigma", "isolation_forest")
TREATMENTS = ("clip", "drop", "nan", "flag")

#: Scales the median absolute deviation to a standard deviation under normality.
NORMAL_MAD = 0.6745


def bounds(
    df: DataFrame, columns: list[str], method: str, *, iqr_factor: float = 1.5, z_threshold: float = 3.0, mad_threshold: float = 3.5,
    shares: tuple[float, float] = (0.01, 0.99), approx: bool = False,
) -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper bound per column; None where a column has too few values."""
    if not columns:
        return {}
    x = {c: number(df, c) for c in columns}
    if method == "zscore":
        row = df.agg(*[F.array(F.avg(v), F.stddev_samp(v)).alias(f"b{k}") for k, v in enumerate(x.values())]).first()
        middle = [(m, None if s is None else z_threshold * s) for m, s in row]
    elif method == "modified_zscore":
        row = [q and q[0] for q in quantile_values(df, list(x.values()), [0.5], approx=approx)]
        away = [F.abs(v - F.lit(m).cast("double")) for v, m in zip(x.values(), row)]
        spread = [q and q[0] for q in quantile_values(df, away, [0.5], approx=approx)]
        middle = [(m, None if d is None else mad_threshold * d / NORMAL_MAD) for m, d in zip(row, spread)]
    else:
        two = [0.25, 0.75] if method == "iqr" else list(shares)
        row = quantile_values(df, list(x.values()), two, approx=approx)
        if method == "quantile":
            return {c: tuple(b) if b else (None, None) for c, b in zip(columns, row)}
        reach = [b and iqr_factor * (b[1] - b[0]) for b in row]
        return {c: (b[0] - r, b[1] + r) if b else (None, None) for c, b, r in zip(columns, row, reach)}
    return {c: (m - r, m + r) if m is not None and r is not None else (None, None) for c, (m, r) in zip(columns, middle)}


def beyond(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Whether a value lies outside; missing values and missing bounds never do."""
    under = x < (low if isinstance(low, Column) else F.lit(low).cast("double"))
    over = x > (high if isinstance(high, Column) else F.lit(high).cast("double"))
    return F.coalesce(under, F.lit(False)) | F.coalesce(over, F.lit(False))


def rolling_bounds(df: DataFrame, axis: Axis, columns: list[str], window: int, sigma: float) -> DataFrame:
    """Append ``__low_<c>`` and ``__high_<c>``: centred mean -+ ``sigma`` standard deviations over ``window`` rows."""
    back, ahead = window // 2, (window - 1) // 2

    def build(w):
        frame = w.rowsBetween(-back, ahead)
        out = {}
        for c in columns:
            x = number(df, c)
            reach = sigma * F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0))
            out |= {f"__low_{c}": F.avg(x).over(frame) - reach, f"__high_{c}": F.avg(x).over(frame) + reach}
        return out

    return over_rows(df, axis, build, back=back, ahead=ahead)


@configurable
class OutlierHandler(Step):
    """Find outlying cells and clip them, drop their rows, blank them, or flag their rows (``is_outlier``).

    ``iqr``, ``zscore`` (sample deviation), ``modified_zscore`` and ``quantile`` learn bounds; ``rolling_sigma``
    works along ``axis`` and learns nothing; ``isolation_forest`` scores rows (no clipping).
    """

    numeric_only = True

    def __init__(
        self, columns: str | Iterable[str] | None = None, method: str = "iqr", strategy: str = "clip", *, iqr_factor: float = 1.5,
        z_threshold: float = 3.0, mad_threshold: float = 3.5, window: int = 72, sigma: float = 4.0,
        quantiles: tuple[float, float] = (0.01, 0.99), contamination: str | float = "auto", random_state: int | None = None,
        axis: Axis | None = None, approx: bool = False,
    ):
        self.columns, self.method, self.strategy, self.iqr_factor, self.z_threshold = columns, method, strategy, iqr_factor, z_threshold
        self.mad_threshold, self.window, self.sigma, self.quantiles = mad_threshold, window, sigma, quantiles
        self.contamination, self.random_state, self.axis, self.approx = contamination, random_state, axis, approx

    def validate(self) -> None:
        if self.method not in METHODS:
            raise ConfigurationError(f"unknown method {self.method!r}; known: {sorted(METHODS)}")
        if self.strategy not in TREATMENTS:
            raise ConfigurationError(f"unknown strategy {self.strategy!r}; known: {sorted(TREATMENTS)}")
        if self.method == "isolation_forest" and self.strategy == "clip":
            raise ConfigurationError("isolation_forest gives no bounds to clip to")
        low, high = self.quantiles
        if not 0 <= low < high <= 1:
            raise ConfigurationError(f"quantiles must satisfy 0 <= low < high <= 1, got {self.quantiles}")
        if self.method == "rolling_sigma" and self.axis is None:
            raise ConfigurationError("rolling_sigma needs an axis: rows have no order of their own")
        if self.method == "rolling_sigma" and self.window < 1:
            raise ConfigurationError(f"window must be positive, got {self.window}")

    def learn(self, df: DataFrame) -> None:
        skip = {self.axis.time, *self.axis.keys, self.axis.tie} if self.axis and self.columns is None else set()
        self.columns_ = [c for c in self.columns_ if c not in skip]
        require_numeric(df, self.columns_, "OutlierHandler")
        self.bounds_, self.forest_ = {}, None
        if self.method == "isolation_forest":
            from tidewater.models.isolation import IsolationForest

            if not self.columns_:
                raise SchemaError("isolation_forest needs a numeric column")
            self.forest_ = IsolationForest(self.columns_, contamination=self.contamination, seed=self.random_state or 0).fit(df)
        elif self.method != "rolling_sigma":
            self.bounds_ = bounds(
                df, self.columns_, self.method, iqr_factor=self.iqr_factor, z_threshold=self.z_threshold,
                mad_threshold=self.mad_threshold, shares=self.quantiles, approx=self.approx,
            )
        self._learnt_from, self._counted = df, None

    def _counts(self) -> tuple[int, int]:
        """Outlying rows and all rows of the frame that was learnt from; counted when first asked for."""
        self.check_fitted()
        if self._counted is None:
            row = self._flagged(self._learnt_from).agg(F.sum(F.col("__any").cast("long")), F.count("*")).first()
            self._counted = (row[0] or 0, row[1])
        return self._counted

    @property
    def n_outliers_(self) -> int:
        return self._counts()[0]

    @property
    def outlier_fraction_(self) -> float:
        found, rows = self._counts()
        return found / rows if rows else 0.0

    def _limits(self, c: str) -> tuple[Column, Column]:
        if self.method == "rolling_sigma":
            return F.col(f"__low_{c}"), F.col(f"__high_{c}")
        return tuple(F.lit(b).cast("double") for b in self.bounds_[c])

    def _flagged(self, df: DataFrame) -> DataFrame:
        """With ``__out_<c>`` per column and ``__any``."""
        if self.forest_ is not None:
            out = self.forest_.flag(df, "__any")
            return out.withColumns({f"__out_{c}": F.col("__any") for c in self.columns_})
        out = rolling_bounds(df, self.axis, self.columns_, self.window, self.sigma) if self.method == "rolling_sigma" else df
        flags = {f"__out_{c}": beyond(number(df, c), *self._limits(c)) for c in self.columns_}
        out = out.withColumns(flags) if flags else out
        return out.withColumn("__any", reduce(or_, [F.col(f) for f in flags], F.lit(False)))

    def apply(self, df: DataFrame) -> DataFrame:
        out = self._flagged(df)
        if self.strategy == "drop":
            return out.where(~F.col("__any")).select(*df.columns)
        if self.strategy == "flag":
            kept = [c for c in df.columns if c != "is_outlier"]
            return out.select(*kept, F.col("__any").cast("int").alias("is_outlier"))
        if self.strategy == "nan":
            new = {c: F.when(~F.col(f"__out_{c}"), F.col(f"`{c}`")) for c in self.columns_}
        else:
            def clipped(c: str) -> Column:
                x, (low, high) = number(df, c), self._limits(c)
                return F.when(x < low, low).when(x > high, high).otherwise(x)

            new = {c: clipped(c) for c in self.columns_}
        return (out.withColumns(new) if new else out).select(*df.columns)

    def output_columns(self) -> list[str]:
        self.check_fitted()
        names = [c for c in self.input_columns_ if c != "is_outlier"] if self.strategy == "flag" else self.input_columns_
        return [*names, "is_outlier"] if self.strategy == "flag" else list(names)
