"""Lags and causal rolling aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.core.axis import Axis, over_rows
from tidewater.core.columns import number, require_numeric, resolve, value
from tidewater.core.errors import ConfigurationError
from tidewater.core.step import Step, configurable

#: Aggregates that skip missing values. The median is an exact percentile, which a ROWS frame accepts.
AGGREGATES = {
    "median": lambda x: F.percentile(x, F.lit(0.5)), "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp,
}


def next_steps(df: DataFrame, column: str, axis: Axis, *, steps: int = 1, name: str | None = None) -> DataFrame:
    """Append ``<column>_next<steps>``: the value ``steps`` rows later along ``axis``, NULL at a series' end."""
    if not isinstance(steps, int) or isinstance(steps, bool) or steps < 1:
        raise ConfigurationError(f"steps is a positive integer, got {steps!r}")
    resolve(df, column)
    return over_rows(df, axis, lambda w: {name or f"{column}_next{steps}": F.lead(value(df, column), steps).over(w)}, ahead=steps)


@configurable
class LagFeatures(Step):
    """Append ``<c>_lag<k>`` (k rows earlier) and ``<c>_roll<w>_<agg>`` (over the w rows before this one).

    Rows, not times, are counted along ``axis``; missing values are skipped, a window of none gives NULL.
    """

    numeric_only = True

    def __init__(
        self, columns: str | Iterable[str] | None = None, *, lags: Sequence[int] = (), windows: Sequence[int] = (), agg: str = "median", axis: Axis | None = None,
    ):
        self.columns, self.lags, self.windows, self.agg, self.axis = columns, lags, windows, agg, axis

    def validate(self) -> None:
        if not self.lags and not self.windows:
            raise ConfigurationError("give lags, windows or both")
        other = [k for k in (*self.lags, *self.windows) if not isinstance(k, int) or isinstance(k, bool) or k < 1]
        if other:
            raise ConfigurationError(f"lags and windows are positive integers, got {other}")
        if self.agg not in AGGREGATES:
            raise ConfigurationError(f"unknown aggregate {self.agg!r}; known: {sorted(AGGREGATES)}")
        if self.axis is None:
            raise ConfigurationError("lags need an axis: rows have no order of their own")

    def learn(self, df: DataFrame) -> None:
        if self.columns is None:
            self.columns_ = [c for c in self.columns_ if c not in {self.axis.time, *self.axis.keys, self.axis.tie}]
        require_numeric(df, self.columns_, "LagFeatures")
        self.new_ = [n for c in self.columns_ for n in (*[f"{c}_lag{k}" for k in self.lags], *[f"{c}_roll{w}_{self.agg}" for w in self.windows])]

    def apply(self, df: DataFrame) -> DataFrame:
        def build(w) -> dict[str, Column]:
            out = {}
            for c in self.columns_:
                out |= {f"{c}_lag{k}": F.lag(value(df, c), k).over(w) for k in self.lags}
                out |= {f"{c}_roll{n}_{self.agg}": AGGREGATES[self.agg](number(df, c)).over(w.rowsBetween(-n, -1)) for n in self.windows}
            return out

        return over_rows(df, self.axis, build, back=max(*self.lags, *self.windows, 1, 1))

    def output_columns(self) -> list[str]:
        self.check_fitted()
        return self.input_columns_ + [c for c in self.new_ if c not in self.input_columns_]
