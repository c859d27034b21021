"""Scaling to a common range."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number, require_numeric
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError
from tidewater.core.step import Step, configurable
from tidewater.functions.quantiles import quantile_values

METHODS = ("standard", "minmax", "robust", "maxabs")


@configurable
class Scaler(Step):
    """(x - centre) / scale per column; a scale of 0 counts as 1.

    ``standard``: mean and population deviation; ``minmax``: least value and range; ``robust``: median and
    interquartile range; ``maxabs``: 0 and the largest absolute value.
    """

    numeric_only = True

    def __init__(self, columns: str | Iterable[str] | None = None, method: str = "standard", *, approx: bool = False):
        self.columns, self.method, self.approx = columns, method, approx

    def validate(self) -> None:
        if self.method not in METHODS:
            raise ConfigurationError(f"unknown method {self.method!r}; known: {sorted(METHODS)}")

    def learn(self, df: DataFrame) -> None:
        require_numeric(df, self.columns_, "Scaler")
        self.centre_, self.scale_ = {}, {}
        if not self.columns_:
            return
        of = {
            "standard": lambda x: F.array(F.avg(x), F.stddev_pop(x)),
            "minmax": lambda x: F.array(F.min(x), F.max(x) - F.min(x)),
            "maxabs": lambda x: F.array(F.lit(0.0), F.max(F.abs(x))),
        }
        cells = [number(df, c) for c in self.columns_]
        if self.method == "robust":
            row = quantile_values(df, cells, [0.25, 0.5, 0.75], approx=self.approx)
        else:
            row = df.agg(*[of[self.method](x).alias(f"s{k}") for k, x in enumerate(cells)]).first()
        for c, got in zip(self.columns_, row):
            got = got or [None, None, None]
            centre, scale = (got[1], got[2] - got[0] if got[2] is not None else None) if self.method == "robust" else got[:2]
            self.centre_[c], self.scale_[c] = centre or 0.0, scale or 1.0

    def apply(self, df: DataFrame) -> DataFrame:
        new = {c: (number(df, c) - F.lit(self.centre_[c])) / F.lit(self.scale_[c]) for c in self._present(df)}
        return df.withColumns(new) if new else df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted()
        new = {c: number(df, c) * F.lit(self.scale_[c]) + F.lit(self.centre_[c]) for c in self._present(df)}
        return df.withColumns(new) if new else df

    def _present(self, df: DataFrame) -> list[str]:
        absent = [c for c in self.columns_ if c not in df.columns]
        if absent:
            raise ColumnNotFoundError(f"fitted columns not found: {absent}; available: {df.columns}")
        return self.columns_
