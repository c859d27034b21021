"""Removal of collinear columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidewater.core.columns import require_numeric
from tidewater.core.errors import ConfigurationError
from tidewater.core.step import Step, configurable
from tidewater.functions.stats import correlations


@configurable
class CorrelationFilter(Step):
    """Go through the columns in order and drop one that correlates with any kept before it beyond ``threshold``.

    Protected columns always stay and count as kept. Undefined correlations drop nothing.
    """

    numeric_only = True

    def __init__(self, threshold: float = 0.9, *, columns: str | Iterable[str] | None = None, protect: str | Iterable[str] | None = None):
        self.threshold, self.columns, self.protect = threshold, columns, protect

    def validate(self) -> None:
        if not 0 < self.threshold <= 1:
            raise ConfigurationError(f"threshold must be in (0, 1], got {self.threshold}")

    def learn(self, df: DataFrame) -> None:
        require_numeric(df, self.columns_, "CorrelationFilter")
        self.correlations_ = correlations(df, self.columns_)
        safe = {self.protect} if isinstance(self.protect, str) else set(self.protect or ())
        kept: list[str] = []
        for c in self.columns_:
            tied = any(abs(self.correlations_[k, c] or 0.0) > self.threshold for k in kept)
            if c in safe or not tied:
                kept.append(c)
        self.dropped_columns_ = [c for c in self.columns_ if c not in kept]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped_columns_)

    def output_columns(self) -> list[str]:
        self.check_fitted()
        return [c for c in self.input_columns_ if c not in self.dropped_columns_]
