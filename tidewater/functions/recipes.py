"""Small frame-to-frame pieces that studies put together by hand."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number, resolve
from tidewater.core.errors import ConfigurationError, SchemaError

#: Distinct values that a column may have to be spread into columns.
ONE_HOT_VALUES = 1_000


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, *, prefix: str | None = None) -> DataFrame:
    """Append ``<prefix>_<value>`` (1.0 or 0.0) per value; without ``values``, those of the column in order."""
    resolve(df, column)
    if values is None:
        found = df.select(column).distinct().where(F.col(column).isNotNull()).limit(ONE_HOT_VALUES + 1).collect()  # bounded
        if len(found) > ONE_HOT_VALUES:
            raise ConfigurationError(f"{column!r} has more than {ONE_HOT_VALUES} values")
        values = sorted(r[0] for r in found)
    same = lambda v: F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0))
    return df.withColumns({f"{prefix or column}_{v}": same(v) for v in values})


def exclude_between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value lies outside [low, high], or is unknown."""
    resolve(df, column)
    return df.where(~F.coalesce(F.col(column).between(F.lit(low), F.lit(high)), F.lit(False)))


def log_column(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Append (or replace by) the natural logarithm; NULL where the value is not positive."""
    x = number(df, column)
    return df.withColumn(name or column, F.when(x > 0, F.log(x)))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, missing ones NULL."""
    if not frames:
        raise SchemaError("there is no frame to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def align(actual: DataFrame, predicted: DataFrame, on: str | Sequence[str], column: str = "prediction") -> DataFrame:
    """The actual rows with the prediction for the same time (and keys); NULL where there is none."""
    keys = [on] if isinstance(on, str) else list(on)
    resolve(actual, keys)
    resolve(predicted, [*keys, column])
    return actual.join(predicted.select(*keys, column), keys, "left")


def residual(df: DataFrame, observed: str, predicted: str, name: str = "residual") -> DataFrame:
    """Append observed minus predicted (the bias metric has the opposite sign)."""
    return df.withColumn(name, number(df, observed) - number(df, predicted))
