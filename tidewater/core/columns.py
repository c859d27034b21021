"""Column selection, type checks and the null convention (NaN is missing, and missing is NULL)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.core.errors import ColumnNotFoundError, SchemaError


def check_frame(df: object) -> DataFrame:
    """``df`` if it is a Spark frame with at least one column. Zero rows are fine."""
    if not hasattr(df, "schema") or not hasattr(df, "withColumns"):
        raise SchemaError(f"expected a Spark DataFrame, got {type(df).__name__}")
    if not df.columns:
        raise SchemaError("the frame has no columns")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numeric type, in order. Booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def resolve(df: DataFrame, selection: str | Iterable[str] | None, *, numeric_only: bool = False) -> list[str]:
    """Selected columns in order, without repeats. ``numeric_only`` narrows the default, not a selection."""
    if selection is None:
        return numeric_columns(df) if numeric_only else list(df.columns)
    wanted = [selection] if isinstance(selection, str) else list(selection)
    if any(not isinstance(c, str) for c in wanted):
        raise SchemaError("column names are strings")
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ColumnNotFoundError(f"columns not found: {missing}; available: {df.columns}")
    return list(dict.fromkeys(wanted))


def require_numeric(df: DataFrame, columns: Sequence[str], who: str) -> None:
    known = set(numeric_columns(df))
    other = [c for c in columns if c not in known]
    if other:
        raise SchemaError(f"{who} needs numeric columns; these are not: {other}")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL where its type can hold NaN."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), None).otherwise(col)
    return col


def number(df: DataFrame, name: str) -> Column:
    """The column as double, NaN as NULL."""
    return value(df, name).cast("double")


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN becomes NULL in every floating-point column given (default: all)."""
    names = list(columns) if columns is not None else df.columns
    floating = [c for c in names if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: value(df, c) for c in floating}) if floating else df


def is_missing(df: DataFrame, name: str) -> Column:
    return value(df, name).isNull()
