"""Calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, MissingDependencyError, SchemaError
from tidewater.core.step import Step, configurable
from tidewater.functions import calendar


def parsed_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that is none becomes NULL. Numbers are refused."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(f"`{name}`"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(f"`{name}`")
    raise SchemaError(f"{name!r} is {kind.simpleString()}, not a time")


@configurable
class TemporalFeatures(Step):
    """Append calendar fields, then sine and cosine of the cyclic ones.

    ``is_holiday`` needs ``holidays``: ISO dates (or ``holidays_country`` and the optional package of that name).
    ``drop_raw_cyclical`` leaves out fields that are also encoded; ``prefix`` goes before every new name.
    """

    selects = None

    def __init__(
        self, time_col: str | None = None, *, add: Sequence[str] = ("hour", "dayofweek", "month", "dayofyear", "is_weekend"),
        cyclical: Sequence[str] = ("hour", "dayofweek", "month", "dayofyear"), drop_raw_cyclical: bool = False,
        holidays_country: str | None = None, prefix: str = "", holidays: Sequence[str] | None = None,
    ):
        self.time_col, self.add, self.cyclical, self.drop_raw_cyclical = time_col, add, cyclical, drop_raw_cyclical
        self.holidays_country, self.prefix, self.holidays = holidays_country, prefix, holidays

    def validate(self) -> None:
        other = [f for f in self.add if f not in calendar.FIELDS and f != "is_holiday"]
        if other:
            raise ConfigurationError(f"unknown fields {other}; known: {sorted([*calendar.FIELDS, 'is_holiday'])}")
        other = [f for f in self.cyclical if f not in calendar.CYCLES]
        if other:
            raise ConfigurationError(f"fields without a period: {other}; known: {sorted(calendar.CYCLES)}")
        if "is_holiday" in self.add and self.holidays is None and not self.holidays_country:
            raise ConfigurationError("is_holiday needs holidays or holidays_country")

    def learn(self, df: DataFrame) -> None:
        if self.time_col is None:
            times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
            if len(times) != 1:
                raise SchemaError(f"time_col is needed: the frame has {len(times)} timestamp columns")
            self.time_ = times[0]
        elif self.time_col not in df.columns:
            raise ColumnNotFoundError(f"column {self.time_col!r} not found; available: {df.columns}")
        else:
            self.time_ = self.time_col
        time = parsed_time(df, self.time_)
        if isinstance(df.schema[self.time_].dataType, T.StringType) and not df.where(time.isNotNull()).limit(1).count() and df.limit(1).count():
            raise SchemaError(f"no value of {self.time_!r} is a time")
        self.holidays_ = list(self.holidays) if self.holidays is not None else []
        if "is_holiday" in self.add and self.holidays is None:
            try:
                import holidays
            except ImportError as why:
                raise MissingDependencyError("is_holiday by country needs the package 'holidays'; or pass holidays=") from why
            first, last = df.agg(F.min(F.year(time)), F.max(F.year(time))).first()
            years = range(first, last + 1) if first is not None else []
            self.holidays_ = sorted(str(d) for d in holidays.country_holidays(self.holidays_country, years=years))
        self.new_ = list(self._features(df))

    def _features(self, df: DataFrame) -> dict[str, Column]:
        time, out = parsed_time(df, self.time_), {}
        for f in self.add:
            if self.drop_raw_cyclical and f in self.cyclical:
                continue
            out[self.prefix + f] = calendar.on_dates(time, self.holidays_) if f == "is_holiday" else calendar.field(f, time)
        for f in self.cyclical:
            out[f"{self.prefix}{f}_sin"], out[f"{self.prefix}{f}_cos"] = calendar.cycle(f, time)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        new = self._features(df)
        return df.withColumns(new) if new else df

    def output_columns(self) -> list[str]:
        self.check_fitted()
        return self.input_columns_ + [c for c in self.new_ if c not in self.input_columns_]
