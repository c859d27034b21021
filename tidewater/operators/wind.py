"""Wind direction and speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.core.step import Step, configurable


@configurable
class WindDecomposer(Step):
    """Append ``<direction>_x`` (cosine) and ``<direction>_y`` (sine) of degrees, and speed from components u and v.

    New names must be free: a frame that already has ``speed_out`` is refused.
    """

    selects = None

    def __init__(
        self, direction_col: str | None = None, *, speed_from_uv: tuple[str, str] | None = None, speed_out: str = "wind_speed", drop_original: bool = False,
    ):
        self.direction_col, self.speed_from_uv, self.speed_out, self.drop_original = direction_col, speed_from_uv, speed_out, drop_original

    def validate(self) -> None:
        if self.direction_col is None and self.speed_from_uv is None:
            raise ConfigurationError("give direction_col, speed_from_uv or both")
        if self.speed_from_uv is not None and len(self.speed_from_uv) != 2:
            raise ConfigurationError(f"speed_from_uv is a pair of columns, got {self.speed_from_uv!r}")

    def learn(self, df: DataFrame) -> None:
        self.sources_ = list(dict.fromkeys([*([self.direction_col] if self.direction_col else []), *(self.speed_from_uv or ())]))
        absent = [c for c in self.sources_ if c not in df.columns]
        if absent:
            raise SchemaError(f"columns not found: {absent}; available: {df.columns}")
        self.dropped_columns_ = self.sources_ if self.drop_original else []
        self.new_ = list(self._features(df))
        taken = [c for c in self.new_ if c in df.columns and c not in self.dropped_columns_]
        if taken:
            raise SchemaError(f"the frame already has {taken}; choose other names")

    def _features(self, df: DataFrame) -> dict:
        out = {}
        if self.direction_col:
            angle = F.radians(number(df, self.direction_col))
            out |= {f"{self.direction_col}_x": F.cos(angle), f"{self.direction_col}_y": F.sin(angle)}
        if self.speed_from_uv:
            u, v = (number(df, c) for c in self.speed_from_uv)
            out[self.speed_out] = F.sqrt(u * u + v * v)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.dropped_columns_]
        return df.select(*kept, *[v.alias(n) for n, v in self._features(df).items()])

    def output_columns(self) -> list[str]:
        self.check_fitted()
        return [c for c in self.input_columns_ if c not in self.dropped_columns_] + self.new_
