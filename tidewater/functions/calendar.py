"""Calendar fields of a time column."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field -> expression. Weeks begin on Monday (0); seasons are 1 (December to February) to 4.
FIELDS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
    "dayofyear": F.dayofyear,
    "weekofyear": F.weekofyear,
    "hour": F.hour,
    "minute": F.minute,
    "is_weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    "is_month_start": lambda t: (F.dayofmonth(t) == 1).cast("int"),
    "is_month_end": lambda t: (F.to_date(t) == F.last_day(t)).cast("int"),
    "season": lambda t: F.floor((F.month(t) % 12 + 3) / 3).cast("int"),
}

#: First value and period of each cyclic field.
CYCLES = {
    "hour": (0, 24), "minute": (0, 60), "dayofweek": (0, 7), "month": (1, 12), "quarter": (1, 4),
    "dayofyear": (1, 365.25), "weekofyear": (1, 52.1775), "day": (1, 31),
}


def field(name: str, time: Column) -> Column:
    return FIELDS[name](time).cast("int")


def cycle(name: str, time: Column) -> tuple[Column, Column]:
    """Sine and cosine of a field's place in its period."""
    first, period = CYCLES[name]
    angle = F.lit(2.0 * math.pi) * (field(name, time) - F.lit(first)) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def on_dates(time: Column, dates: list[str]) -> Column:
    """1 where the date of ``time`` is among ISO ``dates``; the list is small (a holiday calendar)."""
    return F.coalesce(F.to_date(time).isin([F.lit(d).cast("date") for d in dates]) if dates else F.lit(False), F.lit(False)).cast("int")
