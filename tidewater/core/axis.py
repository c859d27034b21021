"""The time axis: Spark rows have no order, so every ordered operation is told one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidewater.core.columns import value
from tidewater.core.errors import ColumnNotFoundError, ConfigurationError
from tidewater.core.shared import broadcast_if_small, scratch


#: Rows to a block of a series without keys, unless the axis says otherwise.
BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Axis:
    """Order of rows: ``time`` within each series (``keys``), ties broken by ``tie``.

    Without keys there is one series, and one window over it would be one task. It is split into blocks of
    ``block_rows`` rows (0: ``BLOCK_ROWS``) instead, which carry copies of their neighbours' border rows and run in
    parallel; None asks for the one window, which is less work where the series is known to be short. With keys a
    series is one task each, unless ``block_rows`` names a number: then long series are split, too.
    """

    time: str
    keys: tuple[str, ...] = ()
    tie: str | None = None
    block_rows: int | None = 0

    @property
    def blocks(self) -> int | None:
        """Rows to a block, or None for plain windows."""
        return None if self.block_rows is None or self.keys and not self.block_rows else self.block_rows or BLOCK_ROWS

    def check(self, df: DataFrame) -> Axis:
        missing = [c for c in (self.time, *self.keys, *([self.tie] if self.tie else [])) if c not in df.columns]
        if missing:
            raise ColumnNotFoundError(f"axis columns not found: {missing}; available: {df.columns}")
        if self.block_rows and self.block_rows < 0:
            raise ConfigurationError("block_rows is a number of rows")
        return self

    def order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in (self.time, self.tie) if c]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order())

    def sort(self, df: DataFrame) -> DataFrame:
        """Rows in order, unknown times last."""
        self.check(df)
        return df.orderBy(*[F.col(k) for k in self.keys], *self.order())


ROW, BLOCK = "__row", "__block"


def numbered(df: DataFrame, axis: Axis) -> DataFrame:
    """Append ``__row``: the position from 0 within each series.

    With blocks the position is found without one global window: rows are range-partitioned, sorted and stored once in the
    shared folder, and each partition's offset is the number of rows before it. Ranges come from a sample, so what
    is stored, not what a lost executor would sample again, says which row is where.
    """
    axis.check(df)
    if axis.blocks is None:
        return df.withColumn(ROW, (F.row_number().over(axis.window()) - 1).cast("bigint"))
    order = [*[F.col(f"`{k}`") for k in axis.keys], *axis.order()]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("__at", F.monotonically_increasing_id())
    ordered = scratch(ordered, "rows")
    part = F.shiftright("__at", 33)
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())  # one number for each partition
    before, offset = 0, []
    for p in sorted(counts):
        offset += [F.lit(p), F.lit(before)]
        before += counts[p]
    start = F.create_map(*offset)[part] if offset else F.lit(0)
    within = F.col("__at") - F.shiftleft(part, 33)
    placed = ordered.withColumn(ROW, (start + within).cast("bigint")).drop("__at")
    if not axis.keys:
        return placed
    # Series follow each other: a row's place in its own is counted from where that begins.
    begins = placed.groupBy(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(axis.keys)]).agg(F.min(ROW).alias("__begin"))
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(axis.keys)])
    begun = placed.join(broadcast_if_small(begins), same)
    return begun.withColumn(ROW, F.col(ROW) - F.col("__begin")).drop("__begin", *[f"__k{n}" for n in range(len(axis.keys))])


def over_rows(
    df: DataFrame, axis: Axis, build: Callable[[WindowSpec], dict[str, Column]], *, back: int = 0, ahead: int = 0,
) -> DataFrame:
    """Append the columns that ``build`` makes from an ordered window.

    ``back`` and ``ahead`` say how many rows before and after the current one the frames reach; in blocks those
    rows are copied from the neighbours and dropped again.
    """
    axis.check(df)
    if axis.blocks is None:
        return df.withColumns(build(axis.window()))
    size = axis.blocks
    reach = lambda n: range(1, -(-n // size) + 1)  # noqa: E731  blocks that n rows span
    rows = numbered(df, axis).withColumn(BLOCK, F.floor(F.col(ROW) / size))
    place = F.col(ROW) - F.col(BLOCK) * size
    homes = [F.col(BLOCK)]
    homes += [F.when(place >= k * size - back, F.col(BLOCK) + k) for k in reach(back)]
    homes += [F.when(place < ahead - (k - 1) * size, F.col(BLOCK) - k) for k in reach(ahead)]
    spread = rows.withColumn("__home", F.explode(F.array_compact(F.array(*homes))))
    out = spread.withColumns(build(Window.partitionBy(*axis.keys, "__home").orderBy(ROW)))
    return out.where(F.col("__home") == F.col(BLOCK)).drop("__home", BLOCK, ROW)


def _both_ways(keys: Iterable[str], order: str, end: int = 0) -> tuple[WindowSpec, WindowSpec]:
    """Frames from a series' first row to the current one and, in descending order, from its last. A frame that ends at
    the last row of an ascending window would be gone through anew for each row, with the square of the rows."""
    w = Window.partitionBy(*keys)
    return tuple(w.orderBy(o).rowsBetween(Window.unboundedPreceding, end) for o in (F.asc(order), F.desc(order)))


def known_neighbours(df: DataFrame, axis: Axis, columns: list[str]) -> DataFrame:
    """Append ``__row`` and, per column, ``__prev_<c>`` and ``__next_<c>``: structs (t, v, row) of the nearest known
    values at or before and at or after each row. ``t`` is the time in microseconds, or the row for a non-time axis.
    """
    kind = df.schema[axis.time].dataType
    rows = numbered(df, axis)
    if isinstance(kind, T.TimestampType):
        t = F.unix_micros(axis.time)
    elif isinstance(kind, (T.TimestampNTZType, T.DateType)):
        t = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{axis.time}` AS TIMESTAMP_NTZ))")
    else:
        t = F.col(ROW)
    known = {c: F.when(value(df, c).isNotNull(), F.struct(t.alias("t"), value(df, c).alias("v"), F.col(ROW).alias("row"))) for c in columns}
    if axis.blocks is None:
        to, since = _both_ways(axis.keys, ROW)
        return rows.withColumns(
            {f"__prev_{c}": F.last(k, ignorenulls=True).over(to) for c, k in known.items()}
            | {f"__next_{c}": F.last(k, ignorenulls=True).over(since) for c, k in known.items()}
        )
    rows = rows.withColumn(BLOCK, F.floor(F.col(ROW) / axis.blocks))
    names = [f"__k{n}" for n in range(len(axis.keys))]
    ends = rows.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(axis.keys, names)], BLOCK).agg(
        *[F.max_by(k, F.when(k.isNotNull(), F.col(ROW))).alias(f"__last_{c}") for c, k in known.items()],
        *[F.min_by(k, F.when(k.isNotNull(), F.col(ROW))).alias(f"__first_{c}") for c, k in known.items()],
    )
    before, after = _both_ways(names, BLOCK, -1)  # one row per block
    carried = ends.select(
        *names, F.col(BLOCK).alias("__b"),
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__before_{c}") for c in columns],
        *[F.last(f"__first_{c}", ignorenulls=True).over(after).alias(f"__after_{c}") for c in columns],
    )
    to, since = _both_ways((*axis.keys, BLOCK), ROW)
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(axis.keys, names)], F.col(BLOCK) == F.col("__b"))
    out = rows.join(carried, same).withColumns(
        {f"__prev_{c}": F.coalesce(F.last(k, ignorenulls=True).over(to), F.col(f"__before_{c}")) for c, k in known.items()}
        | {f"__next_{c}": F.coalesce(F.last(k, ignorenulls=True).over(since), F.col(f"__after_{c}")) for c, k in known.items()}
    )
    return out.drop(BLOCK, "__b", *names, *[f"__before_{c}" for c in columns], *[f"__after_{c}" for c in columns])
