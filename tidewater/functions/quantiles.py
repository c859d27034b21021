"""Exact quantiles without a task that holds all values.

A quantile is one or two order statistics. A sketch brackets them, exact counts say how many values lie below and inside the
bracket, and brackets are narrowed until few values are left, which are looked at. All columns and shares go through the
same passes; each pass is one aggregate.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches, and values of a bracket that are few enough to be looked at.
ACCURACY, FEW = 10_000, 10_000

FINITE = sys.float_info.max


@dataclass
class _Target:
    """Order statistics ``first`` and ``last`` (from 0) of a column; they lie in [low, high], with ``below`` values
    under it and ``inside`` in it."""

    column: int
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def settled(self) -> bool:
        return self.low == self.high or self.inside <= FEW

    def within(self, x: Column) -> Column:
        return x.between(F.lit(self.low), F.lit(self.high))


def quantile_values(df: DataFrame, columns: list[Column], shares: list[float], *, approx: bool = False) -> list[list[float] | None]:
    """Quantiles of each column (double, NULL for missing) by linear interpolation; None for a column without values.

    ``approx`` takes them from one sketch instead.
    """
    rows = df.select(*[c.alias(f"x{k}") for k, c in enumerate(columns)])
    x = [F.col(f"x{k}") for k in range(len(columns))]
    if approx:
        got = rows.agg(*[F.percentile_approx(c, shares, ACCURACY) for c in x]).first()
        return [list(g) if g is not None else None for g in got]
    sizes = rows.agg(*[F.struct(F.count(c), F.min(c), F.max(c)) for c in x]).first()
    targets = []
    for k, (n, low, high) in enumerate(sizes):
        for s in shares if n else ():
            at = s * (n - 1)
            targets.append(_Target(k, math.floor(at), math.ceil(at), low, high, 0, n))
    while unsettled := [t for t in targets if not t.settled]:
        _narrow(rows, x, unsettled)
    found = _looked_at(rows, x, targets)
    values = iter(zip(targets, found))
    out: list[list[float] | None] = []
    for n, _, _ in sizes:
        out.append([_between(*next(values), s * (n - 1)) for s in shares] if n else None)
    return out


def _between(target: _Target, ends: tuple[float, float], at: float) -> float:
    """Linear interpolation between two order statistics."""
    (a, b), part = ends, at - target.first
    return a if part == 0 or a == b else (1 - part) * a + part * b


def _narrow(rows: DataFrame, x: list[Column], targets: list[_Target]) -> None:
    """Smaller brackets around the same order statistics."""
    reach = 2 / ACCURACY
    asked = []
    for t in targets:
        ends = [(t.first - t.below) / t.inside - reach, (t.last - t.below + 1) / t.inside + reach]
        asked.append(F.percentile_approx(F.when(t.within(x[t.column]), x[t.column]), [min(1.0, max(0.0, e)) for e in ends], ACCURACY))
    ends = rows.agg(*asked).first()
    counts = []
    for t, (low, high) in zip(targets, ends):
        v = F.when(t.within(x[t.column]), x[t.column])
        counts.append(F.struct(F.count(F.when(v < F.lit(low), 1)), F.count(F.when(v.between(F.lit(low), F.lit(high)), 1))))
    for t, (low, high), (under, inside) in zip(targets, ends, rows.agg(*counts).first()):
        ahead, kept = t.first - t.below, t.last - t.below
        if under <= ahead and kept < under + inside and inside < t.inside:
            t.low, t.high, t.below, t.inside = low, high, t.below + under, inside
        else:  # the sketch missed, or narrows no more: halve the range of values instead
            _halve(rows, x, t)


def _halve(rows: DataFrame, x: list[Column], t: _Target) -> None:
    """The bracket from its least value to the middle, or beyond; both where the order statistics lie on both sides."""
    middle, c = max(t.low, -FINITE) / 2 + min(t.high, FINITE) / 2, x[t.column]
    if not t.low <= middle < t.high:  # infinite ends, or neighbouring numbers
        middle = t.low
    v = F.when(t.within(c), c)
    n, top, bottom = rows.agg(F.count(F.when(v <= F.lit(middle), 1)), F.max(F.when(v <= F.lit(middle), v)), F.min(F.when(v > F.lit(middle), v))).first()
    if t.last - t.below < n:
        t.high, t.inside = top, n
    elif t.first - t.below >= n:
        t.low, t.below, t.inside = bottom, t.below + n, t.inside - n
    else:
        a, b = top, bottom  # the two are neighbours, one on each side
        inside = rows.agg(F.count(F.when(c == F.lit(a), 1)), F.count(F.when(c == F.lit(b), 1))).first()
        t.low, t.high, t.below, t.inside = a, b, t.below + n - inside[0], 0
        t.inside = min(FEW, sum(inside))  # two different values, whatever their number


def _looked_at(rows: DataFrame, x: list[Column], targets: list[_Target]) -> list[tuple[float, float]]:
    """The order statistics of settled targets: few values of each are fetched, with their numbers."""
    open_ = [(k, t) for k, t in enumerate(targets) if t.low != t.high]
    values: dict[int, list[tuple[float, int]]] = {}
    if open_:
        cells = [F.when(t.within(x[t.column]), F.struct(F.lit(k).alias("target"), x[t.column].alias("value"))) for k, t in open_]
        long = rows.select(F.inline(F.array_compact(F.array(*cells))))
        for r in long.groupBy("target", "value").agg(F.count("*").alias("n")).collect():  # at most FEW values a target
            values.setdefault(r.target, []).append((r.value, r.n))
    out = []
    for k, t in enumerate(targets):
        if t.low == t.high:
            out.append((t.low, t.low))
            continue
        upto, ends = t.below, []
        for v, n in sorted(values[k]):
            ends += [v] * sum(upto <= p < upto + n for p in (t.first, t.last))
            upto += n
        out.append((ends[0], ends[1]))
    return out
