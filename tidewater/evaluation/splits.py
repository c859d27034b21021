"""Chronological splits by position. A fold is four row numbers; rows are only ever filtered or joined to them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.core.axis import ROW, Axis, numbered
from tidewater.core.errors import ConfigurationError
from tidewater.core.shared import broadcast_if_small, scratch


class Fold(NamedTuple):
    """Train on rows [train_from, train_to), test on [test_from, test_to)."""

    train_from: int
    train_to: int
    test_from: int
    test_to: int


#: How a part's value is made, and how values of parts make that of the whole.
PARTS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}

#: Folds that one task runs through when training sets grow.
RUN_FOLDS = 10_000


def _aggregates(aggregates: dict[str, tuple[str, str]]) -> list[Column]:
    if unknown := sorted({how for how, _ in aggregates.values()} - set(PARTS)):
        raise ConfigurationError(f"unknown aggregates {unknown}; known: {sorted(PARTS)}")
    if taken := sorted({"fold", "role"} & set(aggregates)):
        raise ConfigurationError(f"names of the result's own columns: {taken}")
    return [PARTS[how][0]("*" if c == "*" else F.col(f"`{c}`")).alias(name) for name, (how, c) in aggregates.items()]


def _at_least(low: int, **sizes: int | None) -> None:
    for name, size in sizes.items():
        if size is not None and size < low:
            raise ConfigurationError(f"{name} must be at least {low}, got {size}")


class Splitter(ABC):
    @abstractmethod
    def folds(self, n: int) -> list[Fold]:
        """Folds of ``n`` rows; ConfigurationError if none fits."""

    def get_n_splits(self, df: DataFrame | int | None = None) -> int:
        if df is None:
            raise ConfigurationError("the number of folds depends on the number of rows: pass the frame or a count")
        return len(self.folds(df if isinstance(df, int) else df.count()))

    def split(self, df: DataFrame, axis: Axis) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(train, test) frames of each fold, in order."""
        rows = numbered(df, axis)
        for f in self.folds(df.count()):
            part = lambda a, b: rows.where((F.col(ROW) >= a) & (F.col(ROW) < b)).drop(ROW)
            yield part(f.train_from, f.train_to), part(f.test_from, f.test_to)

    def assign(self, df: DataFrame, axis: Axis) -> DataFrame:
        """Every row once for each fold it belongs to, with ``fold`` and ``role`` (train or test)."""
        folds = self.folds(df.count())
        parts = [(k, "train", f.train_from, f.train_to) for k, f in enumerate(folds)] + [(k, "test", f.test_from, f.test_to) for k, f in enumerate(folds)]
        table = df.sparkSession.createDataFrame(parts, "fold int, role string, __from bigint, __to bigint")
        inside = (F.col(ROW) >= F.col("__from")) & (F.col(ROW) < F.col("__to"))
        return numbered(df, axis).join(broadcast_if_small(table), inside).drop("__from", "__to", ROW)  # two rows a fold


    def summary(self, df: DataFrame, axis: Axis, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
        """``fold``, ``role`` and aggregates of the rows of each, by name: (count, sum, min or max; column)."""
        made = _aggregates(aggregates)
        return self.assign(df, axis).groupBy("fold", "role").agg(*made)


class BlockingTimeSeriesSplit(Splitter):
    """Equal consecutive blocks, the last one taking the remainder; in each, an early half trains and the rest tests."""

    def __init__(self, n_splits: int = 5, gap: int = 0):
        _at_least(2, n_splits=n_splits)
        _at_least(0, gap=gap)
        self.n_splits, self.gap = n_splits, gap

    def folds(self, n: int) -> list[Fold]:
        size = n // self.n_splits
        if self.n_splits > n or size < 2:
            raise ConfigurationError(f"{n} rows are too few for {self.n_splits} blocks of at least 2")
        out = []
        for k in range(self.n_splits):
            low, high = k * size, n if k == self.n_splits - 1 else (k + 1) * size
            middle = low + (high - low - self.gap) // 2
            if middle <= low or middle + self.gap >= high:
                raise ConfigurationError(f"a gap of {self.gap} leaves nothing of a block of {high - low}")
            out.append(Fold(low, middle, middle + self.gap, high))
        return out

    def get_n_splits(self, df: DataFrame | int | None = None) -> int:
        return self.n_splits


class _Rolling(Splitter):
    """Folds whose test window moves on by ``step`` while it fits."""

    def __init__(self, train: int, test_size: int, step: int | None, gap: int, grows: bool):
        _at_least(1, test_size=test_size, step=step)
        _at_least(0, gap=gap)
        self._train, self.test_size, self.step, self.gap, self._grows = train, test_size, step, gap, grows

    def assign(self, df: DataFrame, axis: Axis) -> DataFrame:
        """As every splitter's, but a row's folds follow from its number: there may be as many folds as rows."""
        return self._placed(df, axis)

    def summary(self, df: DataFrame, axis: Axis, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
        """As every splitter's. Where training sets grow, a row counts in the first that holds it and sums run on from there:
        rows times folds would grow with the square of the rows."""
        made = _aggregates(aggregates)
        if not self._grows:
            return super().summary(df, axis, aggregates)
        parts = self._placed(df, axis, first_only=True).groupBy("fold", "role").agg(*made)
        parts = scratch(parts.withColumn("__run", F.floor(F.col("fold") / RUN_FOLDS)), "folds")
        train = parts.where("role = 'train'")
        to = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run of folds
        whole = {name: PARTS[how][1] for name, (how, _) in aggregates.items()}
        runs = train.groupBy("__run").agg(*[f(f"`{name}`").alias(name) for name, f in whole.items()])
        before = runs.select(F.col("__run").alias("__r"), *[f(f"`{name}`").over(to).alias(f"__{k}") for k, (name, f) in enumerate(whole.items())])
        within = Window.partitionBy("__run").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
        joined = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
        grown = train.join(before, F.col("__run") == F.col("__r")).select(
            "fold", "role",
            *[joined[aggregates[name][0]](f(f"`{name}`").over(within), F.col(f"__{k}")).alias(name) for k, (name, f) in enumerate(whole.items())],
        )
        return grown.unionByName(parts.where("role = 'test'").drop("__run"))

    def _placed(self, df: DataFrame, axis: Axis, *, first_only: bool = False) -> DataFrame:
        """Rows with their folds; ``first_only``: of the folds that train on a row, the first."""
        n, step = df.count(), self.step or self.test_size
        last = (n - self._train - self.gap - self.test_size) // step
        if last < 0:
            raise ConfigurationError(f"no fold fits into {n} rows")
        row, ahead = F.col(ROW), self._train + self.gap
        up = lambda x: F.greatest(F.lit(0), F.ceil(x / float(step)))
        down = lambda x: F.least(F.lit(last), F.floor(x / float(step)))
        first_train, last_train = up(row - self._train + 1), F.lit(last) if self._grows else down(row)
        if first_only:
            last_train = F.least(first_train, last_train)
        spans = {"train": (first_train, last_train), "test": (up(row - ahead - self.test_size + 1), down(row - ahead))}
        folds = lambda a, b: F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))
        parts = [F.transform(folds(a, b), lambda k: F.struct(k.alias("fold"), F.lit(role).alias("role"))) for role, (a, b) in spans.items()]  # noqa: B023
        return numbered(df, axis).select("*", F.inline(F.concat(*parts))).drop(ROW)

    def folds(self, n: int) -> list[Fold]:
        out, move = [], 0
        while (end := move + self._train + self.gap + self.test_size) <= n:
            out.append(Fold(0 if self._grows else move, move + self._train, end - self.test_size, end))
            move += self.step or self.test_size
        if not out:
            raise ConfigurationError(f"no fold fits into {n} rows")
        return out


class SlidingWindowSplit(_Rolling):
    """A training window of fixed size that moves on with the test window."""

    def __init__(self, train_size: int, test_size: int, *, step: int | None = None, gap: int = 0):
        _at_least(1, train_size=train_size)
        super().__init__(train_size, test_size, step, gap, grows=False)
        self.train_size = train_size


class ExpandingWindowSplit(_Rolling):
    """A training window that begins at the first row and grows."""

    def __init__(self, initial_train_size: int, test_size: int, *, step: int | None = None, gap: int = 0):
        _at_least(1, initial_train_size=initial_train_size)
        super().__init__(initial_train_size, test_size, step, gap, grows=True)
        self.initial_train_size = initial_train_size


class TimeSeriesSplit(Splitter):
    """Growing training set; each of ``n_splits`` test sets has n // (n_splits + 1) rows, at the end of the series."""

    def __init__(self, n_splits: int = 5, *, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0):
        _at_least(2, n_splits=n_splits)
        _at_least(1, max_train_size=max_train_size, test_size=test_size)
        _at_least(0, gap=gap)
        self.n_splits, self.max_train_size, self.test_size, self.gap = n_splits, max_train_size, test_size, gap

    def folds(self, n: int) -> list[Fold]:
        size = self.test_size or n // (self.n_splits + 1)
        starts = [n - (self.n_splits - k) * size for k in range(self.n_splits)]
        if size < 1 or starts[0] - self.gap < 1:
            raise ConfigurationError(f"{n} rows are too few for {self.n_splits} splits")
        first = lambda end: max(0, end - self.max_train_size) if self.max_train_size else 0
        return [Fold(first(s - self.gap), s - self.gap, s, s + size) for s in starts]

    def get_n_splits(self, df: DataFrame | int | None = None) -> int:
        return self.n_splits


def holdout(n: int, test_size: float | int = 0.2, gap: int = 0) -> Fold:
    """One fold: the last rows test (a share, rounded half to even, or a count); the gap comes off the training end."""
    _at_least(0, gap=gap)
    if isinstance(test_size, float) and not 0 < test_size < 1:
        raise ConfigurationError(f"test_size as a share must be in (0, 1), got {test_size}")
    last = round(test_size * n) if isinstance(test_size, float) else int(test_size)
    if not 0 < last < n:
        raise ConfigurationError(f"a test set of {last} does not fit into {n} rows")
    if n - last - gap < 1:
        raise ConfigurationError("nothing is left to train on; reduce test_size or gap")
    return Fold(0, n - last - gap, n - last, n)


def temporal_train_test_split(df: DataFrame, axis: Axis, *, test_size: float | int = 0.2, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) in time order, without shuffling."""
    f = holdout(df.count(), test_size, gap)
    rows = numbered(df, axis)
    return rows.where(F.col(ROW) < f.train_to).drop(ROW), rows.where(F.col(ROW) >= f.test_from).drop(ROW)
