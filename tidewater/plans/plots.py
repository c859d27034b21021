"""The data behind each plot, as frames. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import is_missing, number, numeric_columns, resolve
from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.evaluation.metrics import regression_metrics
from tidewater.functions import calendar
from tidewater.functions.stats import correlation_table
from tidewater.functions.quantiles import quantile_values


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = [c for c in resolve(df, list(columns) if columns is not None else None) if c in numeric_columns(df)]
    if not names:
        raise SchemaError("there is no numeric column to plot")
    return names


def missingness(df: DataFrame, columns: Sequence[str] | None = None, *, kind: str = "bar", keep: Sequence[str] = ()) -> DataFrame:
    """``bar``: ``column, fraction`` from least to most missing; ``matrix``: every cell as missing or not.

    ``keep`` names columns that stay beside the matrix as they are.
    """
    names = resolve(df, list(columns) if columns is not None else None)
    if kind == "matrix":
        return df.select(*keep, *[is_missing(df, c).alias(c) for c in names])
    if kind != "bar":
        raise ConfigurationError(f"kind is 'bar' or 'matrix', not {kind!r}")
    row = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(f"f{k}") for k, c in enumerate(names)])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{k}").alias("fraction")) for k, c in enumerate(names)])
    return row.select(F.inline(parts)).orderBy("fraction", "column")


def distributions(df: DataFrame, columns: Sequence[str] | None = None, *, bins: int = 40) -> DataFrame:
    """Histogram of each numeric column: ``column, bin, low, high, n``. Empty bins have no row; a constant column has one bin."""
    if bins < 1:
        raise ConfigurationError(f"bins must be positive, got {bins}")
    names = _numeric(df, columns)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("x")) for c in names]))).where("x is not null")
    ends = long.groupBy(F.col("column").alias("__c")).agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    width = F.try_divide(F.col("__b") - F.col("__a"), F.lit(float(bins)))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("__a"), width)), F.lit(0)), F.lit(bins - 1))
    placed = long.join(F.broadcast(ends), F.col("column") == F.col("__c")).select("column", place.cast("int").alias("bin"), "__a", width.alias("__w"))  # one row a column
    counted = placed.groupBy("column", "bin", "__a", "__w").agg(F.count("*").alias("n"))
    low = F.col("__a") + F.col("bin") * F.col("__w")
    return counted.select("column", "bin", low.alias("low"), (low + F.col("__w")).alias("high"), "n")


def density(df: DataFrame, column: str, *, points: int = 200, bins: int = 2000) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) at evenly spaced points, from a fine histogram."""
    hist = distributions(df, [column], bins=bins).toPandas()  # at most ``bins`` rows
    stats = df.agg(F.stddev_samp(number(df, column)), F.count(number(df, column)), F.min(number(df, column)), F.max(number(df, column))).first()
    if not stats[1]:
        raise SchemaError(f"{column!r} has no known value")
    middle, n = ((hist["low"] + hist["high"]) / 2).to_numpy(), hist["n"].to_numpy(float)
    width = (stats[0] or 1.0) * stats[1] ** -0.2
    at = np.linspace(stats[2] - 3 * width, stats[3] + 3 * width, points)
    y = (np.exp(-0.5 * ((at[:, None] - middle) / width) ** 2) * n).sum(1) / (n.sum() * width * np.sqrt(2 * np.pi))
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(at, y)], "x double, density double")


def correlation(df: DataFrame, columns: Sequence[str] | None = None, *, method: str = "pearson", cluster: bool = False) -> DataFrame:
    """``a, b, r`` of every pair. With ``cluster``, columns that correlate stand together (average linkage)."""
    names = _numeric(df, columns)
    table = correlation_table(df, names, method)
    if not cluster:
        return table
    r = {(x.a, x.b): x.r or 0.0 for x in table.collect()}  # one row for each pair of columns
    far = lambda a, b: 1 - abs(r.get((a, b), r.get((b, a), 0.0)))
    groups = [[c] for c in names]
    while len(groups) > 1:
        _, i, j = min((float(np.mean([far(a, b) for a in x for b in y])), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return correlation_table(df, groups[0], method)


def timeseries(df: DataFrame, time: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Time and numeric columns, in time order."""
    names = [c for c in _numeric(df, columns) if c != time]
    return df.select(time, *names).orderBy(F.col(time).asc_nulls_last())


def five_numbers(x) -> list:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.min(x).alias("low"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("high"), F.count(x).alias("n")]


def seasonality(df: DataFrame, time: str, column: str, *, by: str = "hour") -> DataFrame:
    """Five numbers of a column per hour, weekday or month."""
    if by not in ("hour", "dayofweek", "month"):
        raise ConfigurationError(f"by is hour, dayofweek or month, not {by!r}")
    return df.groupBy(calendar.field(by, F.col(time)).alias(by)).agg(*five_numbers(number(df, column))).orderBy(by)


def boxplots(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: quartiles, and the ends of whiskers within 1.5 interquartile ranges."""
    names = _numeric(df, columns)
    cells = df.select(*[number(df, c).alias(f"x{k}") for k, c in enumerate(names)])
    quarters = [q or [None] * 3 for q in quantile_values(cells, [F.col(c) for c in cells.columns], [0.25, 0.5, 0.75])]
    q = [[F.lit(v).cast("double") for v in three] for three in quarters]

    def ends(k: int) -> list:
        x, reach = F.col(f"x{k}"), 1.5 * (q[k][2] - q[k][0])
        inside = F.when(x.between(q[k][0] - reach, q[k][2] + reach), x)
        return [F.min(x).alias(f"a{k}"), F.max(x).alias(f"z{k}"), F.count(x).alias(f"n{k}"), F.min(inside).alias(f"low{k}"), F.max(inside).alias(f"high{k}")]

    whole = cells.agg(*[a for k in range(len(names)) for a in ends(k)])
    rows = [F.struct(
        F.lit(c).alias("column"), F.col(f"a{k}").alias("low"), q[k][0].alias("q1"), q[k][1].alias("median"), q[k][2].alias("q3"), F.col(f"z{k}").alias("high"),
        F.col(f"n{k}").alias("n"), F.col(f"low{k}").alias("whisker_low"), F.col(f"high{k}").alias("whisker_high"),
    ) for k, c in enumerate(names)]
    return whole.select(F.inline(F.array(*rows))).orderBy("column")


def outliers(df: DataFrame, column: str, *, bounds=None, handler=None, time: str | None = None) -> DataFrame:
    """Rows of a column with ``is_out``. Given bounds (a pair, or a dict of lower/upper or low/high) win over a handler's;
    one side may be open, and bounds that are not finite are open."""
    if bounds is None:
        if handler is None or column not in getattr(handler, "bounds_", {}):
            raise ConfigurationError("give bounds, or a fitted handler that has bounds for the column")
        bounds = handler.bounds_[column]
    if isinstance(bounds, dict):
        bounds = (bounds.get("lower", bounds.get("low")), bounds.get("upper", bounds.get("high")))
    low, high = (None if b is None or not np.isfinite(b) else float(b) for b in bounds)
    x, out = number(df, column), F.lit(False)
    if low is not None:
        out = out | (x < low)
    if high is not None:
        out = out | (x > high)
    kept = [time] if time else []
    return df.select(*kept, x.alias(column), F.coalesce(out, F.lit(False)).alias("is_out"))


def predictions(df: DataFrame, observed: str, predicted: str, *, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (in time order if given), and a row with r2."""
    kept = df.select(*([time] if time else []), number(df, observed).alias("observed"), number(df, predicted).alias("predicted"))
    return kept.orderBy(time) if time else kept, regression_metrics(df, observed, predicted, metrics=["r2"])


def residuals(df: DataFrame, observed: str, predicted: str, *, bins: int = 40) -> tuple[DataFrame, DataFrame]:
    """Observed minus predicted against predicted, and the residuals' histogram."""
    rows = df.select(number(df, predicted).alias("predicted"), (number(df, observed) - number(df, predicted)).alias("residual"))
    return rows, distributions(rows, ["residual"], bins=bins)
