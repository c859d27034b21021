"""Regression metrics in one pass over (observed, predicted) pairs, after one small pre-pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import check_frame, number, resolve
from tidewater.core.errors import ConfigurationError, SchemaError
from tidewater.functions.stats import average_rank, global_ranks

#: Names in order.
METRICS = (
    "mae", "mse", "rmse", "r2", "mape", "smape", "wape", "nmae", "nrmse", "bias", "pearson_r", "spearman_r",
    "index_of_agreement", "fac2",
)


def pairs(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``o``, ``p`` and the group columns of rows where both are known (NaN is not)."""
    rows = df.select(*by, number(df, observed).alias("o"), number(df, predicted).alias("p"))
    return rows.where(F.col("o").isNotNull() & F.col("p").isNotNull())


def _pearson(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def expressions() -> dict[str, Column]:
    """Aggregates over o, p, their average ranks ro, rp, and the group's mean ``__m`` and quartiles ``__q``."""
    o, p, m = F.col("o"), F.col("p"), F.col("__m")
    e = p - o
    iqr = F.first(F.col("__q")[1] - F.col("__q")[0])
    squares = F.sum(e * e)
    reach = F.abs(p - m) + F.abs(o - m)
    half_to_double = F.when(o != 0, F.try_divide(p, o).between(0.5, 2.0).cast("double"))
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1.0 - F.try_divide(squares, F.sum((o - m) * (o - m))),
        "mape": 100.0 * F.avg(F.abs(F.try_divide(e, o))),
        "smape": 100.0 * F.avg(F.coalesce(F.try_divide(2.0 * F.abs(e), F.abs(p) + F.abs(o)), F.lit(0.0))),
        "wape": F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(o))),
        "nmae": F.try_divide(F.avg(F.abs(e)), iqr),
        "nrmse": F.try_divide(F.sqrt(F.avg(e * e)), iqr),
        "bias": F.avg(e),
        "pearson_r": _pearson(o, p),
        "spearman_r": _pearson(F.col("ro"), F.col("rp")),
        "index_of_agreement": 1.0 - F.try_divide(squares, F.sum(reach * reach)),
        "fac2": F.avg(half_to_double),
    }


def regression_metrics(
    df: DataFrame, observed: str, predicted: str, *, metrics: Sequence[str] | None = None, by: Sequence[str] = (), distributed: bool = True,
) -> DataFrame:
    """One row of metrics, or one per group of ``by``. Undefined metrics (constant observations...) are NULL.

    Groups without a known pair have no row; without ``by``, no pair gives no row. Without ``by``, Spearman's
    ranks come from range partitions; ``distributed=False`` asks for one window, which is less work where rows are few.
    """
    names = list(METRICS if metrics is None else metrics)
    other = [m for m in names if m not in METRICS]
    if other:
        raise ConfigurationError(f"unknown metrics {other}; known: {list(METRICS)}")
    check_frame(df)
    by = resolve(df, list(by))
    rows = pairs(df, observed, predicted, by)
    if "spearman_r" in names:
        if distributed and not by:
            rows = global_ranks(global_ranks(rows, "o", "ro"), "p", "rp")
        else:
            rows = rows.withColumns({"ro": average_rank(F.col("o"), by), "rp": average_rank(F.col("p"), by)})
    made = expressions()
    wanted = [made[m].alias(m) for m in names]
    ahead = [F.avg("o").alias("__m")]
    if {"nmae", "nrmse"} & set(names):
        ahead.append(F.percentile("o", F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    base = pairs(df, observed, predicted, by)
    if not by:
        one = base.agg(*ahead)
        return rows.crossJoin(F.broadcast(one)).groupBy(F.lit(1).alias("__all")).agg(*wanted).drop("__all")  # one row
    groups = base.groupBy(*[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)]).agg(*ahead)
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    return rows.join(groups, same).groupBy(*by).agg(*wanted)


def score(df: DataFrame, observed: str, predicted: str, *, metrics: Sequence[str] | None = None) -> dict[str, float | None]:
    """Metrics as a dict; no known pair is a SchemaError."""
    row = regression_metrics(df, observed, predicted, metrics=metrics).first()
    if row is None:
        raise SchemaError("no row has both an observation and a prediction")
    return row.asDict()
