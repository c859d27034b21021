"""Additive forecasting: piecewise linear trend and Fourier seasons by penalised least squares.

The model family of Taylor & Letham (2018), fitted from cross products in one distributed pass; intervals
are quantiles of the residuals. Numbers differ from sampling-based fits of that family.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError, NotFittedError, SchemaError
from tidewater.models.gram import gram, ridge
from tidewater.models.registry import Regressor, make_regressor

#: Season -> (period in days, Fourier order, days of history from which "auto" switches it on, if rows are closer
#: together than the period).
SEASONS = {"yearly": (365.25, 10, 730), "weekly": (7.0, 3, 14), "daily": (1.0, 4, 2)}
FORECAST, COMPONENTS = ("yhat", "yhat_lower", "yhat_upper"), ("trend", "weekly", "yearly", "daily")


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a time without zone, as double."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time.cast("timestamp_ntz")).cast("double") / 1e6


def step_of(freq: str) -> dt.timedelta:
    """Length of a frequency such as h, 3h, 30min, D or W."""
    units = {"s": 1, "min": 60, "t": 60, "h": 3600, "d": 86400, "w": 604800}
    found = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq.strip())
    if not found or found[2].lower() not in units:
        raise ConfigurationError(f"unknown frequency {freq!r}; known units: {sorted(units)}")
    return dt.timedelta(seconds=int(found[1] or 1) * units[found[2].lower()])


class ProphetForecaster:
    """``fit`` a frame of ``ds`` and ``y``; ``predict`` gives ``ds, yhat, yhat_lower, yhat_upper``.

    Seasonalities are "auto", a switch or a Fourier order. ``growth``: linear (with changepoints), flat, or logistic
    towards ``cap`` (fitted on the log odds of y/cap).
    """

    def __init__(
        self, *, growth: str = "linear", yearly_seasonality: Any = "auto", weekly_seasonality: Any = "auto", daily_seasonality: Any = "auto",
        n_changepoints: int = 25, changepoint_range: float = 0.8, changepoint_prior_scale: float = 0.05, seasonality_prior_scale: float = 10.0,
        interval_width: float = 0.8, cap: float | None = None,
    ):
        if growth not in ("linear", "flat", "logistic") or growth == "logistic" and cap is None:
            raise ConfigurationError(f"growth is linear, flat, or logistic with a cap; got {growth!r}")
        if not 0 < interval_width < 1:
            raise ConfigurationError(f"interval_width must be in (0, 1), got {interval_width}")
        self.growth, self.cap, self.interval_width = growth, cap, interval_width
        self.seasonality = {"yearly": yearly_seasonality, "weekly": weekly_seasonality, "daily": daily_seasonality}
        self.n_changepoints, self.changepoint_range = n_changepoints, changepoint_range
        self.changepoint_prior_scale, self.seasonality_prior_scale = changepoint_prior_scale, seasonality_prior_scale
        self.weights_: dict[str, float] | None = None

    def fit(self, df: DataFrame, *, ds: str = "ds", y: str = "y") -> ProphetForecaster:
        missing = [c for c in (ds, y) if c not in df.columns]
        if missing:
            raise SchemaError(f"columns not found: {missing}; available: {df.columns}")
        rows = df.select(self._time(df, ds).alias("ds"), F.expr(f"try_cast(`{y}` as double)").alias("y"))
        rows = rows.withColumn("y", number(rows, "y")).na.drop()
        first, last, n, low, high = rows.agg(F.min(seconds(F.col("ds"))), F.max(seconds(F.col("ds"))), F.count("*"), F.avg("y"), F.max(F.abs("y"))).first()
        if not n:
            raise SchemaError("no row has both a time and a value")
        self.first_, self.last_, self.span_, self.scale_ = first, last, max(last - first, 1.0), high or 1.0
        days = (last - first) / 86400
        self.orders_ = {}
        for name, (period, order, history) in SEASONS.items():
            asked, seen = self.seasonality[name], days >= history and days / max(n - 1, 1) < period
            order = (order if seen else 0) if asked == "auto" else order if asked is True else int(asked or 0)
            if order:
                self.orders_[name] = order
        bends = min(self.n_changepoints, max(n - 2, 0)) if self.growth == "linear" else 0
        self.bends_ = [self.changepoint_range * (k + 1) / (bends + 1) for k in range(bends)]
        terms = self._terms(F.col("ds"))
        target = F.col("y") / self.scale_ if self.growth != "logistic" else F.log(self._odds(F.col("y")))
        g = gram(rows.select(*[v.alias(k) for k, v in terms.items()], target.alias("__y")))
        soft = {"bend": 1 / self.changepoint_prior_scale**2, "slope": 1 / 25.0}
        penalty = [0.0025 * soft.get(k.split("_")[0], 1 / self.seasonality_prior_scale**2) for k in terms]
        self.intercept_, w = ridge(g, list(range(1, len(terms) + 1)), len(terms) + 1, np.array(penalty)) if terms else (g[0, 1] / g[0, 0], [])
        self.weights_ = dict(zip(terms, map(float, w)))
        made = rows.withColumn("__r", F.col("y") - self._parts(F.col("ds"))["yhat"])
        tail = (1 - self.interval_width) / 2
        self.reach_ = made.agg(F.percentile("__r", F.array(F.lit(tail), F.lit(1 - tail)))).first()[0]
        self.history_ = rows.select("ds")
        return self

    @staticmethod
    def _time(df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return F.try_to_timestamp(F.col(f"`{name}`")).cast("timestamp_ntz")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.col(f"`{name}`").cast("timestamp_ntz")
        raise SchemaError(f"{name!r} is {kind.simpleString()}, not a time")

    def _odds(self, y: Column) -> Column:
        share = F.greatest(F.least(y / float(self.cap), F.lit(0.999)), F.lit(0.001))
        return share / (1 - share)

    def _terms(self, time: Column) -> dict[str, Column]:
        t = (seconds(time) - F.lit(self.first_)) / F.lit(self.span_)
        out = {"slope": t} if self.growth != "flat" else {}
        out |= {f"bend_{k}": F.greatest(t - F.lit(b), F.lit(0.0)) for k, b in enumerate(self.bends_)}
        for name, order in self.orders_.items():
            angle = F.lit(2 * math.pi / SEASONS[name][0] / 86400) * seconds(time)
            for k in range(1, order + 1):
                out |= {f"{name}_sin{k}": F.sin(angle * k), f"{name}_cos{k}": F.cos(angle * k)}
        return out

    def _parts(self, time: Column) -> dict[str, Column]:
        """Components and ``yhat`` as expressions of a time."""
        terms = self._terms(time)
        total = lambda names: sum((terms[k] * F.lit(self.weights_[k]) for k in names), F.lit(0.0))
        trend = F.lit(float(self.intercept_)) + total([k for k in terms if k.split("_")[0] in ("slope", "bend")])
        seasons = {n: total([k for k in terms if k.startswith(f"{n}_")]) for n in self.orders_}
        raw = sum(seasons.values(), trend)
        if self.growth == "logistic":
            squash = lambda x: float(self.cap) / (1 + F.exp(-x))
            return {"trend": squash(trend), **seasons, "yhat": squash(raw)}
        return {"trend": trend * self.scale_, **{n: s * self.scale_ for n, s in seasons.items()}, "yhat": raw * self.scale_}

    def features(self, df: DataFrame, ds: str = "ds", *, components: bool = False) -> DataFrame:
        """Append the forecast columns (and components) for the times of ``df``: plain expressions, no join."""
        if self.weights_ is None:
            raise NotFittedError("the forecaster is not fitted")
        # Components become columns before they are summed: each is worked out once, not once for every use.
        parts = self._parts(self._time(df, ds))
        whole = parts.pop("yhat")
        whole = whole if self.growth == "logistic" else None
        own = {n: f"__part_{n}" for n in parts}
        out = df.withColumns({own[n]: parts[n] for n in own} | ({"__part_yhat": whole} if whole is not None else {}))
        yhat = F.col("__part_yhat") if whole is not None else sum((F.col(c) for c in own.values()), F.lit(0.0))
        new = {"yhat": yhat, "yhat_lower": yhat + self.reach_[0], "yhat_upper": yhat + self.reach_[1]}
        if components:
            new |= {c: F.col(own[c]) for c in COMPONENTS if c in own}
        return out.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in new.items()}).drop(*own.values(), "__part_yhat")

    def predict(self, periods: int | None = None, freq: str = "h", future: DataFrame | Sequence | None = None) -> DataFrame:
        """For the training times, for those and ``periods`` more of ``freq``, or for ``future`` times."""
        if self.weights_ is None:
            raise NotFittedError("the forecaster is not fitted")
        spark = self.history_.sparkSession
        if future is not None:
            if not hasattr(future, "schema"):
                future = spark.createDataFrame([(str(x),) for x in future], "ds string")
            if "ds" not in future.columns:
                raise SchemaError(f"future needs a column ds; it has {future.columns}")
            times = future.select(self._time(future, "ds").alias("ds"))
        else:
            times = self.history_
            if periods is not None:
                step = step_of(freq).total_seconds()
                more = spark.range(1, int(periods) + 1).select((F.lit(self.last_) + F.col("id") * step).alias("s"))
                times = times.unionByName(more.select(F.timestamp_add("MICROSECOND", (F.col("s") * 1e6).cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("ds")))
        return self.features(times).select("ds", *FORECAST)


class ProphetFeatures:
    """Forecast columns (and components) of a target, learned from the frame that holds it."""

    def __init__(self, target: str, *, time: str = "ds", prophet_kwargs: dict | None = None, add_components: bool = True):
        self.target, self.time, self.prophet_kwargs, self.add_components = target, time, prophet_kwargs, add_components
        self.forecaster_: ProphetForecaster | None = None

    def fit(self, df: DataFrame) -> ProphetFeatures:
        missing = [c for c in (self.target, self.time) if c not in df.columns]
        if missing:
            raise ConfigurationError(f"columns not found: {missing}; available: {df.columns}")
        self.forecaster_ = ProphetForecaster(**(self.prophet_kwargs or {})).fit(df, ds=self.time, y=self.target)
        made = {*FORECAST, "trend", *self.forecaster_.orders_}
        self.prophet_feature_names_ = [c for c in (*FORECAST, *(COMPONENTS if self.add_components else ())) if c in made]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.forecaster_ is None:
            raise NotFittedError("the features are not fitted")
        return self.forecaster_.features(df, self.time, components=self.add_components)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class HybridProphetRegressor(Regressor):
    """A regressor over its features and the in-sample forecast columns of the target (default: a forest of 400)."""

    def __init__(self, base_estimator: Regressor | None = None, *, time: str = "ds", prophet_kwargs: dict | None = None, add_components: bool = True):
        super().__init__(base_estimator=base_estimator, time=time, prophet_kwargs=prophet_kwargs, add_components=add_components)

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> HybridProphetRegressor:
        time = self.params["time"]
        if time not in df.columns:
            raise ConfigurationError(f"a time column {time!r} is needed; available: {df.columns}")
        if df.where(ProphetForecaster._time(df, time).isNull()).limit(1).count():
            raise ConfigurationError(f"{time!r} has missing or unparseable times")
        self.features_ = [f for f in features if f != time]
        self.prophet_ = ProphetFeatures(target, time=time, prophet_kwargs=self.params["prophet_kwargs"], add_components=self.params["add_components"]).fit(df)
        base = self.params["base_estimator"] or make_regressor("random_forest", numTrees=400)
        rows = self.prophet_.transform(df).persist()  # a regressor passes over them several times
        self.regressor_ = base.copy().fit(rows, [*self.features_, *self.prophet_.prophet_feature_names_], target)
        rows.unpersist()
        return self

    def learn(self, rows: DataFrame) -> None:
        raise NotImplementedError("fit does it all")

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        new = self.prophet_.prophet_feature_names_
        out = self.regressor_.predict(self.prophet_.transform(df.drop(*new)), name)
        return out.drop(*[c for c in (*FORECAST, *COMPONENTS) if c not in df.columns])

    def importances(self) -> dict[str, float]:
        return self.regressor_.importances()
