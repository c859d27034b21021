"""Streaming counterparts. Fitted steps whose transform is a row expression run unchanged on a stream; what looks
back keeps a small state per series; what looks ahead is refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.core.columns import check_frame
from tidewater.core.errors import ConfigurationError
from tidewater.core.step import Pipeline, Step


def _looks_around(step: Step) -> bool:
    from tidewater.operators import LagFeatures, MissingValueHandler, OutlierHandler

    if isinstance(step, MissingValueHandler):
        return step.strategy in ("ffill", "bfill", "interpolate")
    if isinstance(step, OutlierHandler):
        return step.method == "rolling_sigma"
    return isinstance(step, LagFeatures)


def transform_stream(stream: DataFrame, steps: Step | Pipeline) -> DataFrame:
    """Apply fitted steps to a stream. Steps that need neighbouring rows are refused: see ``causal_features`` and
    ``carried_forward``."""
    chain = [s for _, s in steps.steps] if isinstance(steps, Pipeline) else [steps]
    for s in chain:
        if _looks_around(s):
            raise ConfigurationError(f"{s!r} needs neighbouring rows, which a stream does not hold")
    out = check_frame(stream)
    for s in chain:
        out = s.transform(out)
    return out


def windowed_means(stream: DataFrame, time: str, values: Sequence[str], *, keys: Sequence[str] = (), width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means per series and event-time window; rows later than ``late`` are left out."""
    t = F.window(time, width, slide) if slide else F.window(time, width)
    if stream.schema[time].dataType.typeName() == "timestamp_ntz":  # a watermark needs an instant
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    made = stream.withWatermark(time, late).groupBy(t, *keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values])
    return made.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", *[f"{v}_mean" for v in values])


_AGGREGATES = {"median": np.nanmedian, "mean": np.nanmean, "min": np.nanmin, "max": np.nanmax, "std": lambda x: np.nanstd(x, ddof=1)}


def causal_features(
    stream: DataFrame, key: str, time: str, value: str, *, lags: Sequence[int] = (), windows: Sequence[int] = (), agg: str = "median",
) -> DataFrame:
    """Lags and rolling aggregates of one value per series, from the last rows kept as state.

    Rows of a batch are put in time order; a row earlier than one of a batch before is taken as it comes. State
    is the last max(lags, windows) values of a series.
    """
    if not lags and not windows:
        raise ConfigurationError("give lags, windows or both")
    if agg not in _AGGREGATES:
        raise ConfigurationError(f"unknown aggregate {agg!r}; known: {sorted(_AGGREGATES)}")
    depth = max(*lags, *windows, 1, 1)
    names = [f"{value}_lag{k}" for k in lags] + [f"{value}_roll{w}_{agg}" for w in windows]
    kinds = stream.schema
    schema = f"{key} {kinds[key].dataType.simpleString()}, {time} {kinds[time].dataType.simpleString()}, {value} double, " + ", ".join(f"{n} double" for n in names)

    def rows(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        got = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v in zip(got[time], got[value].astype(float)):
            made = [past[-n] if n <= len(past) else None for n in lags]
            for n in windows:
                seen = np.array([np.nan if x is None else x for x in past[-n:]], float)
                known = seen[~np.isnan(seen)]
                enough = len(known) > (1 if agg == "std" else 0)
                made.append(float(_AGGREGATES[agg](known)) if enough else None)
            out.append((k[0], t, v, *made))
            past = [*past, None if np.isnan(v) else float(v)][-depth:]
        state.update((past,))
        yield pd.DataFrame(out, columns=[key, time, value, *names])

    picked = stream.select(key, time, F.col(value).cast("double").alias(value))
    return picked.groupBy(key).applyInPandasWithState(rows, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def carried_forward(stream: DataFrame, key: str, time: str, value: str, *, limit: int | None = None) -> DataFrame:
    """The value with gaps filled from the last known one of the series, at most ``limit`` in a row."""
    kinds = stream.schema
    schema = f"{key} {kinds[key].dataType.simpleString()}, {time} {kinds[time].dataType.simpleString()}, {value} double"

    def rows(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        got = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v in zip(got[time], got[value].astype(float)):
            run = run + 1 if np.isnan(v) else 0
            last = last if np.isnan(v) else float(v)
            kept = last if run and (limit is None or run <= limit) else None if run else float(v)
            out.append((k[0], t, kept))
        state.update((last, run))
        yield pd.DataFrame(out, columns=[key, time, value])

    picked = stream.select(key, time, F.col(value).cast("double").alias(value))
    return picked.groupBy(key).applyInPandasWithState(rows, schema, "last double, run int", "append", GroupStateTimeout.NoTimeout)
