"""Cross-validation of regressors over chronological folds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.axis import Axis
from tidewater.core.errors import ConfigurationError
from tidewater.evaluation.metrics import METRICS, regression_metrics
from tidewater.evaluation.splits import Splitter


def cross_val_predict(model, df: DataFrame, *, axis: Axis, features: Sequence[str], target: str, cv: Splitter, clone: bool = True) -> DataFrame:
    """Test rows of every fold with ``fold`` and ``prediction``. Models are fitted on their fold's training rows only."""
    out = None
    for k, (train, test) in enumerate(cv.split(df, axis)):
        fitted = (model.copy() if clone else model).fit(train, list(features), target)
        part = fitted.predict(test, "prediction").withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ConfigurationError("the splitter gave no fold")
    return out


def fold_table(predicted: DataFrame, target: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """Metrics of each ``fold`` (as text), then rows ``mean`` and ``std`` (sample; one fold: NULL) over the folds."""
    names = list(METRICS if metrics is None else metrics)
    folds = regression_metrics(predicted, target, "prediction", metrics=names, by=["fold"])
    of = lambda label, f: folds.agg(*[f(m).alias(m) for m in names]).select(F.lit(label).alias("fold"), *names)
    return folds.select(F.col("fold").cast("string").alias("fold"), *names).unionByName(of("mean", F.avg)).unionByName(of("std", F.stddev_samp))


def cross_val_report(
    model, df: DataFrame, *, axis: Axis, features: Sequence[str], target: str, cv: Splitter, metrics: Iterable[str] | None = None, clone_estimator: bool = True,
) -> DataFrame:
    """One row per fold and the rows ``mean`` and ``std``. All folds are scored in one aggregate."""
    made = list(metrics) if metrics is not None else None
    return fold_table(cross_val_predict(model, df, axis=axis, features=features, target=target, cv=cv, clone=clone_estimator), target, made)
