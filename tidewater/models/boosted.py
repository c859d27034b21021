"""Gradient boosting by the optional package xgboost."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.columns import number
from tidewater.models.registry import Regressor


class XgboostRegressor(Regressor):
    """The package's own Spark estimator."""

    def __init__(self, **params: Any):
        super().__init__(**{"random_state": 0, **params})

    def learn(self, rows: DataFrame) -> None:
        from xgboost.spark import SparkXGBRegressor

        self.model_ = SparkXGBRegressor(features_col=self.features_, label_col="__y", prediction_col="__p", **self.params).fit(rows)

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        known = F.lit(True)
        for c in self.features_:
            known = known & number(df, c).isNotNull()
        return self.model_.transform(df).withColumn(name, F.when(known, F.col("__p"))).drop("__p")
