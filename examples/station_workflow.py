"""A study from raw rows to scores: clean, add features, validate chronologically, forecast, apportion sources.

Run from the repository: ``python examples/station_workflow.py [days]``.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewater.core.axis import Axis
from tidewater.core.step import Pipeline
from tidewater.evaluation import BlockingTimeSeriesSplit, cross_val_report
from tidewater.functions.recipes import exclude_between, log_column, one_hot
from tidewater.models import NMFApportionment, ProphetForecaster, make_regressor, permutation_importance_report
from tidewater.operators import CorrelationFilter, LagFeatures, MissingValueHandler, OutlierHandler, TemporalFeatures, WindDecomposer
from tidewater.sources.synthetic import PROFILES, daily_particles, hourly_stations


def main(days: int = 60) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    axis = Axis("ts", keys=("station",))
    raw = hourly_stations(spark, n_days=days)
    clean = Pipeline([
        MissingValueHandler(["no2", "o3"], "interpolate", limit=3, axis=axis),
        OutlierHandler(["pm10"], "rolling_sigma", axis=axis),
        TemporalFeatures("ts"),
        WindDecomposer("wind_dir", drop_original=True),
        LagFeatures(["no2"], lags=[1], windows=[12], axis=axis),
        CorrelationFilter(0.95, protect=["no2"]),
        MissingValueHandler(strategy="drop"),
    ]).fit_transform(raw).persist()
    centre = clean.where("station = 'Centre'").drop("station")
    features = [c for c in centre.columns if c not in ("ts", "no2")]
    report = cross_val_report(make_regressor("random_forest", numTrees=50), centre, axis=Axis("ts"), features=features, target="no2", cv=BlockingTimeSeriesSplit(3, gap=24), metrics=["mae", "r2", "fac2"])
    report.show()
    model = make_regressor("linear").fit(centre, features, "no2")
    permutation_importance_report(model, centre, "no2", n_repeats=1).show(5)
    ProphetForecaster().fit(centre.select(F.col("ts").alias("ds"), F.col("no2").alias("y"))).predict(periods=24, freq="h").orderBy(F.desc("ds")).show(3)
    daily = exclude_between(daily_particles(spark), "date", "2020-03-15", "2020-05-11")
    print(NMFApportionment(4, columns=list(PROFILES), max_iter=20).fit(daily).loadings().round(2).to_string())
    log_column(one_hot(daily, "station"), "BaP", "log_bap").select("date", "station", "station_A", "log_bap").show(3)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 60)
