"""Recipes and made-up stations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.core.errors import ColumnNotFoundError, ConfigurationError, SchemaError
from tidewater.functions import recipes
from tidewater.sources.synthetic import PROFILES, daily_particles, hourly_stations


def test_recipes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0), (3, None, None)], "k int, s string, x double")
    assert [(r.s_a, r.s_b) for r in recipes.one_hot(df, "s").orderBy("k").collect()] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert recipes.one_hot(df, "s", ["z"], prefix="is").columns[-1] == "is_z"
    assert [r.k for r in recipes.exclude_between(df, "x", 0.5, 2).orderBy("k").collect()] == [2, 3]
    assert [r.x for r in recipes.log_column(df, "x").orderBy("k").collect()] == [0.0, None, None]
    both = recipes.stack([df, df.select("k", (F.col("k") * 2).alias("extra"))])
    assert both.count() == 6 and both.columns == ["k", "s", "x", "extra"]
    made = recipes.align(df, spark.createDataFrame([(1, 5.0)], "k int, prediction double"), "k").orderBy("k").collect()
    assert [r.prediction for r in made] == [5.0, None, None]
    assert recipes.residual(df.withColumn("p", F.lit(0.25)), "x", "p").first().residual == 0.75
    with pytest.raises(ColumnNotFoundError):
        recipes.one_hot(df, "nope")
    with pytest.raises(SchemaError):
        recipes.stack([])
    monkeypatch.setattr(recipes, "ONE_HOT_VALUES", 1)
    with pytest.raises(ConfigurationError):
        recipes.one_hot(df, "s")


def test_stations(spark):
    df = hourly_stations(spark, n_days=30)
    assert df.count() == 30 * 24 * 5 and df.select("ts", "station").distinct().count() == 30 * 24 * 5
    assert sorted(map(str, df.collect())) == sorted(map(str, hourly_stations(spark, n_days=30).repartition(7).collect()))
    row = df.agg(F.avg(F.col("no2").isNull().cast("double")), F.max("pm10"), F.min("rh"), F.max("wind_dir"), F.stddev("temp")).first()
    assert 0.004 < row[0] < 0.02 and row[1] > 400 and row[2] >= 15 and row[3] < 360 and 1 < row[4] < 15
    daily = daily_particles(spark, n_days=100)
    assert daily.count() == 400 and all(daily.agg(F.min(c)).first()[0] >= 0 for c in list(PROFILES)[:3])
