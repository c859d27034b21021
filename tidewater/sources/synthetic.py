"""Made-up stations with the columns, frequency and flaws of real ones. Generated in Spark, the same for a seed.

Noise is a hash of seed, row and column, so it does not depend on how rows are spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *of) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[x if isinstance(x, Column) else F.lit(x) for x in of]), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *of) -> Column:
    """Standard normal by Box and Muller."""
    radius = F.sqrt(-2.0 * F.log(_uniform(seed, "r", *of)))
    return radius * F.cos(2 * math.pi * _uniform(seed, "a", *of))


def hourly_stations(spark: SparkSession, *, n_days: int = 365, stations: tuple[str, ...] = ("Nord", "Sued", "West", "Ost", "Centre"), seed: int = 0) -> DataFrame:
    """``ts, station`` and hourly ``no, no2, o3, pm10, temp, rh, pressure, wind_speed, wind_dir, radiation, precip, blh, u10, v10``.

    About 1 % of no2 and 0.5 % of o3 are missing; pm10 has a firework at New Year's midnight.
    """
    names = F.array(*[F.lit(s) for s in stations])
    rows = spark.range(24 * n_days * len(stations)).select((F.col("id") / len(stations)).cast("bigint").alias("h"), F.get(names, (F.col("id") % len(stations)).cast("int")).alias("station"))
    h, s = F.col("h"), F.col("station")
    noise = lambda name, size: size * _normal(seed, name, h, s)
    day = lambda shift: F.cos(2 * math.pi * (h - shift) / 24)
    year = F.cos(2 * math.pi * (h / 24 - 15) / 365.25)
    stamp = F.timestamp_add("HOUR", h.cast("int"), F.expr("TIMESTAMP_NTZ'2021-01-01 00:00:00'"))
    light = F.greatest(day(12), F.lit(0.0)) * (1.2 - 0.8 * year) * 400
    weather = rows.withColumns({
        "ts": stamp, "temp": 11 - 10 * year + 4 * day(15) + noise("temp", 2), "u10": 1.5 * day(14) + noise("u10", 1.5), "v10": 0.5 + noise("v10", 1.5),
        "radiation": F.greatest(light + noise("radiation", 15), F.lit(0.0)), "pressure": 1013 + 5 * year + noise("pressure", 4),
        "precip": F.greatest(noise("precip", 1) - 1.5, F.lit(0.0)),
    }).withColumns({
        "rh": F.greatest(F.least(75 - 1.2 * F.col("temp") + noise("rh", 8), F.lit(100.0)), F.lit(15.0)), "wind_speed": F.sqrt(F.col("u10") ** 2 + F.col("v10") ** 2),
        "wind_dir": F.pmod(270 - F.degrees(F.atan2("v10", "u10")), F.lit(360.0)), "blh": F.greatest(200 + 2 * F.col("radiation") + noise("blh", 60), F.lit(30.0)),
    })
    still = 1 / (0.4 + F.col("wind_speed") * F.col("blh") / 900)
    traffic = 1 + 0.5 * day(8) + 0.4 * day(18)
    gas = weather.withColumns({
        "no": F.greatest(6 * traffic * still + noise("no", 2), F.lit(0.1)), "no2": F.greatest(9 + 9 * traffic * still + noise("no2", 3), F.lit(0.5)),
        "o3": F.greatest(30 + 0.12 * F.col("radiation") - 6 * still + noise("o3", 6), F.lit(1.0)), "pm10": F.greatest(8 + 10 * still * (1.3 + 0.5 * year) + noise("pm10", 3), F.lit(1.0)),
    })
    midnight = (F.dayofyear("ts") == 1) & (F.hour("ts") == 0)
    out = gas.withColumns({
        "no2": F.when(_uniform(seed, "gap", h, s) > 0.01, F.col("no2")), "o3": F.when(_uniform(seed, "hole", h, s) > 0.005, F.col("o3")),
        "pm10": F.col("pm10") + F.when(midnight, 400.0).otherwise(0.0),
    })
    return out.select("ts", "station", "no", "no2", "o3", "pm10", "temp", "rh", "pressure", "wind_speed", "wind_dir", "radiation", "precip", "blh", "u10", "v10")


#: Profiles of the sources behind ``daily_particles``: heating, traffic, soil, industry.
PROFILES = {
    "BaP": (1.0, 0.2, 0.0, 0.1), "BaA": (0.8, 0.2, 0.0, 0.1), "BbF": (0.9, 0.3, 0.0, 0.1), "BkF": (0.5, 0.2, 0.0, 0.1), "Chry": (0.9, 0.2, 0.0, 0.1), "Flu": (0.7, 0.4, 0.0, 0.1),
    "Pyr": (0.7, 0.4, 0.0, 0.1), "As": (0.2, 0.0, 0.1, 0.5), "Cd": (0.1, 0.1, 0.0, 0.6), "Pb": (0.2, 0.3, 0.1, 0.9), "Mn": (0.0, 0.3, 0.9, 0.6), "Fe": (0.0, 0.8, 1.0, 0.4), "Cu": (0.0, 1.0, 0.1, 0.3), "Zn": (0.2, 0.7, 0.2, 1.0),
}


def daily_particles(spark: SparkSession, *, n_days: int = 1460, stations: tuple[str, ...] = ("A", "B", "C", "D"), seed: int = 0) -> DataFrame:
    """``date, station``, particle-bound compounds mixed from four sources, ``pm10, no2`` and weather, daily."""
    names = F.array(*[F.lit(s) for s in stations])
    rows = spark.range(n_days * len(stations)).select((F.col("id") / len(stations)).cast("int").alias("d"), F.get(names, (F.col("id") % len(stations)).cast("int")).alias("station"))
    d, s = F.col("d"), F.col("station")
    year, week = F.cos(2 * math.pi * (d - 15) / 365.25), F.when(d % 7 >= 5, 0.6).otherwise(1.0)
    spread = lambda name, size: F.exp(size * _normal(seed, name, d, s))
    strength = [F.greatest(0.15 + year, F.lit(0.05)) * spread("heat", 0.4), week * spread("cars", 0.3), (0.8 - 0.4 * year) * spread("soil", 0.4), week * spread("works", 0.5)]
    mix = {c: sum((w * x for w, x in zip(p, strength)), F.lit(0.0)) * spread(c, 0.1) for c, p in PROFILES.items()}
    weather = {"temp": 11 - 11 * year + 3 * _normal(seed, "temp", d, s), "wind_speed": 2 * spread("wind", 0.4), "rh": 70 + 8 * year + 6 * _normal(seed, "rh", d, s)}
    total = sum(strength, F.lit(0.0))
    return rows.select(
        F.timestamp_add("DAY", d, F.expr("TIMESTAMP_NTZ'2018-01-01 00:00:00'")).alias("date"), "station", *[v.alias(c) for c, v in mix.items()],
        (10 + 8 * total).alias("pm10"), (12 + 10 * strength[1]).alias("no2"), *[v.alias(c) for c, v in weather.items()],
    )
