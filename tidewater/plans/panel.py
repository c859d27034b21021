"""Input tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.core.axis import Axis

TYPES = ("click", "error", "purchase", "signup", "view")

#: Every seventh value and the first five of each fifty are missing.
GAP = "event_id % 7 = 0 OR event_id % 50 < 5"

PANEL = Axis("hour", block_rows=None)  # a row an hour: short whatever the events
EVENTS = Axis("ts", tie="event_id")
USERS = Axis("ts", keys=("user_id",), tie="event_id")
BLOCKS = Axis("ts", tie="event_id", block_rows=1500)
USER_BLOCKS = Axis("ts", keys=("user_id",), tie="event_id", block_rows=7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per hour and event type, one column each."""
    events = table(spark, sf_dir, "events")
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t)
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*[of(t) for t in TYPES])


def gappy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with gaps by the clock in two columns, at every scale."""
    h = F.hour("hour")
    return hourly_panel(spark, sf_dir).withColumns({
        "click": F.when(h % 5 != 0, F.col("click")), "error": F.when(~h.between(3, 15), F.col("error")),
    })


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return events.withColumn("value", F.when(~F.expr(GAP), F.col("value")))


PANEL_SQL = "SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1"
GAPPY_PANEL_SQL = f"SELECT hour, CASE WHEN hour(hour) % 5 <> 0 THEN click END AS click, CASE WHEN hour(hour) NOT BETWEEN 3 AND 15 THEN error END AS error, purchase, signup, view FROM ({PANEL_SQL})"
GAPPY_EVENTS_SQL = f"SELECT event_id, user_id, ts, CASE WHEN NOT ({GAP}) THEN value END AS value, event_type FROM events"
