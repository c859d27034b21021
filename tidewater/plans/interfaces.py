"""Registered queries through the ways in and out of the library: files, the command line, configurations, pieces of studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.core.columns import check_frame, number, resolve
from tidewater.core.shared import scratch_path
from tidewater.core.step import Pipeline, Step, make_pipeline
from tidewater.functions import recipes
from tidewater.models import interpret
from tidewater.models.registry import list_regressors, make_regressor
from tidewater.plans import plots
from tidewater.plans.panel import PANEL, PANEL_SQL, TYPES, USERS, hourly_panel, table
from tidewater.plans.registry import clipped_panel_sql, flagship, flagship_steps, query, r, rounded, rs
from tidewater.sources.stations import load_stations
from tidewater.sources.tables import load_table, save_table

# --- files --------------------------------------------------------------------------------------------------------

_SAVED = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


def _saved(name: str, **options):
    def run(spark, d):
        path = save_table(table(spark, d, "supplier"), scratch_path(spark, name), **options)
        return rounded(load_table(spark, path, columns=["s_acctbal", "s_suppkey", "s_name"]).withColumn("s_suppkey", F.col("s_suppkey").cast("bigint")))

    return run


for _file in ("suppliers.csv", "suppliers.tsv", "suppliers.parquet"):
    query(f"SELECT s_suppkey, s_name, {r('s_acctbal')} AS s_acctbal FROM supplier", f"saved_{_file.split('.')[1]}")(_saved(_file))
query(f"SELECT s_suppkey, s_name, {r('s_acctbal')} AS s_acctbal FROM supplier", "saved_single_file")(_saved("suppliers.csv", single_file=True))


@query("SELECT 'S ' || s_suppkey AS station_name, " + r("CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (s_nationkey + (s_suppkey % 60) / 60.0::DOUBLE)") + " AS station_lat, " + r("s_suppkey / 8.0::DOUBLE") + " AS station_lon FROM supplier")
def station_file(spark, d):
    k = F.col("s_suppkey")
    degrees = F.concat(F.col("s_nationkey").cast("string"), F.lit("-"), (k % 60).cast("string"), F.lit("-00"), F.when(k % 2 == 0, "S").otherwise("N"))
    sheet = table(spark, d, "supplier").select(F.concat(F.lit("S "), k.cast("string")).alias("Measuring station "), (k / 8.0).alias("Longitude"), degrees.alias("Latitude"))
    return rounded(load_stations(spark, save_table(sheet, scratch_path(spark, "stations.parquet"))))


@query(clipped_panel_sql())
def cli_preprocess(spark, d):
    from tidewater.cli import main

    source = save_table(hourly_panel(spark, d), scratch_path(spark, "panel.parquet"))
    target = scratch_path(spark, "clean.parquet")
    assert main(["preprocess", source, target, "--time-col", "hour"]) == 0
    return rounded(spark.read.parquet(target))


# --- columns, steps, configurations ---------------------------------------------------------------------------------


@query("SELECT column_name AS name, (row_number() OVER (ORDER BY n) - 1)::BIGINT AS place FROM (SELECT column_name, column_type, row_number() OVER () AS n FROM (DESCRIBE lineitem)) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
def numeric_selection(spark, d):
    df = check_frame(table(spark, d, "lineitem"))
    return spark.createDataFrame(list(enumerate(resolve(df, None, numeric_only=True))), "place bigint, name string")


_FLAGSHIP = [
    {"step": "MissingValueHandler", "params": {"columns": list(TYPES), "strategy": "interpolate", "limit": 3, "axis": PANEL}},
    {"step": "OutlierHandler", "params": {"columns": list(TYPES), "method": "iqr", "strategy": "clip"}, "name": "clip"},
    {"step": "TemporalFeatures", "params": {"time_col": "hour"}},
    {"step": "Scaler", "params": {"columns": list(TYPES)}},
]


def _flagship_sql() -> str:
    from tidewater.plans.registry import ORACLES

    return ORACLES["flagship"]


@query(_flagship_sql())
def pipeline_from_config(spark, d):
    pipe = Pipeline.from_config(_FLAGSHIP)
    out = pipe.fit_transform(hourly_panel(spark, d))
    return rounded(out.select(*pipe.output_columns()))


@query(_flagship_sql())
def pipeline_stored(spark, d):
    """The flagship with every step's output stored, fitted and applied apart."""
    pipe = Pipeline(flagship_steps(), store=True)
    panel = hourly_panel(spark, d)
    return rounded(pipe.fit(panel).transform(panel))


class Centred(Step):
    """A step of a user's own: columns less their mean."""

    numeric_only = True

    def __init__(self, columns=None):
        self.columns = columns

    def learn(self, df):
        self.means_ = df.agg(*[F.avg(number(df, c)).alias(c) for c in self.columns_]).first().asDict()

    def apply(self, df):
        return df.withColumns({c: number(df, c) - F.lit(m) for c, m in self.means_.items()})


@query(f"SELECT p_partkey, {r('p_retailprice - (SELECT avg(p_retailprice) FROM part)')} AS p_retailprice, {r('p_size - (SELECT avg(p_size) FROM part)')} AS p_size FROM part")
def own_step(spark, d):
    return rounded(make_pipeline(Centred("p_retailprice"), Centred(["p_size"])).fit_transform(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")))


# --- pieces of studies ----------------------------------------------------------------------------------------------


@query("SELECT event_id, hour(ts)::BIGINT AS h FROM events WHERE hour(ts) NOT BETWEEN 2 AND 4")
def excluded_range(spark, d):
    return rounded(recipes.exclude_between(table(spark, d, "events").select("event_id", F.hour("ts").alias("h")), "h", 2, 4))


@query(f"WITH p AS ({PANEL_SQL}) SELECT a.hour, {r('a.view')} AS view, {r('b.view')} AS prediction, {r('a.view - b.view')} AS residual FROM p a LEFT JOIN p b ON a.hour = b.hour + INTERVAL 24 HOUR")
def forecast_alignment(spark, d):
    panel = hourly_panel(spark, d).select("hour", "view")
    late = panel.select((F.col("hour") + F.expr("INTERVAL 24 HOURS")).alias("hour"), F.col("view").alias("prediction"))
    return rounded(recipes.residual(recipes.align(panel, late, "hour"), "view", "prediction"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg(abs({c} - m_{c}))')} AS mean_abs_shap FROM lineitem, (SELECT avg({c}) AS m_{c} FROM lineitem)" for c in ("l_quantity", "l_discount")))
def mean_abs_values(spark, d):
    """The values of a linear model with weights of one: distances from the mean."""
    df = Centred(["l_quantity", "l_discount"]).fit_transform(table(spark, d, "lineitem").select("l_quantity", "l_discount"))
    return rounded(interpret.shap_importance(df.withColumnsRenamed({"l_quantity": "shap_l_quantity", "l_discount": "shap_l_discount"}).withColumn("shap_base", F.lit(0.0))))


_TWO = "SELECT p_size::DOUBLE AS a, (p_partkey % 10)::DOUBLE AS b, p_retailprice AS y FROM part"
_WEIGHTS = f"""WITH t AS ({_TWO}), s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
w AS (SELECT (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb, * FROM s)"""


def _two(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 10).cast("double").alias("b"), F.col("p_retailprice").alias("y"))


@query(f"{_WEIGHTS}, u AS (SELECT 'a' AS feature, abs(wa) AS v FROM w UNION ALL SELECT 'b', abs(wb) FROM w) SELECT feature, {r('v')} AS importance FROM u")
def importance_report(spark, d):
    df = _two(spark, d)
    return rounded(interpret.importance_table(df, interpret.extract_importances(make_regressor("linear").fit(df, ["a", "b"], "y"))).select("feature", "importance"))


@query(f"{_WEIGHTS} SELECT p_partkey, {r('my + wa * (p_size - ma) + wb * (p_partkey % 10 - mb)', 4)} AS prediction FROM part, w")
def linear_two_features(spark, d):
    df = _two(spark, d)
    return rounded(make_regressor("Linear").fit(df, ["a", "b"], "y").predict(df).select("p_partkey", "prediction"), 4)


@query("SELECT unnest(['decision_tree', 'elasticnet', 'extra_trees', 'gradient_boosting', 'hist_gradient_boosting', 'knn', 'lasso', 'linear', 'mlp', 'random_forest', 'ridge', 'svr', 'xgboost']) AS name")
def regressor_names(spark, d):
    return spark.createDataFrame([(n,) for n in list_regressors()], "name string")


@query(f"SELECT user_id, {r('value')} AS observed, {r('lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS predicted, ts FROM events")
def prediction_pairs(spark, d):
    from tidewater.operators import LagFeatures

    df = LagFeatures("value", lags=[1], axis=USERS).fit_transform(table(spark, d, "events").select("user_id", "ts", "event_id", "value"))
    rows, _ = plots.predictions(df.withColumn("key", F.struct("ts", "user_id")), "value", "value_lag1", time="key")
    return rounded(rows.select("key.ts", "key.user_id", "observed", "predicted"))


# --- networks along an axis -------------------------------------------------------------------------------------------

_WINDOW = 6


def _network(kind: str, **params):
    def run(spark, d):
        """How many rows of the panel have a prediction: all but the first window's."""
        from tidewater.models import neural
        from tidewater.operators import MissingValueHandler

        df = MissingValueHandler(list(TYPES), "mean").fit_transform(hourly_panel(spark, d))
        model = getattr(neural, kind)(window=_WINDOW, epochs=2, axis=PANEL, **params).fit(df, ["click", "error"], "view")
        out = model.predict(df, "p")
        return out.agg(F.count("*").alias("n"), F.count("p").alias("predicted"), F.min(F.when(F.col("p").isNotNull(), F.col("hour"))).alias("first"))

    return run


for _kind, _more in (("LSTMRegressor", {"hidden": 4}), ("CNNRegressor", {"channels": (4,)})):
    query(f"SELECT count(*) AS n, greatest(count(*) - {_WINDOW}, 0) AS predicted, min(CASE WHEN k > {_WINDOW} THEN hour END) AS first FROM (SELECT hour, row_number() OVER (ORDER BY hour) AS k FROM ({PANEL_SQL}))", f"{_kind[:-9].lower()}_alignment")(_network(_kind, **_more))
