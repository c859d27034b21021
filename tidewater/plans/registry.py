"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Numbers are rounded on both sides, since sums of doubles depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.core.axis import Axis
from tidewater.core.step import Pipeline
from tidewater.evaluation import metrics, splits, validation
from tidewater.functions import calendar, geo, recipes, stats
from tidewater.operators import CorrelationFilter, LagFeatures, MissingValueHandler, OutlierHandler, Scaler, TemporalFeatures, WindDecomposer
from tidewater.operators.lags import next_steps
from tidewater.operators.missing import interpolate
from tidewater.operators.outliers import bounds
from tidewater.operators.temporal import parsed_time
from tidewater.plans import plots
from tidewater.plans.panel import (
    BLOCKS, EVENTS, GAPPY_EVENTS_SQL, GAPPY_PANEL_SQL, PANEL, PANEL_SQL, TYPES, USER_BLOCKS, USERS, gappy_events, gappy_panel, hourly_panel, table,
)
from tidewater.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL."""
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, *, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded (no negative zero), integers as long."""
    new = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float") and f.name not in skip:
            new[f.name] = F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            new[f.name] = F.col(f.name).cast("bigint")
    return df.withColumns(new) if new else df


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def rs(names, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in names)


# --- panel and missing values -------------------------------------------------------------------------------------


@query(f"SELECT hour, {rs(TYPES)} FROM ({PANEL_SQL})", "hourly_panel")
def _hourly_panel(spark, d):
    return rounded(hourly_panel(spark, d))


_GAPPY = list(TYPES)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS fraction FROM ({GAPPY_PANEL_SQL})" for c in TYPES) + ")")
def missing_fraction(spark, d):
    return rounded(plots.missingness(gappy_panel(spark, d), list(TYPES)))


@query(f"SELECT hour, {', '.join(f'({c} IS NULL) AS {c}' for c in TYPES)} FROM ({GAPPY_PANEL_SQL})")
def missing_matrix(spark, d):
    return plots.missingness(gappy_panel(spark, d), list(TYPES), kind="matrix", keep=["hour"])


@query(f"SELECT hour, {rs(['click', 'error'])}, (click IS NULL)::BIGINT AS click__missing, (error IS NULL)::BIGINT AS error__missing FROM ({GAPPY_PANEL_SQL})")
def missing_indicator(spark, d):
    df = gappy_panel(spark, d).select("hour", "click", "error")
    step = MissingValueHandler(["click", "error"], "ffill", limit=1, add_indicator=True, axis=PANEL)
    flagged = step.fit(df).transform(df).select("hour", "click__missing", "error__missing").withColumnRenamed("hour", "_h")
    return rounded(df.join(flagged, F.col("hour") == F.col("_h")).drop("_h"))


@query(f"SELECT hour, {rs(TYPES)} FROM ({GAPPY_PANEL_SQL}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in TYPES))
def drop_missing(spark, d):
    return rounded(MissingValueHandler(list(TYPES), "drop").fit_transform(gappy_panel(spark, d)))


_SPARSE = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS a, CASE WHEN event_id % 3 = 0 THEN value END AS b FROM events"


@query(f"SELECT event_id, {r('coalesce(a, -1.0)')} AS a, (a IS NULL)::BIGINT AS a__missing, (b IS NULL)::BIGINT AS b__missing FROM ({_SPARSE})")
def drop_sparse_columns(spark, d):
    step = MissingValueHandler(["a", "b"], "constant", fill_value=-1.0, column_missing_threshold=0.5, add_indicator=True)
    value, k = F.col("value"), F.col("event_id")
    df = table(spark, d, "events").select("event_id", F.when(k % 5 != 0, value).alias("a"), F.when(k % 3 == 0, value).alias("b"))
    return rounded(step.fit_transform(df))


for _name, _how, _of in (("fill_mean", "mean", "avg({c})"), ("fill_median", "median", "quantile_cont({c}, 0.5)")):
    _cells = ", ".join(f"{r(f'coalesce({c}, (SELECT {_of.format(c=c)} FROM g))')} AS {c}" for c in TYPES)

    @query(f"WITH g AS ({GAPPY_PANEL_SQL}) SELECT hour, {_cells} FROM g", _name)
    def _fill(spark, d, how=_how):
        return rounded(MissingValueHandler(list(TYPES), how).fit_transform(gappy_panel(spark, d)))


_MODE = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id % 11 END AS k FROM events"


@query(f"WITH m AS ({_MODE}), t AS (SELECT k FROM m WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) SELECT event_id, coalesce(k, (SELECT k FROM t)) AS k FROM m")
def fill_mode(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 11).alias("k"))
    return MissingValueHandler("k", "most_frequent").fit_transform(df)


@query(f"SELECT hour, {', '.join(f'{r(f'coalesce({c}, 0.0)')} AS {c}' for c in TYPES)} FROM ({GAPPY_PANEL_SQL})")
def fill_constant(spark, d):
    return rounded(MissingValueHandler(list(TYPES), "constant", fill_value=0.0).fit_transform(gappy_panel(spark, d)))


def neighbours_sql(source: str, column: str, order: str, part: str = "", t: str = "epoch_us(ts)") -> str:
    """Rows with rn and the nearest known value, time and rn before and after."""
    over = f"{f'PARTITION BY {part} ' if part else ''}ORDER BY {order}"
    known = lambda x: f"CASE WHEN {column} IS NOT NULL THEN {x} END IGNORE NULLS"
    return f"""SELECT *, {', '.join(f"last_value({known(x)}) OVER b AS p_{n}, first_value({known(x)}) OVER a AS n_{n}" for n, x in (("v", column), ("t", t), ("rn", "rn")))}
      FROM (SELECT *, row_number() OVER ({over}) - 1 AS rn FROM ({source}))
      WINDOW b AS ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def interpolated_sql(column: str, limit: int | None, by_time: bool = True, t: str = "epoch_us(ts)") -> str:
    far = "" if limit is None else f"WHEN rn - p_rn > {limit} THEN NULL "
    x = f"({t} - p_t)::DOUBLE / nullif(n_t - p_t, 0)" if by_time else "(rn - p_rn)::DOUBLE / nullif(n_rn - p_rn, 0)"
    return f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN p_v IS NULL THEN NULL {far}WHEN n_v IS NULL THEN p_v ELSE p_v + (n_v - p_v) * ({x}) END"


_BY_USER = neighbours_sql(GAPPY_EVENTS_SQL, "value", "ts, event_id", "user_id")
_ALL = neighbours_sql(GAPPY_EVENTS_SQL, "value", "ts, event_id")


def _events(spark, d):
    return gappy_events(spark, d).drop("event_type")


def _handled(axis, strategy, limit=None):
    return lambda spark, d: rounded(MissingValueHandler("value", strategy, limit=limit, axis=axis).fit_transform(_events(spark, d)))


_KEEP = "event_id, user_id, ts"
query(f"SELECT {_KEEP}, {r('CASE WHEN rn - p_rn <= 2 THEN p_v END')} AS value FROM ({_BY_USER})", "ffill_limit")(_handled(USERS, "ffill", 2))
query(f"SELECT {_KEEP}, {r('CASE WHEN n_rn - rn <= 2 THEN n_v END')} AS value FROM ({_BY_USER})", "bfill_limit")(_handled(USERS, "bfill", 2))
query(f"SELECT {_KEEP}, {r('p_v')} AS value FROM ({_ALL})", "ffill_blocks")(_handled(BLOCKS, "ffill"))
query(f"SELECT {_KEEP}, {r(interpolated_sql('value', None))} AS value FROM ({_BY_USER})", "interpolate_time")(_handled(USERS, "interpolate"))
query(f"SELECT {_KEEP}, {r(interpolated_sql('value', None))} AS value FROM ({_BY_USER})", "interpolate_user_blocks")(_handled(USER_BLOCKS, "interpolate"))
query(f"SELECT {_KEEP}, {r(interpolated_sql('value', 3))} AS value FROM ({_ALL})", "interpolate_limit3")(_handled(EVENTS, "interpolate", 3))
query(f"SELECT {_KEEP}, {r(interpolated_sql('value', 3))} AS value FROM ({_ALL})", "interpolate_blocks")(_handled(BLOCKS, "interpolate", 3))


@query(f"SELECT {_KEEP}, {r(interpolated_sql('value', 2, by_time=False))} AS value FROM ({_BY_USER})")
def interpolate_position(spark, d):
    return rounded(interpolate(_events(spark, d), USERS, ["value"], by_time=False, limit=2))


# --- outliers -----------------------------------------------------------------------------------------------------

_PRICED = ("l_quantity", "l_extendedprice", "l_discount")
_BOUNDS_SQL = {
    "iqr": "SELECT '{c}' AS \"column\", q[1] - 1.5 * (q[2] - q[1]) AS low, q[2] + 1.5 * (q[2] - q[1]) AS high FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {t})",
    "zscore": "SELECT '{c}' AS \"column\", avg({c}) - 3 * stddev_samp({c}) AS low, avg({c}) + 3 * stddev_samp({c}) AS high FROM {t}",
    "modified_zscore": "SELECT '{c}' AS \"column\", m - 3.5 * s / 0.6745 AS low, m + 3.5 * s / 0.6745 AS high FROM (SELECT any_value(m) AS m, quantile_cont(abs({c} - m), 0.5) AS s FROM {t}, (SELECT quantile_cont({c}, 0.5) AS m FROM {t}))",
    "quantile": "SELECT '{c}' AS \"column\", q[1] AS low, q[2] AS high FROM (SELECT quantile_cont({c}, [0.01, 0.99]) AS q FROM {t})",
}


def bounds_sql(method: str, columns, source: str) -> str:
    return " UNION ALL ".join(_BOUNDS_SQL[method].format(c=c, t=source) for c in columns)


for _method in _BOUNDS_SQL:
    @query(f'SELECT "column", {rs(["low", "high"], 4)} FROM ({bounds_sql(_method, _PRICED, "lineitem")})', f"bounds_{_method}")
    def _bounds(spark, d, method=_method):
        got = bounds(table(spark, d, "lineitem"), list(_PRICED), method)
        return rounded(spark.createDataFrame([(c, *b) for c, b in got.items()], '`column` string, low double, high double'), 4)


_IQR_EVENTS = f"WITH e AS ({GAPPY_EVENTS_SQL}), b AS (SELECT quantile_cont(value, [0.05, 0.9]) AS q FROM e)"


def _treated(strategy):
    def run(spark, d):
        step = OutlierHandler("value", "quantile", strategy, quantiles=(0.05, 0.9))
        return rounded(step.fit_transform(_events(spark, d)))

    return run


query(f"{_IQR_EVENTS} SELECT {_KEEP}, {r('CASE WHEN value < q[1] THEN q[1] WHEN value > q[2] THEN q[2] ELSE value END')} AS value FROM e, b", "outlier_clip")(_treated("clip"))
query(f"{_IQR_EVENTS} SELECT {_KEEP}, {r('value')} AS value FROM e, b WHERE value IS NULL OR value BETWEEN q[1] AND q[2]", "outlier_drop")(_treated("drop"))
query(f"{_IQR_EVENTS} SELECT {_KEEP}, {r('CASE WHEN value BETWEEN q[1] AND q[2] THEN value END')} AS value FROM e, b", "outlier_nan")(_treated("nan"))
query(f"{_IQR_EVENTS} SELECT {_KEEP}, {r('value')} AS value, coalesce((value < q[1] OR value > q[2])::BIGINT, 0) AS is_outlier FROM e, b", "outlier_flag")(_treated("flag"))


@query(f"{_IQR_EVENTS} SELECT count(*) FILTER (WHERE value < q[1] OR value > q[2]) AS n, {r('avg(CASE WHEN value < q[1] OR value > q[2] THEN 1.0 ELSE 0.0 END)')} AS fraction FROM e, b")
def outlier_count(spark, d):
    step = OutlierHandler("value", "quantile", "flag", quantiles=(0.05, 0.9)).fit(_events(spark, d))
    return rounded(spark.createDataFrame([(step.n_outliers_, step.outlier_fraction_)], "n bigint, fraction double"))


def rolling_sql(part: str, window: int, sigma: float) -> str:
    over = f"({f'PARTITION BY {part} ' if part else ''}ORDER BY ts, event_id ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING)"
    return f"SELECT *, avg(value) OVER w - {sigma} * coalesce(stddev_samp(value) OVER w, 0) AS low, avg(value) OVER w + {sigma} * coalesce(stddev_samp(value) OVER w, 0) AS high FROM ({GAPPY_EVENTS_SQL}) WINDOW w AS {over}"


def _rolling(axis, strategy, window, sigma):
    return lambda spark, d: rounded(OutlierHandler("value", "rolling_sigma", strategy, window=window, sigma=sigma, axis=axis).fit_transform(_events(spark, d)), 4)


_CLIP = r("CASE WHEN value < low THEN low WHEN value > high THEN high ELSE value END", 4)
query(f"SELECT {_KEEP}, {_CLIP} AS value FROM ({rolling_sql('user_id', 12, 1.5)})", "rolling_sigma_clip")(_rolling(USERS, "clip", 12, 1.5))
query(f"SELECT {_KEEP}, {_CLIP} AS value FROM ({rolling_sql('user_id', 12, 1.5)})", "rolling_sigma_user_blocks")(_rolling(USER_BLOCKS, "clip", 12, 1.5))
query(f"SELECT {_KEEP}, {_CLIP} AS value FROM ({rolling_sql('', 72, 2.0)})", "rolling_sigma_blocks")(_rolling(BLOCKS, "clip", 72, 2.0))
query(f"SELECT {_KEEP}, {r('value', 4)} AS value FROM ({rolling_sql('user_id', 12, 1.5)}) WHERE NOT coalesce(value < low OR value > high, false)", "rolling_sigma_drop")(_rolling(USERS, "drop", 12, 1.5))
query(f"SELECT {_KEEP}, {r('CASE WHEN NOT coalesce(value < low OR value > high, false) THEN value END', 4)} AS value FROM ({rolling_sql('', 72, 2.0)})", "rolling_sigma_nan")(_rolling(EVENTS, "nan", 72, 2.0))
query(f"SELECT {_KEEP}, {r('value', 4)} AS value, coalesce((value < low OR value > high)::BIGINT, 0) AS is_outlier FROM ({rolling_sql('', 72, 2.0)})", "rolling_sigma_flag")(_rolling(EVENTS, "flag", 72, 2.0))


# --- features -----------------------------------------------------------------------------------------------------

_FIELD_SQL = {
    "year": "year(t)", "quarter": "quarter(t)", "month": "month(t)", "day": "day(t)", "dayofweek": "isodow(t) - 1", "dayofyear": "dayofyear(t)",
    "weekofyear": "week(t)", "hour": "hour(t)", "minute": "minute(t)", "is_weekend": "(isodow(t) >= 6)::BIGINT", "is_month_start": "(day(t) = 1)::BIGINT",
    "is_month_end": "(t::DATE = last_day(t))::BIGINT", "season": "(month(t) % 12 + 3) // 3",
}


def _cycle_sql(f: str, t: str) -> str:
    first, period = calendar.CYCLES[f]
    angle = f"2 * pi() * (({_FIELD_SQL[f].replace('(t', f'({t}')}) - {first}) / {period}::DOUBLE"
    return f"{r(f'sin({angle})')} AS {f}_sin, {r(f'cos({angle})')} AS {f}_cos"


@query("SELECT o_orderkey, " + ", ".join(f"({x})::BIGINT AS {n}" for n, x in _FIELD_SQL.items()) + " FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)")
def calendar_fields(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rounded(TemporalFeatures("o_orderdate", add=list(_FIELD_SQL), cyclical=()).fit_transform(df).drop("o_orderdate"))


@query("SELECT event_id, " + ", ".join(_cycle_sql(f, "t") for f in calendar.CYCLES) + " FROM (SELECT event_id, ts AS t FROM events)")
def cyclical_fields(spark, d):
    df = table(spark, d, "events").select("event_id", "ts")
    return rounded(TemporalFeatures("ts", add=(), cyclical=list(calendar.CYCLES)).fit_transform(df).drop("ts"))


_HOLIDAYS = ["1996-01-01", "1997-12-25", "1998-05-01", "2000-02-29"]


@query("SELECT o_orderkey, (o_orderdate::DATE IN (" + ", ".join(f"DATE '{x}'" for x in _HOLIDAYS) + "))::BIGINT AS is_holiday FROM orders")
def holiday_flag(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rounded(TemporalFeatures("o_orderdate", add=["is_holiday"], cyclical=(), holidays=_HOLIDAYS).fit_transform(df).drop("o_orderdate"))


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('cos(radians(wd))')} AS wd_x, {r('sin(radians(wd))')} AS wd_y, {r('sqrt(u * u + v * v)')} AS wind_speed FROM (SELECT l_orderkey, l_linenumber, l_extendedprice % 360 AS wd, l_quantity - 25 AS u, l_discount * 100 - 5 AS v FROM lineitem)")
def wind_decompose(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 360).alias("wd"), (F.col("l_quantity") - 25).alias("u"), (F.col("l_discount") * 100 - 5).alias("v"),
    )
    return rounded(WindDecomposer("wd", speed_from_uv=("u", "v"), drop_original=True).fit_transform(df))


def _lagged(axis, agg="median", lags=(1, 3), windows=(12,)):
    return lambda spark, d: rounded(LagFeatures("value", lags=lags, windows=windows, agg=agg, axis=axis).fit_transform(_events(spark, d)))


_LAG_SQL = "SELECT event_id, user_id, ts, {value} AS value, {lag1} AS value_lag1, {lag3} AS value_lag3, {roll} AS value_roll12_{agg} FROM ({source}) WINDOW w AS ({part}ORDER BY ts, event_id), f AS ({part}ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
_ROLL = {"median": "quantile_cont(value, 0.5) OVER f", "mean": "avg(value) OVER f", "min": "min(value) OVER f", "max": "max(value) OVER f", "std": "stddev_samp(value) OVER f"}


def lag_sql(agg: str, part: str) -> str:
    return _LAG_SQL.format(value=r("value"), lag1=r("lag(value, 1) OVER w"), lag3=r("lag(value, 3) OVER w"), roll=r(_ROLL[agg]), agg=agg, source=GAPPY_EVENTS_SQL, part=part)


for _agg in _ROLL:
    query(lag_sql(_agg, "PARTITION BY user_id "), f"causal_roll_{_agg}")(_lagged(USERS, _agg))
query(lag_sql("mean", ""), "causal_roll_blocks")(_lagged(BLOCKS, "mean"))


@query(f"SELECT event_id, {r('lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS next_value FROM events")
def next_step_target(spark, d):
    df = next_steps(table(spark, d, "events"), "value", USERS, name="next_value")
    return rounded(df.select("event_id", "next_value"))


# --- correlation and scaling --------------------------------------------------------------------------------------

_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(spark, d):
    return rounded(stats.correlation_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_RANK_SQL = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query(f"SELECT 'p_size' AS a, 'p_retailprice' AS b, {r('corr(a, b)')} AS r FROM (SELECT {_RANK_SQL.format(x='p_size')} AS a, {_RANK_SQL.format(x='p_retailprice')} AS b FROM part)")
def corr_spearman(spark, d):
    return rounded(stats.correlation_table(table(spark, d, "part"), ["p_size", "p_retailprice"], "spearman"))


@query(f"WITH c AS (SELECT s_nationkey AS a, s_acctbal AS b FROM supplier), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s, (x.a <> y.a)::INT AS na, (x.b <> y.b)::INT AS nb FROM c x, c y) SELECT 's_nationkey' AS a, 'balance' AS b, {r('sum(s) / sqrt(sum(na)::DOUBLE * sum(nb))')} AS r FROM p")
def corr_kendall(spark, d):
    df = table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("balance"))
    return rounded(stats.correlation_table(df, ["s_nationkey", "balance"], "kendall"))


@query(f"WITH t AS (SELECT p_partkey, p_size, p_retailprice, p_size * 2.0 + 1 AS double_size, p_retailprice + p_size / 1000.0 AS near_price FROM part) SELECT p_partkey, p_size::BIGINT AS p_size, {r('p_retailprice')} AS p_retailprice FROM t")
def corr_filter(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") * 2.0 + 1).alias("double_size"), (F.col("p_retailprice") + F.col("p_size") / 1000.0).alias("near_price"))
    step = CorrelationFilter(0.99, columns=["p_size", "p_retailprice", "double_size", "near_price"])
    return rounded(step.fit_transform(df))


_SCALE_SQL = {
    "standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), "maxabs": ("0.0", "max(abs({c}))"),
}
_SCALED = ("o_totalprice", "m")
_ORDERS = "SELECT o_orderkey, o_totalprice, month(o_orderdate)::DOUBLE AS m FROM orders"


def scaled_sql(method: str) -> str:
    s = ", ".join(f"{_SCALE_SQL[method][0].format(c=c)} AS a_{c}, {_SCALE_SQL[method][1].format(c=c)} AS s_{c}" for c in _SCALED)
    cells = ", ".join(f"{r(f'({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}" for c in _SCALED)
    return f"WITH o AS ({_ORDERS}), s AS (SELECT {s} FROM o) SELECT o_orderkey, {cells} FROM o, s"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("m"))


for _method in _SCALE_SQL:
    @query(scaled_sql(_method), f"scale_{_method}")
    def _scale(spark, d, method=_method):
        return rounded(Scaler(list(_SCALED), method).fit_transform(_orders(spark, d)))


@query(f"SELECT o_orderkey, {rs(_SCALED, 4)} FROM ({_ORDERS})")
def scale_inverse(spark, d):
    df = _orders(spark, d)
    step = Scaler(list(_SCALED), "robust").fit(df)
    return rounded(step.inverse_transform(step.transform(df)), 4)


# --- splits and scores --------------------------------------------------------------------------------------------


def split_sql(folds: str) -> str:
    return f"""WITH e AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events), n AS (SELECT max(n) AS n FROM e), f AS ({folds})
    SELECT fold::BIGINT AS fold, role, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, {r('sum(value)', 4)} AS total FROM f JOIN e ON rn >= lo AND rn < hi GROUP BY fold, role"""


def _folded(cv):
    def run(spark, d):
        df = table(spark, d, "events").select("event_id", "ts", "value")
        wanted = {"rows": ("count", "*"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts"), "total": ("sum", "value")}
        return rounded(cv.summary(df, Axis("ts", tie="event_id", block_rows=100_000), wanted), 4)

    return run


_BLOCK_FOLDS = """SELECT k AS fold, role, CASE role WHEN 'train' THEN lo ELSE lo + half + 24 END AS lo, CASE role WHEN 'train' THEN lo + half ELSE hi END AS hi
  FROM (SELECT *, (hi - lo - 24) // 2 AS half FROM (SELECT k, k * (n // 7) AS lo, CASE WHEN k = 6 THEN n ELSE (k + 1) * (n // 7) END AS hi FROM n, range(7) t(k))), (VALUES ('train'), ('test')) r(role)"""
query(split_sql(_BLOCK_FOLDS), "split_blocking")(_folded(splits.BlockingTimeSeriesSplit(7, gap=24)))
_SLIDE_FOLDS = "SELECT k AS fold, role, CASE role WHEN 'train' THEN k * {move} * {slide} ELSE k * {move} + {train} + 5 END AS lo, CASE role WHEN 'train' THEN k * {move} + {train} ELSE k * {move} + {train} + 5 + 60 END AS hi FROM n, range(1000000) t(k), (VALUES ('train'), ('test')) r(role) WHERE k * {move} + {train} + 65 <= n"
query(split_sql(_SLIDE_FOLDS.format(move=150, train=300, slide=1)), "split_sliding")(_folded(splits.SlidingWindowSplit(300, 60, step=150, gap=5)))
query(split_sql(_SLIDE_FOLDS.format(move=150, train=200, slide=0)), "split_expanding")(_folded(splits.ExpandingWindowSplit(200, 60, step=150, gap=5)))
_SERIES_FOLDS = "SELECT k AS fold, role, CASE role WHEN 'train' THEN 0 ELSE n - (5 - k) * (n // 6) END AS lo, CASE role WHEN 'train' THEN n - (5 - k) * (n // 6) ELSE n - (4 - k) * (n // 6) END AS hi FROM n, range(5) t(k), (VALUES ('train'), ('test')) r(role)"
query(split_sql(_SERIES_FOLDS), "split_timeseries")(_folded(splits.TimeSeriesSplit(5)))


@query("""WITH e AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
SELECT CASE WHEN rn < n - round_even(0.2 * n, 0) THEN 'train' ELSE 'test' END AS role, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM e
WHERE rn < n - round_even(0.2 * n, 0) - 24 OR rn >= n - round_even(0.2 * n, 0) GROUP BY 1""")
def split_holdout(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", "value")
    train, test = splits.temporal_train_test_split(df, EVENTS, test_size=0.2, gap=24)
    both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    return both.groupBy("role").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_SCORED_SQL = "SELECT event_type AS g, value AS o, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events"


def metrics_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    also = f"PARTITION BY {by}, " if by else "PARTITION BY "
    group, keep = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    q = f"(SELECT {keep}avg(o) AS m, quantile_cont(o, 0.75) - quantile_cont(o, 0.25) AS iqr FROM x {group})"
    join = f"JOIN q USING ({by})" if by else ", q"
    rank = lambda c: f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER ({also}{c}) - 1) / 2.0"
    made = {
        "mae": "avg(abs(p - o))", "mse": "avg((p - o) ** 2)", "rmse": "sqrt(avg((p - o) ** 2))", "r2": "1 - sum((p - o) ** 2) / nullif(sum((o - m) ** 2), 0)",
        "mape": "100 * avg(abs((p - o) / nullif(o, 0)))", "smape": "100 * avg(coalesce(2 * abs(p - o) / nullif(abs(p) + abs(o), 0), 0))",
        "wape": "sum(abs(p - o)) / nullif(sum(abs(o)), 0)", "nmae": "avg(abs(p - o)) / nullif(any_value(iqr), 0)", "nrmse": "sqrt(avg((p - o) ** 2)) / nullif(any_value(iqr), 0)",
        "bias": "avg(p - o)", "pearson_r": "corr(o, p)", "spearman_r": "corr(ro, rp)", "index_of_agreement": "1 - sum((p - o) ** 2) / nullif(sum((abs(p - m) + abs(o - m)) ** 2), 0)",
        "fac2": "avg(CASE WHEN o <> 0 THEN (p / nullif(o, 0) BETWEEN 0.5 AND 2)::INT END)",
    }
    return f"WITH x AS (SELECT * FROM ({source}) WHERE o IS NOT NULL AND p IS NOT NULL), q AS {q}, k AS (SELECT *, {rank('o')} AS ro, {rank('p')} AS rp FROM x) SELECT {keep}{', '.join(f'{r(v)} AS {n}' for n, v in made.items())} FROM k {join} {group}"


def _scored(spark, d):
    df = table(spark, d, "events")
    return df.select(F.col("event_type").alias("g"), F.col("value").alias("o"), F.lag("value", 1).over(USERS.window()).alias("p"))


@query(metrics_sql(_SCORED_SQL))
def metrics_all(spark, d):
    return rounded(metrics.regression_metrics(_scored(spark, d), "o", "p"))


@query(metrics_sql(_SCORED_SQL))
def metrics_distributed(spark, d):
    return rounded(metrics.regression_metrics(_scored(spark, d), "o", "p", distributed=True))


@query(metrics_sql(_SCORED_SQL, "g"))
def metrics_by_group(spark, d):
    return rounded(metrics.regression_metrics(_scored(spark, d), "o", "p", by=["g"]))


@query(metrics_sql("SELECT value AS o, lag(value, 24) OVER (ORDER BY ts, event_id) AS p FROM events"))
def metrics_seasonal_naive(spark, d):
    df = LagFeatures("value", lags=[24], axis=EVENTS).fit_transform(table(spark, d, "events").select("event_id", "ts", "value"))
    return rounded(metrics.regression_metrics(df, "value", "value_lag24"))


_CV_SQL = f"""WITH e AS (SELECT hour(ts)::DOUBLE AS x, value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events),
f AS (SELECT k AS fold, k * (n // 5) AS lo, CASE WHEN k = 4 THEN n ELSE (k + 1) * (n // 5) END AS hi FROM (SELECT max(n) AS n FROM e), range(5) t(k)),
h AS (SELECT *, lo + (hi - lo - 10) // 2 AS mid FROM f),
m AS (SELECT fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM h JOIN e ON rn >= lo AND rn < mid GROUP BY fold),
p AS (SELECT h.fold, y AS o, a * x + b AS p FROM h JOIN m ON h.fold = m.fold JOIN e ON rn >= mid + 10 AND rn < hi),
s AS (SELECT fold, avg(abs(p - o)) AS mae, sqrt(avg((p - o) ** 2)) AS rmse, avg(p - o) AS bias FROM p GROUP BY fold)
SELECT fold::VARCHAR AS fold, {rs(['mae', 'rmse', 'bias'], 4)} FROM s
UNION ALL SELECT 'mean', {', '.join(r(f'avg({m})', 4) for m in ('mae', 'rmse', 'bias'))} FROM s
UNION ALL SELECT 'std', {', '.join(r(f'stddev_samp({m})', 4) for m in ('mae', 'rmse', 'bias'))} FROM s"""


@query(_CV_SQL)
def cv_report_linear(spark, d):
    from tidewater.models.registry import make_regressor

    df = table(spark, d, "events").select("event_id", "ts", "value", F.hour("ts").cast("double").alias("x"))
    cv = splits.BlockingTimeSeriesSplit(5, gap=10)
    return rounded(validation.cross_val_report(make_regressor("linear"), df, axis=EVENTS, features=["x"], target="value", cv=cv, metrics=["mae", "rmse", "bias"]), 4)


# --- models -------------------------------------------------------------------------------------------------------


@query(f"WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b FROM part) SELECT p_partkey, {r('a * p_size + b', 4)} AS prediction FROM part, m")
def linear_predict(spark, d):
    from tidewater.models.registry import make_regressor

    df = table(spark, d, "part")
    return rounded(make_regressor("linear").fit(df, ["p_size"], "p_retailprice").predict(df).select("p_partkey", "prediction"), 4)


_KNN_SQL = """WITH t AS (SELECT s_nationkey::DOUBLE AS a, s_acctbal AS y FROM supplier), q AS (SELECT c_custkey, c_nationkey::DOUBLE AS a FROM customer),
p AS (SELECT DISTINCT a FROM q), x AS (SELECT p.a, y, row_number() OVER (PARTITION BY p.a ORDER BY (p.a - t.a) ** 2, t.a, t.y) AS k FROM p, t)"""


@query(f"{_KNN_SQL} SELECT c_custkey, {r('any_value(m)', 4)} AS prediction FROM q JOIN (SELECT a, avg(y) AS m FROM x WHERE k <= 3 GROUP BY a) USING (a) GROUP BY c_custkey")
def knn_predict(spark, d):
    from tidewater.models.registry import make_regressor

    train = table(spark, d, "supplier").select(F.col("s_nationkey").cast("double").alias("a"), "s_acctbal")
    asked = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("a"))
    return rounded(make_regressor("knn", n_neighbors=3).fit(train, ["a"], "s_acctbal").predict(asked).select("c_custkey", "prediction"), 4)


@query(f"""WITH e AS (SELECT event_id, user_id, value, list(value) OVER w AS s, lead(value, 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lead(event_id, 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS there
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT event_id, len(s) AS n, {r('list_sum(s)')} AS total, {r('s[1] - s[5]')} AS fall, {r('nxt')} AS target_next FROM e WHERE len(s) = 5 AND there IS NOT NULL""")
def sequences(spark, d):
    from tidewater.models.neural import make_sequences

    df = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    made = make_sequences(df, USERS, ["value"], "value", window=5, horizon=2)
    cells = F.transform("sequence", lambda x: x[0])
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return rounded(made.select("event_id", F.size("sequence").cast("bigint").alias("n"), total.alias("total"), (cells[0] - cells[4]).alias("fall"), "target_next"))


# --- coordinates, stations, grids ---------------------------------------------------------------------------------

_DMS = "SELECT s_suppkey, s_nationkey || '°' || (s_suppkey % 60) || '''' || (s_suppkey % 59) || '.5\"' || CASE s_suppkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 's' WHEN 2 THEN 'W' ELSE 'E' END AS t FROM supplier"


@query(f"SELECT s_suppkey, {r('CASE WHEN s_suppkey % 4 IN (1, 2) THEN -1 ELSE 1 END * (s_nationkey + (s_suppkey % 60) / 60.0::DOUBLE + (s_suppkey % 59 + 0.5) / 3600.0::DOUBLE)')} AS dd FROM supplier")
def dms_parse(spark, d):
    k = F.col("s_suppkey")
    mark = F.when(k % 4 == 0, "N").when(k % 4 == 1, "s").when(k % 4 == 2, "W").otherwise("E")
    text = F.concat(F.col("s_nationkey").cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"), (k % 59).cast("string"), F.lit('.5"'), mark)
    return rounded(table(spark, d, "supplier").select("s_suppkey", geo.dms_to_dd(text).alias("dd")))


@query(r"SELECT p_partkey, trim(regexp_replace(' ' || p_name || ' / ' || p_brand || '?', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM part")
def safe_filename(spark, d):
    return table(spark, d, "part").select("p_partkey", geo.safe_filename(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("?"))).alias("name"))


def _stations(spark, d):
    return _stations_of(table(spark, d, "supplier"))


def _stations_of(suppliers):
    return suppliers.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("station_name"), ((F.col("s_suppkey") * 37) % 100 / 10.0).alias("station_lat"), ((F.col("s_suppkey") * 53) % 100 / 10.0).alias("station_lon"),
    )


_STATIONS_SQL = "SELECT 'S' || s_suppkey AS station_name, (s_suppkey * 37) % 100 / 10.0 AS station_lat, (s_suppkey * 53) % 100 / 10.0 AS station_lon FROM supplier"
_GRID_SQL = "SELECT ts AS time, (event_id % 11)::DOUBLE AS lat, (event_id % 13 * 0.75)::DOUBLE AS lon, value AS t2m FROM events"


def _grid(spark, d):
    return table(spark, d, "events").select(F.col("ts").alias("time"), (F.col("event_id") % 11).cast("double").alias("lat"), (F.col("event_id") % 13 * 0.75).cast("double").alias("lon"), F.col("value").alias("t2m"))


_CELLS_SQL = f"""WITH g AS ({_GRID_SQL}), s AS ({_STATIONS_SQL}),
a AS (SELECT station_name, arg_min(lat, (abs(lat - station_lat), lat)) AS cell_lat FROM s, (SELECT DISTINCT lat FROM g) GROUP BY ALL), o AS (SELECT station_name, arg_min(lon, (abs(lon - station_lon), lon)) AS cell_lon FROM s, (SELECT DISTINCT lon FROM g) GROUP BY ALL)"""


@query(f"{_CELLS_SQL} SELECT station_name, time AS timestamp, {r('t2m')} AS t2m FROM g JOIN a ON lat = cell_lat JOIN o USING (station_name) WHERE lon = cell_lon")
def grid_nearest(spark, d):
    return rounded(geo.sample_at_points(_grid(spark, d), _stations(spark, d)))


_MERGE_SQL = "SELECT 'U' || user_id AS station_name, date_trunc('day', ts) AS timestamp, {agg} FROM events WHERE event_type = '{t}' GROUP BY 1, 2"


@query(f"SELECT station_name, timestamp, {rs(['clicks', 'views'])} FROM ({_MERGE_SQL.format(agg='sum(value) AS clicks', t='click')}) FULL JOIN ({_MERGE_SQL.format(agg='avg(value) AS views', t='view')}) USING (station_name, timestamp)")
def station_merge(spark, d):
    def frame(kind, agg, name):
        rows = table(spark, d, "events").where(F.col("event_type") == kind)
        return rows.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("station_name"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp")).agg(agg("value").alias(name))

    views = frame("view", F.avg, "views").withColumn("clicks", F.lit(-1.0))
    return rounded(geo.merge_station_frames([frame("click", F.sum, "clicks"), views]))


@query(f"SELECT {r('max(station_lat) + 0.5')} AS north, {r('min(station_lon) - 0.5')} AS west, {r('min(station_lat) - 0.5')} AS south, {r('max(station_lon) + 0.5')} AS east FROM ({_STATIONS_SQL})")
def area_box(spark, d):
    return rounded(geo.expand_area(_stations(spark, d)))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t FROM orders")
def parse_times(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return df.select("o_orderkey", parsed_time(df, "t").cast("timestamp_ntz").alias("t"))


@query(f"SELECT {r('l_extendedprice')} AS l_extendedprice, l_orderkey, l_shipdate FROM lineitem WHERE l_discount > 0.05")
def projected_scan(spark, d):
    from tidewater.sources.tables import load_table

    df = load_table(spark, f"{d}/lineitem.parquet", columns=["l_extendedprice", "l_orderkey", "l_discount"], time_col="l_shipdate")
    return rounded(df.where("l_discount > 0.05").select("l_extendedprice", "l_orderkey", "l_shipdate"))


# --- data behind plots --------------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT min(value) AS a, max(value) AS z FROM events), e AS (SELECT least(coalesce(floor((value - a) / nullif((z - a) / 40, 0)), 0), 39) AS bin, a, (z - a) / 40 AS w FROM events, b)
SELECT 'value' AS "column", bin::BIGINT AS bin, {r('any_value(a) + bin * any_value(w)')} AS low, {r('any_value(a) + (bin + 1) * any_value(w)')} AS high, count(*) AS n FROM e GROUP BY bin""")
def histogram(spark, d):
    return rounded(plots.distributions(table(spark, d, "events"), ["value"]))


_FIVE = ", ".join(f"{r(x)} AS {n}" for n, x in (("low", "min({x})"), ("q1", "quantile_cont({x}, 0.25)"), ("median", "quantile_cont({x}, 0.5)"), ("q3", "quantile_cont({x}, 0.75)"), ("high", "max({x})"))) + ", count({x}) AS n"
for _by, _expr in (("hour", "hour(ts)"), ("dayofweek", "isodow(ts) - 1"), ("month", "month(ts)")):
    @query(f"SELECT ({_expr})::BIGINT AS {_by}, {_FIVE.format(x='value')} FROM events GROUP BY 1", f"seasonality_{_by}")
    def _seasonality(spark, d, by=_by):
        return rounded(plots.seasonality(table(spark, d, "events"), "ts", "value", by=by))


def box_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", {_FIVE.format(x=c)}, {r(f'min({c}) FILTER (WHERE {c} BETWEEN q[1] - 1.5 * (q[2] - q[1]) AND q[2] + 1.5 * (q[2] - q[1]))')} AS whisker_low, {r(f'max({c}) FILTER (WHERE {c} BETWEEN q[1] - 1.5 * (q[2] - q[1]) AND q[2] + 1.5 * (q[2] - q[1]))')} AS whisker_high FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem)"


@query(" UNION ALL ".join(box_sql(c) for c in _PRICED))
def boxplots(spark, d):
    return rounded(plots.boxplots(table(spark, d, "lineitem"), list(_PRICED)))


@query(f"WITH b AS (SELECT quantile_cont(value, [0.25, 0.75]) AS q FROM events) SELECT ts, {r('value')} AS value, (value < q[1] - 0.5 * (q[2] - q[1]) OR value > q[2] + 0.5 * (q[2] - q[1])) AS is_out FROM events, b")
def outlier_points(spark, d):
    df = table(spark, d, "events").select("ts", "value")
    handler = OutlierHandler("value", "iqr", iqr_factor=0.5).fit(df)
    return rounded(plots.outliers(df, "value", handler=handler, time="ts"))


@query(f"SELECT {r('p')} AS predicted, {r('o - p')} AS residual FROM ({_SCORED_SQL})")
def residuals(spark, d):
    return rounded(plots.residuals(_scored(spark, d), "o", "p")[0])


@query(f"SELECT ts, {r('value')} AS value FROM events")
def time_ordered(spark, d):
    return rounded(plots.timeseries(table(spark, d, "events").select("ts", "value"), "ts"))


@query(f"WITH i AS (SELECT * FROM (VALUES ('l_quantity', (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem)), ('l_discount', (SELECT abs(corr(l_discount, l_extendedprice)) FROM lineitem)), ('l_tax', (SELECT abs(corr(l_tax, l_extendedprice)) FROM lineitem))) v(feature, importance)) SELECT feature, {r('importance')} AS importance FROM i ORDER BY importance DESC, feature LIMIT 2")
def topk_importance(spark, d):
    from tidewater.models.interpret import importance_table

    df = table(spark, d, "lineitem")
    got = stats.correlations(df, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    return rounded(importance_table(df, {b: abs(x) for (a, b), x in got.items() if a == "l_extendedprice"}, top=2))


# --- recipes ------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {r('ln(value + 1000)')} AS log_value, " + ", ".join(f"(event_type = '{t}')::INT::DOUBLE AS is_{t}" for t in TYPES) + " FROM events WHERE NOT (hour(ts) BETWEEN 2 AND 4)")
def one_hot_log_target(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", (F.col("value") + 1000).alias("log_value"), F.hour("ts").alias("h"))
    df = recipes.log_column(recipes.exclude_between(df, "h", 2, 4), "log_value")
    return rounded(recipes.one_hot(df, "event_type", prefix="is").drop("event_type", "h"))


@query("SELECT 'customer' AS kind, c_custkey AS key, c_nationkey::BIGINT AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey::BIGINT FROM supplier")
def stacked_frames(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("nation"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_suppkey").alias("key"))
    return recipes.stack([a, b])


def flagship_steps() -> list:
    return [
        MissingValueHandler(list(TYPES), "interpolate", limit=3, axis=PANEL),
        OutlierHandler(list(TYPES), "iqr", "clip"),
        TemporalFeatures("hour"),
        Scaler(list(TYPES)),
    ]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hourly panel, short gaps interpolated, outliers clipped, calendar features, columns scaled."""
    return rounded(Pipeline(flagship_steps(), store=True).fit_transform(hourly_panel(spark, d)))


def _panel_steps_sql() -> tuple[str, str]:
    """Common table expressions of the panel after interpolation (i) and clipping (c), and the calendar fields of c."""
    one = lambda c: f"SELECT hour, {interpolated_sql(c, 3, t='epoch_us(hour)')} AS {c} FROM ({neighbours_sql(PANEL_SQL, c, 'hour', t='epoch_us(hour)')})"
    joined = " JOIN ".join(f"({one(c)}) t_{c}" + (" USING (hour)" if k else "") for k, c in enumerate(TYPES))
    b = ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS q_{c}" for c in TYPES)
    clip = ", ".join(f"CASE WHEN {c} < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) THEN q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) WHEN {c} > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]) THEN q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]) ELSE {c} END AS {c}" for c in TYPES)
    fields = ", ".join(f"({_FIELD_SQL[f].replace('(t', '(c.hour')})::BIGINT AS {f}" for f in ("dayofweek", "month", "dayofyear", "is_weekend"))
    cycles = ", ".join(_cycle_sql(f, "c.hour") for f in ("hour", "dayofweek", "month", "dayofyear"))
    return f"WITH i AS (SELECT hour, {', '.join(TYPES)} FROM {joined}), b AS (SELECT {b} FROM i), c AS (SELECT i.hour, {clip} FROM i, b)", f"hour(c.hour)::BIGINT AS hour, {fields}, {cycles}"


def clipped_panel_sql() -> str:
    """The panel interpolated, clipped and with calendar fields."""
    made, fields = _panel_steps_sql()
    return f"{made} SELECT {rs(TYPES)}, {fields} FROM c"


def _flagship_sql() -> str:
    made, fields = _panel_steps_sql()
    s = ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in TYPES)
    scaled = ", ".join(f"{r(f'({c} - a_{c}) / s_{c}')} AS {c}" for c in TYPES)
    return f"{made}, s AS (SELECT {s} FROM c) SELECT {scaled}, {fields} FROM c, s"


query(_flagship_sql(), "flagship")(flagship)


# --- rows only: iterative or learned, no SQL ------------------------------------------------------------------------


@query()
def iterative_impute(spark, d):
    return MissingValueHandler(list(TYPES), "iterative").fit_transform(gappy_panel(spark, d))


@query()
def isolation_flag(spark, d):
    step = OutlierHandler(["l_quantity", "l_extendedprice", "l_discount"], "isolation_forest", "flag", contamination=0.05)
    return step.fit_transform(spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")))


@query()
def nmf_factors(spark, d):
    from tidewater.models.nmf import NMFApportionment

    df = MissingValueHandler(list(TYPES), "mean").fit_transform(gappy_panel(spark, d))
    return NMFApportionment(2, columns=list(TYPES), max_iter=15).fit_transform(df)


@query()
def forest_predict(spark, d):
    from tidewater.models.registry import make_regressor

    df = spread(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    return make_regressor("random_forest", numTrees=20).fit(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").predict(df)


@query()
def permutation_importance(spark, d):
    from tidewater.models.interpret import permutation_importance_report
    from tidewater.models.registry import make_regressor

    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    model = make_regressor("linear").fit(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return permutation_importance_report(model, df, "l_extendedprice", n_repeats=2)


@query()
def tree_shap(spark, d):
    from tidewater.models.interpret import shap_importance, tree_shap_values
    from tidewater.models.registry import make_regressor

    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 10).cast("double").alias("digit"))
    model = make_regressor("gradient_boosting", maxIter=5).fit(df, ["p_size", "digit"], "p_retailprice")
    return shap_importance(tree_shap_values(model, df))


@query()
def forecast(spark, d):
    from tidewater.models.forecast import ProphetForecaster

    df = hourly_panel(spark, d).select(F.col("hour").alias("ds"), F.col("view").alias("y"))
    return ProphetForecaster().fit(df).predict(periods=48, freq="h")


@query()
def hybrid_forecast(spark, d):
    from tidewater.models.forecast import HybridProphetRegressor
    from tidewater.models.registry import make_regressor

    df = hourly_panel(spark, d).select(F.col("hour").alias("ds"), "click", "view", F.hour("hour").cast("double").alias("h")).na.drop()
    return HybridProphetRegressor(make_regressor("linear")).fit(df, ["click", "h"], "view").predict(df)


@query()
def network_predict(spark, d):
    from tidewater.models.registry import make_regressor

    df = MissingValueHandler(list(TYPES), "mean").fit_transform(hourly_panel(spark, d))
    return make_regressor("mlp", hidden=(16,), epochs=5, axis=PANEL).fit(df, ["click", "error", "purchase"], "view").predict(df)


import tidewater.plans.interfaces  # noqa: E402, F401  registers its queries
