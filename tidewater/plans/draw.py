"""Figures from the frames of ``tidewater.plans.plots``. Needs the optional package matplotlib.

Each function draws on ``ax`` (a new figure's if none is given) and returns it. Only plot data reaches the
driver: bins, quartiles, matrices. Beyond ``POINTS`` rows a scatter or a series shows one row of each cell of a grid that
holds any, so that a lone point is always drawn, and the matrix of missing cells shows shares of successive rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.core.errors import ConfigurationError
from tidewater.models.interpret import extract_importances
from tidewater.plans import plots
from tidewater.sources.tables import require

#: Rows that a figure shows singly; cells to a side of the grid that thins more of them out.
POINTS, SIDE = 20_000, 200

#: A palette that colour-blind readers can tell apart (Okabe & Ito).
PALETTE = ("#0072B2", "#E69F00", "#009E73", "#D55E00", "#56B4E9", "#CC79A7", "#F0E442", "#000000")

STYLE = {"axes.spines.top": False, "axes.spines.right": False, "axes.grid": True, "grid.alpha": 0.3, "savefig.dpi": 150, "figure.autolayout": True}


def set_style(**more) -> None:
    """Use the library's look from now on."""
    mpl = require("matplotlib", "drawing")
    mpl.rcParams.update({**STYLE, "axes.prop_cycle": mpl.cycler(color=PALETTE), **more})


@contextmanager
def style(**more) -> Iterator[None]:
    """Use the library's look inside a ``with`` block."""
    mpl = require("matplotlib", "drawing")
    with mpl.rc_context():
        set_style(**more)
        yield


def _axes(ax):
    if ax is not None:
        return ax
    require("matplotlib", "drawing")
    return require("matplotlib.pyplot", "drawing").subplots()[1]


def _place(df: DataFrame, name: str):
    """The column as a number: of a time, its seconds."""
    kind = df.schema[name].dataType
    return (F.col(name).cast("timestamp") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(name)).cast("double")


def _some(df: DataFrame, x: str, y: str):
    """``x`` and ``y`` as pandas: all rows, or beyond ``POINTS`` of them one of each cell of a ``SIDE`` by ``SIDE`` grid that holds any."""
    rows = df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"))
    if rows.limit(POINTS + 1).count() <= POINTS:
        return rows.toPandas().set_axis([x, y], axis=1)
    at = {"__x": _place(rows, "x"), "__y": _place(rows, "y")}
    ends = rows.select(*[c.alias(n) for n, c in at.items()]).agg(*[f(F.nanvl(n, F.lit(None))).alias(f"{f.__name__}{n}") for n in at for f in (F.min, F.max)]).first()
    cells = []
    for n, c in at.items():
        low, high = ends[f"min{n}"], ends[f"max{n}"]
        width = (high - low) / SIDE if low is not None else 0
        cells.append((F.least(F.floor((c - low) / width), F.lit(SIDE - 1)) if width else F.lit(0)).alias(n))
    shown = rows.groupBy(*cells).agg(F.min(F.struct(F.xxhash64("x", "y").alias("hash"), "x", "y")).alias("row"))
    return shown.select("row.x", "row.y").toPandas().set_axis([x, y], axis=1)


def _shares(df: DataFrame):
    """Share of missing cells in successive rows, so many of them that about ``POINTS`` shares are left (and one for each partition)."""
    step = -(-df.count() // POINTS) or 1
    at = F.monotonically_increasing_id()
    blocks = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(df.columns)], at.alias("at"))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    shares = blocks.groupBy(part.alias("part"), F.floor(row / step).alias("block")).agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(len(df.columns))])
    return shares.orderBy("part", "block").drop("part", "block").toDF(*df.columns).toPandas()


def plot_missingness(df: DataFrame, columns: Sequence[str] | None = None, *, kind: str = "bar", ax=None):
    ax = _axes(ax)
    data = plots.missingness(df, columns, kind=kind)
    if kind == "bar":
        got = data.toPandas()
        ax.barh(got["column"], 100 * got["fraction"])
        ax.set_xlabel("missing, %")
    else:
        got = _shares(data)
        ax.imshow(got.to_numpy(float), aspect="auto", interpolation="nearest", cmap="Greys")
        ax.set_xticks(range(len(got.columns)), list(got.columns))
    return ax


def plot_distribution(df: DataFrame, column: str, *, bins: int = 40, kde: bool = True, ax=None):
    ax = _axes(ax)
    got = plots.distributions(df, [column], bins=bins).toPandas()
    width = (got["high"] - got["low"]).fillna(1.0)
    ax.bar(got["low"], got["n"] / (got["n"].sum() * width), width=width, align="edge", alpha=0.6)
    if kde:
        line = plots.density(df, column).toPandas()
        ax.plot(line["x"], line["density"])
    ax.set_xlabel(column)
    return ax


def plot_correlation(df: DataFrame, columns: Sequence[str] | None = None, *, method: str = "pearson", cluster: bool = False, annot: bool = False, ax=None):
    ax = _axes(ax)
    got = plots.correlation(df, columns, method=method, cluster=cluster).toPandas()
    names = list(dict.fromkeys([*got["a"], *got["b"]]))
    matrix = [[1.0 if a == b else None for b in names] for a in names]
    for a, b, r in got.itertuples(index=False):
        i, j = names.index(a), names.index(b)
        matrix[i][j] = matrix[j][i] = r
    cells = [[float("nan") if r is None else r for r in row] for row in matrix]
    ax.imshow(cells, vmin=-1, vmax=1, cmap="RdBu_r")
    ax.set_xticks(range(len(names)), names, rotation=90)
    ax.set_yticks(range(len(names)), names)
    if annot:
        for i, row in enumerate(cells):
            for j, r in enumerate(row):
                ax.text(j, i, f"{r:.2f}", ha="center", va="center")
    return ax


def plot_timeseries(df: DataFrame, time: str, columns: Sequence[str] | None = None, *, ax=None):
    ax = _axes(ax)
    rows = plots.timeseries(df, time, columns)
    for c in rows.columns:
        if c != time:
            got = _some(rows, time, c).sort_values(time)
            ax.plot(got[time], got[c], label=c)
    ax.legend()
    return ax


def _boxes(ax, got, labels, low: str, high: str) -> None:
    ax.bxp([{"label": str(n), "whislo": r[low], "q1": r["q1"], "med": r["median"], "q3": r["q3"], "whishi": r[high]} for n, (_, r) in zip(labels, got.iterrows())], showfliers=False)


def plot_seasonality(df: DataFrame, time: str, column: str, *, by: str = "hour", ax=None):
    ax = _axes(ax)
    got = plots.seasonality(df, time, column, by=by).toPandas()
    _boxes(ax, got, got[by], "low", "high")
    ax.set(xlabel=by, ylabel=column)
    return ax


def plot_boxplots(df: DataFrame, columns: Sequence[str] | None = None, *, ax=None):
    ax = _axes(ax)
    got = plots.boxplots(df, columns).toPandas()
    _boxes(ax, got, got["column"], "whisker_low", "whisker_high")
    return ax


def plot_outliers(df: DataFrame, column: str, time: str, *, bounds=None, handler=None, ax=None):
    ax = _axes(ax)
    rows = plots.outliers(df, column, bounds=bounds, handler=handler, time=time)
    kept, out = _some(rows.where("not is_out"), time, column).sort_values(time), _some(rows.where("is_out"), time, column)
    ax.plot(kept[time], kept[column], ".", markersize=2)
    ax.plot(out[time], out[column], "x", color=PALETTE[3], label="outlier")
    ax.set_ylabel(column)
    return ax


def plot_predictions(df: DataFrame, observed: str, predicted: str, *, kind: str = "scatter", time: str | None = None, ax=None):
    if kind not in ("scatter", "timeseries") or kind == "timeseries" and time is None:
        raise ConfigurationError("kind is 'scatter', or 'timeseries' with a time column")
    ax = _axes(ax)
    pairs, r2 = plots.predictions(df, observed, predicted, time=time)
    fit = r2.first()
    if kind == "scatter":
        got = _some(pairs, "observed", "predicted")
        ax.plot(got["observed"], got["predicted"], ".", markersize=3)
        ends = [got[["observed", "predicted"]].min().min(), got[["observed", "predicted"]].max().max()]
        ax.plot(ends, ends, color=PALETTE[7], linewidth=1)
        ax.set(xlabel="observed", ylabel="predicted")
    else:
        for c in ("observed", "predicted"):
            got = _some(pairs, time, c).sort_values(time)
            ax.plot(got[time], got[c], label=c)
        ax.legend()
    ax.set_title("R2 undefined" if fit is None or fit.r2 is None else f"R2 = {fit.r2:.3f}")
    return ax


def plot_residuals(df: DataFrame, observed: str, predicted: str, *, ax=None):
    ax = _axes(ax)
    got = _some(plots.residuals(df, observed, predicted)[0], "predicted", "residual")
    ax.plot(got["predicted"], got["residual"], ".", markersize=3)
    ax.axhline(0.0, color=PALETTE[7], linewidth=1)
    ax.set(xlabel="predicted", ylabel="observed - predicted")
    return ax


def plot_feature_importance(model, *, top_n: int = 20, names: Sequence[str] | None = None, ax=None):
    ax = _axes(ax)
    top = sorted(extract_importances(model, names).items(), key=lambda x: (-x[1], x[0]))[:top_n]
    ax.barh([n for n, _ in top][::-1], [x for _, x in top][::-1])
    return ax
