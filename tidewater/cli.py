"""Command line: ``preprocess INPUT OUTPUT`` and ``info``."""

from __future__ import annotations

import argparse
import importlib.util
import json
from collections.abc import Sequence
from pathlib import Path

from tidewater import __version__

OPTIONAL = ("cdsapi", "cfgrib", "holidays", "openpyxl", "xgboost")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewater", description="Time-series preprocessing on Spark.")
    top.add_argument("--version", action="version", version=f"tidewater {__version__}")
    commands = top.add_subparsers(dest="command")
    commands.add_parser("info", help="version and optional packages")
    run = commands.add_parser("preprocess", help="clean a table and add features")
    run.add_argument("input")
    run.add_argument("output")
    run.add_argument("--config", type=Path, help='JSON: a list of steps, or {"steps": [...]}')
    run.add_argument("--time-col", help="time column")
    run.add_argument("--set-time-index", action="store_true", help="sort by the time column")
    return top


def default_steps(axis):
    """Interpolate short gaps, clip outliers, add calendar features."""
    from tidewater.operators import MissingValueHandler, OutlierHandler, TemporalFeatures

    return [MissingValueHandler(strategy="interpolate", limit=3, axis=axis), OutlierHandler(method="iqr", strategy="clip", axis=axis), TemporalFeatures(axis.time)]


def preprocess(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import types as T

    from tidewater.core.axis import Axis
    from tidewater.core.errors import ConfigurationError
    from tidewater.core.step import Pipeline
    from tidewater.sources.tables import load_table, save_table

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("tidewater").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = load_table(spark, args.input, time_col=args.time_col, set_time_index=args.set_time_index)
    time = args.time_col or next((f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))), None)
    if args.config:
        given = json.loads(args.config.read_text(encoding="utf-8"))
        pipe = Pipeline.from_config(given["steps"] if isinstance(given, dict) else given)
        for _, step in pipe.steps:
            if getattr(step, "axis", "") is None and time:
                step.axis = Axis(time)
    elif time is None:
        raise ConfigurationError("the table has no time column: pass --time-col or --config")
    else:
        pipe = Pipeline(default_steps(Axis(time)))
    out = pipe.fit_transform(df)
    where = save_table(out, args.output)
    print(f"wrote {len(out.columns)} columns to {where}")
    return 0


def info() -> int:
    print(f"tidewater {__version__}")
    for name in OPTIONAL:
        print(f"  {name}: {'installed' if importlib.util.find_spec(name) else 'missing'}")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "info":
        return info()
    if args.command == "preprocess":
        return preprocess(args)
    top.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
