"""Reading and writing tables by file suffix."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.core.columns import check_frame
from tidewater.core.errors import ColumnNotFoundError, MissingDependencyError, SchemaError

#: Format -> suffixes.
FORMATS = {
    "csv": (".csv", ".txt", ".tsv", ".dat"),
    "excel": (".xlsx", ".xls", ".xlsm", ".xlsb", ".ods"),
    "parquet": (".parquet", ".pq", ".parq"),
}


def format_of(path: str | os.PathLike) -> str:
    suffix = Path(str(path)).suffix.lower()
    for name, suffixes in FORMATS.items():
        if suffix in suffixes:
            return name
    raise SchemaError(f"unsupported suffix {suffix!r}; supported: {sorted(s for x in FORMATS.values() for s in x)}")


def require(package: str, purpose: str):
    """An optional package, or MissingDependencyError."""
    import importlib

    try:
        return importlib.import_module(package)
    except ImportError as why:
        raise MissingDependencyError(f"{purpose} needs the package {package!r}") from why


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_table(
    spark: SparkSession, path: str | os.PathLike, *, time_col: str | None = None, set_time_index: bool = False, sheet_name: int | str = 0,
    sep: str | None = None, columns: Sequence[str] | None = None, schema: T.StructType | str | None = None, **options,
) -> DataFrame:
    """A table by its suffix: delimited text, Excel (one sheet, on the driver) or Parquet.

    ``columns`` picks columns in that order, with ``time_col`` added last if it is not among them; Parquet reads no
    others. ``time_col`` is parsed, unparseable values becoming NULL; with ``set_time_index`` rows are sorted by
    it. Other options go to Spark's reader.
    """
    path = str(path)
    kind = format_of(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    wanted = list(columns) if columns is not None else None
    if wanted is not None and time_col and time_col not in wanted:
        wanted.append(time_col)
    if kind == "parquet":
        df = (spark.read.schema(schema) if schema else spark.read).options(**options).parquet(path)
    elif kind == "csv":
        reader = spark.read.option("header", True).option("sep", sep or ("\t" if path.lower().endswith(".tsv") else ",")).options(**options)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        pandas = require("pandas", "reading Excel files")
        try:
            sheet = pandas.read_excel(path, sheet_name=sheet_name, **options)
        except ImportError as why:
            raise MissingDependencyError("reading Excel files needs the package 'openpyxl' (or the format's own)") from why
        if isinstance(sheet, dict):
            raise SchemaError("sheet_name must name one sheet")
        df = spark.createDataFrame(sheet)
    if wanted is not None:
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise SchemaError(f"columns not found: {missing}; available: {df.columns}")
        df = df.select(*[F.col(f"`{c}`") for c in wanted])
    if time_col is not None:
        df = with_time(df, time_col)
    if set_time_index:
        if time_col is None:
            times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
            if not times:
                raise SchemaError("set_time_index needs time_col or a timestamp column")
            time_col = times[0]
        df = df.orderBy(F.col(f"`{time_col}`").asc_nulls_last())
    return df


def spread(df: DataFrame) -> DataFrame:
    """A plain scan whose files give fewer splits than there are cores, dealt out to all of them.

    For small tables ahead of work that costs more than moving them; a larger table is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_time(df: DataFrame, name: str) -> DataFrame:
    """Parse a time column in place; what cannot be parsed is NULL, and a number is no time."""
    if name not in df.columns:
        raise ColumnNotFoundError(f"column {name!r} not found; available: {df.columns}")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(name, F.try_to_timestamp(F.col(f"`{name}`")))
    if isinstance(kind, T.NumericType):
        raise SchemaError(f"{name!r} is numeric, not a time")
    return df


def save_table(df: DataFrame, path: str | os.PathLike, *, single_file: bool = False, mode: str = "overwrite", **options) -> str:
    """Write by suffix and return the path. The suffix is checked before anything is created.

    Spark writes a folder of parts; ``single_file`` renames the one part of a small table to ``path``.
    """
    path = str(path)
    kind = format_of(path)
    check_frame(df)
    if kind == "excel":
        require("openpyxl", "writing Excel files")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        df.toPandas().to_excel(path, index=False, **options)
        return path
    to = f"{path}.parts" if single_file else path
    writer = (df.coalesce(1) if single_file else df).write.mode(mode).options(**options)
    if kind == "csv":
        sep = options.get("sep") or ("\t" if path.lower().endswith(".tsv") else ",")
        writer.option("header", True).option("sep", sep).csv(to)
    else:
        writer.parquet(to)
    if single_file:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder, target = hadoop.Path(to), hadoop.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        fs.delete(target, True)
        fs.rename(part, target)
        fs.delete(folder, True)
    return path
