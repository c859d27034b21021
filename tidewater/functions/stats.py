"""Statistics over rows: correlations and average ranks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.core.axis import ROW, Axis, numbered
from tidewater.core.columns import number
from tidewater.core.errors import ConfigurationError
from tidewater.core.shared import scratch


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; NULL where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(x: Column, by: list | None = None) -> Column:
    """Rank from 1 of known values, ties sharing their mean rank, within ``by``."""
    by = by or []
    known = x.isNotNull()
    first = F.rank().over(Window.partitionBy(*by, known).orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.when(known, first + (ties - 1) / 2.0)


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> dict[tuple[str, str], float | None]:
    """Correlation of every pair of columns, pairwise complete; all pairs in one aggregate (Pearson, Spearman)."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ConfigurationError(f"unknown correlation {method!r}")
    pairs = list(combinations(columns, 2))
    if not pairs:
        return {}
    if method == "kendall":
        return {(a, b): kendall(df, a, b) for a, b in pairs}
    if method == "spearman":
        out = {}
        for a, b in pairs:  # ranks are among the rows where both are known
            known = df.select(number(df, a).alias("a"), number(df, b).alias("b")).where("a is not null and b is not null")
            ranked = global_ranks(global_ranks(known, "a", "ra"), "b", "rb")
            out[a, b] = ranked.agg(pearson(F.col("ra"), F.col("rb"))).first()[0]
        return out
    row = df.agg(*[pearson(number(df, a), number(df, b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    return {p: row[k] for k, p in enumerate(pairs)}


#: Distinct value pairs to a block of Kendall's count (at least), and blocks to a side of its grid (at most).
KENDALL_ROWS, KENDALL_SIDE = 100_000, 1_000


def _inversions(order: np.ndarray, value: np.ndarray, weight: np.ndarray) -> float:
    """Weight of pairs with ``order`` ascending and ``value`` descending: by the highest bit of the value's rank in
    which they differ, so that every bit is one running sum."""
    by_value = np.lexsort((order, value))
    rank = np.empty(len(value), np.int64)
    rank[by_value] = np.arange(len(value))
    seq = np.lexsort((value, order))
    rank, weight, total = rank[seq], weight[seq], 0.0
    for bit in range(max(len(rank) - 1, 0).bit_length() - 1, -1, -1):
        upper = (rank >> bit) & 1 == 1
        before = np.concatenate(([0.0], np.cumsum(np.where(upper, weight, 0.0))))
        group = rank >> (bit + 1)
        begins = np.searchsorted(group, group)  # groups are contiguous and ascend
        total += float((weight * (before[:-1] - before[begins]))[~upper].sum())
        again = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[again], weight[again]
    return total


def _discordant(cells: DataFrame) -> float:
    """Weight of pairs of cells (a, b, n) that a and b order in opposite ways.

    Cells get their places i by (a, b) and j by (b, a); ties are then no inversions and both places are permutations,
    so blocks of places have one size whatever values are frequent. Pairs within a block of i, and pairs within
    a block of j from different blocks of i, are counted in the blocks' own tasks; the rest follow from the grid of the blocks'
    weights, whose size is bounded.
    """
    first = numbered(cells, Axis("a", tie="b")).withColumnRenamed(ROW, "i")
    placed = numbered(first, Axis("b", tie="a")).withColumnRenamed(ROW, "j")
    size = max(KENDALL_ROWS, -(-placed.count() // KENDALL_SIDE))
    weight = F.col("n").cast("double").alias("w")
    placed = placed.select("i", "j", weight, F.floor(F.col("i") / size).alias("p"), F.floor(F.col("j") / size).alias("q"))
    views = F.array(
        F.struct(F.lit(0).alias("side"), F.col("p").alias("block"), F.col("i").alias("order")),
        F.struct(F.lit(1).alias("side"), F.col("q").alias("block"), F.col("p").alias("order")),
    )
    dealt = placed.select(F.explode(views).alias("view"), F.col("j").alias("value"), "w").select("view.*", "value", "w")

    def count(part):
        return pd.DataFrame({"w": [_inversions(*(part[c].to_numpy() for c in ("order", "value", "w")))]})

    inside = dealt.groupBy("side", "block").applyInPandas(count, "w double").agg(F.sum("w")).first()[0] or 0.0
    grid = placed.groupBy("p", "q").agg(F.sum("w").alias("w")).toPandas()  # at most KENDALL_SIDE squared cells
    if grid.empty:
        return inside
    table = np.zeros((int(grid["p"].max()) + 1, int(grid["q"].max()) + 1))
    table[grid["p"], grid["q"]] = grid["w"]
    lower = np.zeros_like(table)  # weight of earlier blocks of i with later blocks of j
    lower[1:, :-1] = np.cumsum(np.cumsum(table[:, ::-1], 1)[:, ::-1], 0)[:-1, 1:]
    return inside + float((table * lower).sum())


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall's tau-b over the rows where both are known; NULL where a side is constant.

    Equal pairs are counted first; discordant ones are counted in blocks (``_discordant``), so no row meets all others.
    """
    known = df.select(number(df, a).alias("a"), number(df, b).alias("b")).where("a is not null and b is not null")
    cells = scratch(known.groupBy("a", "b").agg(F.count("*").alias("n")), "kendall")
    n = F.col("n").cast("decimal(19,0)")
    pairs = lambda frame: frame.agg(F.sum((n * (n - 1)).cast("double"))).first()[0] or 0.0
    every = pairs(cells.agg(F.sum("n").alias("n")))
    same_a, same_b = (pairs(cells.groupBy(c).agg(F.sum("n").alias("n"))) for c in ("a", "b"))
    if every <= same_a or every <= same_b:
        return None
    return (every - same_a - same_b + pairs(cells) - 4 * _discordant(cells)) / ((every - same_a) * (every - same_b)) ** 0.5


def correlation_table(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Long form of the matrix: ``a, b, r`` for each pair of columns in order."""
    found = correlations(df, columns, method)
    return df.sparkSession.createDataFrame([(a, b, r) for (a, b), r in found.items()], "a string, b string, r double")


def global_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Append average ranks over the whole frame without one task that sorts it all.

    Values are counted, range-partitioned and summed up within each partition; the partitions' totals (one
    number each) go to the driver and come back as offsets.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    placed = scratch(counts.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()), "ranks")  # ranges are sampled: fix them
    before, offset = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("__part").agg(F.sum("__n")).collect())):  # one row for each partition
        offset += [F.lit(part), F.lit(before)]
        before += n
    start = F.create_map(*offset)[F.col("__part")] if offset else F.lit(0)
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = placed.select("__v", (start + upto - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")
