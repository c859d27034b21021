"""Connected components of link tables that no machine has to hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import scratch


class Forest:
    """Union-find whose roots are least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Links a task holds at a time while it thins them out, and links (counted) that one task may finish alone.
THIN_LINKS, ALONE_LINKS = 500_000, 100_000


def thinned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a task by a star for each of their components; connectivity stays."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_pydict({"a": [x for x, _ in pairs], "b": [r for _, r in pairs]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.up) > THIN_LINKS:
            yield stars()
            forest = Forest()
    yield stars()


def components(links: DataFrame, name: str, *, thin: bool = True) -> DataFrame:
    """``a, b`` links (long, in any order and number) -> ``node, root`` for every node that is not its root.

    At most ``ALONE_LINKS`` different links are joined up in one task. More go through alternating large-star and
    small-star steps (Kiveris et al. 2014) until all are stars; the root is the least member. Every step is aggregates and joins over stored tables; a node of many links is summed
    partially before it is shuffled.
    """
    edges = links.mapInArrow(thinned, "a bigint, b bigint") if thin else links
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch(edges, f"{name}-links")
    if edges.limit(ALONE_LINKS + 1).count() <= ALONE_LINKS:
        return scratch(edges.coalesce(1).mapInArrow(thinned, "a bigint, b bigint").select(F.col("a").alias("node"), F.col("b").alias("root")), f"{name}-alone")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # Stored first: both sides of the join are then plain exchanges, and a node of many links can be split.
        least = scratch(least, f"{name}-least")
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch(large, f"{name}-large")
        down = scratch(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-down")
        moved = large.join(down.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one root, and no root points on."""
    count, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    if count != nodes:
        return False
    roots = edges.select(F.col("v").alias("_v")).distinct()
    return not edges.join(roots, F.col("u") == F.col("_v"), "left_semi").limit(1).count()
