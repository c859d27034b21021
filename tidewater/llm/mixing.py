"""Mixing sources to target weights.

Word budgets per source follow weights under a cap, the excess flowing to the others (water filling).
A source takes its documents whole: complete epochs first, then a fraction chosen by Efraimidis-Spirakis
sampling - exponential keys scaled by document quality, sorted within the source and prefix-summed up to
the rest of the budget.

No source is ever sorted in one task. Keys fall into ranges of equal ratio, as in a quantile sketch, so that ranges
fit keys of any quality; sums per (source, range) find the one range in which the budget ends. That range is cut
again, between its least and largest key, until it holds few documents, and only they are sorted. What follows for every
document is a comparison with two numbers of its source, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import WORD, broadcast_if_small, fresh, scratch

#: Ranges of the sampling key to a doubling, parts a range is cut into, documents of a source that may be sorted in a task.
RANGES, PARTS, EDGE_ROWS = 32, 1024, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(chars: Column, words: Column) -> Column:
    """Default quality: 1 at six characters a word, falling off with distance; 1 for a text without words."""
    ratio = chars.cast("double") / F.when(words > 0, words).cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.abs(ratio - 6.0) / 6.0), F.lit(1.0))


def sampling_key(ident: Column, quality: Column, seed: int) -> Column:
    """Exponential variate of rate ``quality``, drawn from a hash of the identifier: reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(uniform) / quality


def targets(sizes: DataFrame, weights: Sequence[float] | DataFrame, share: float, cap: float) -> DataFrame:
    """``source, source_size`` -> with ``target``: ``share`` of all words split by weight, at most ``cap`` sizes.

    ``weights`` is a cycle dealt to the sources by code point, null last, or a table ``source, weight``
    (sources that it lacks weigh 0). One row per source passes through one task, never a document.
    """
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        out = sizes.join(given, sizes["source"].eqNullSafe(given["_s"]), "left").drop("_s").na.fill(0.0, ["weight"])
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        out = sizes.withColumn("weight", F.get(cycle, rank % len(weights)))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy((F.col("_cap") / F.when(F.col("weight") > 0, F.col("weight"))).asc_nulls_first(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("_cap"))).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", F.try_divide(budget - before, rest))
    fits = (F.col("weight") > 0) & (F.col("_level") * F.col("weight") <= F.col("_cap"))
    out = out.withColumn("_level", F.max(F.when(fits, F.col("_level"))).over(everything))
    filled = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap"))
    return out.withColumn("target", F.when(F.col("weight") > 0, filled).otherwise(0.0)).drop("_cap", "_level", "weight")


def _edges(sums: DataFrame, goals: DataFrame) -> DataFrame:
    """The range of each source in which its budget ends: ``source, low, high, rows`` and what is ``left`` of the budget there.

    ``sums``: ``source, part, words, rows, low, high`` of every range; ``goals``: ``source, left``.
    """
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # bounded ranges, not documents
    summed = sums.withColumn("_end", F.sum("words").over(upto)).withColumnRenamed("source", "_s")
    found = broadcast_if_small(goals).join(summed, F.col("source").eqNullSafe(F.col("_s")))
    before = F.col("_end") - F.col("words")
    found = found.where((before <= F.col("left")) & (F.col("left") < F.col("_end")) & (F.col("left") > 0))
    return scratch(found.select("source", "low", "high", "rows", (F.col("left") - before).alias("left")), "mix-edges")


def _summed(keyed: DataFrame, part: Column) -> DataFrame:
    sums = [F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")]
    return scratch(keyed.groupBy("source", part.alias("part")).agg(*sums), "mix-ranges")


def allocate(keyed: DataFrame, weights: Sequence[float] | DataFrame, share: float, cap: float) -> DataFrame:
    """``source, size, key`` of every document -> one row per source.

    Columns: ``source, source_size, target, epochs``, ``low`` (keys below it are taken once more; null: none)
    and ``cutoff`` (so is the largest key up to this one; null: none).
    """
    ranges = _summed(keyed, F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * RANGES).cast("int"))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, cap)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    goal = goal.withColumn("epochs", whole.cast("bigint"))
    goal = scratch(goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    edge = _edges(ranges, goal.select("source", "left"))

    def inside() -> DataFrame:
        small = broadcast_if_small(edge).select(F.col("source").alias("_s"), F.col("low").alias("_low"), F.col("high").alias("_high"), "left")
        return keyed.join(small, F.col("source").eqNullSafe(F.col("_s")) & F.col("key").between(F.col("_low"), F.col("_high")))

    while edge.where((F.col("rows") > EDGE_ROWS) & (F.col("low") < F.col("high"))).limit(1).count():
        place = F.try_divide(F.col("key") - F.col("_low"), F.col("_high") - F.col("_low"))
        part = F.coalesce(F.least(F.floor(place * PARTS), F.lit(PARTS - 1)), F.lit(0)).cast("int")
        edge = _edges(_summed(inside(), part), edge.select("source", "left"))
    sums = inside().groupBy("source", "left", "key").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cutoff = (
        sums.withColumn("_middle", running - F.col("words") / 2.0).where(F.col("_middle") <= F.col("left"))
        .groupBy(F.col("source").alias("_s")).agg(F.max("key").alias("cutoff"))
    )
    ends = edge.select(F.col("source").alias("_t"), "low")
    out = goal.drop("left").join(ends, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    return scratch(out.join(cutoff, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Append ``source_size``, ``target`` and ``copies`` (times the document is taken) to keyed documents."""
    small = broadcast_if_small(plan).withColumnRenamed("source", "_s")
    last = (F.col("key") < F.col("low")) | F.coalesce(F.col("key") <= F.col("cutoff"), F.lit(False))
    extra = F.coalesce(last, F.lit(False)).cast("bigint")
    out = keyed.join(small, F.col("source").eqNullSafe(F.col("_s")))
    return out.withColumn("copies", F.col("epochs") + extra).drop("_s", "low", "cutoff", "epochs")


def measured(df: DataFrame, *held: Column, ident: str, source: str, text: str, quality: Column | None, seed: int) -> DataFrame:
    """``ident, source, size, key`` of every row, and what is ``held`` besides; stored."""
    size = word_count(F.col(text))
    out = df.select(*held, F.col(ident).alias("ident"), F.col(source).alias("source"), size.alias("size"), F.coalesce(F.length(text), F.lit(0)).alias("_c"), *([quality.alias("_q")] if quality is not None else []))
    good = F.col("_q").cast("double") if quality is not None else None
    given = F.when((good > 0) & ~F.isnan(good), good).otherwise(F.lit(1e-9)) if quality is not None else quality_weight(F.col("_c"), F.col("size"))
    return scratch(out.select(*["held"] * len(held), "ident", "source", "size", sampling_key(F.col("ident"), given, seed).alias("key")), "mix-keys")


def mix(
    df: DataFrame, *, weights: Sequence[float] | DataFrame = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    ident: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None, seed: int = 0,
) -> DataFrame:
    """One row per document: ``<ident>, size, source_size, target, taken``.

    ``size`` counts words (null text: 0); ``taken`` is ``size`` times the copies in the mix. A document at the
    end of the budget is taken when at least half of it fits. Null sources form a source of their own;
    null identifiers draw one common key; rows of equal key (repeated rows) are taken or left together. A
    quality that is null, NaN or not positive counts as 1e-9: such rows come last. A very long text is a row like any
    other; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    keyed = measured(df, ident=ident, source=source, text=text, quality=quality, seed=seed)
    out = copies(keyed, allocate(keyed, weights, share, cap))
    return out.select(F.col("ident").alias(ident), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(
    df: DataFrame, *, weights: Sequence[float] | DataFrame = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    ident: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None, seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken (0 to ``cap`` times).

    Documents without words are taken by the same rule. Columns stay as they are, whatever their names: rows are stored
    once beside their keys, so that words are counted once.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held")
    keyed = measured(df, held, ident=ident, source=source, text=text, quality=quality, seed=seed)
    out = copies(keyed, allocate(keyed.drop("held"), weights, share, cap)).where("copies > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("held.*")


#: DuckDB SQL of ``mix`` with the default parameters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars
  FROM documents
), k AS (
  SELECT doc_id, source, size::BIGINT AS size,
    -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / size::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE) ELSE 1.0::DOUBLE END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM k GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c
), m AS (
  SELECT *, max(CASE WHEN lev * w <= cap THEN lev END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM m
), g AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t
), p AS (
  SELECT k.*, g.source_size, g.target, g.epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(size) OVER (PARTITION BY k.source, key) / 2.0::DOUBLE AS middle
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
