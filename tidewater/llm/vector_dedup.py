"""Embedding near-dedup by sorted projection passes.

In every pass the vectors get a key of concatenated random hashes (signs of projections on random
hyperplanes), are ordered lexicographically by it, and each is compared with a bounded window of followers.
What is ordered are keys and identifiers, not vectors: keys that differ in more bits than a pair of the wanted
cosine would are no candidates, and of the others the nearest followers are verified by the cosine of their
vectors in double precision. Verified pairs are united across passes. Equal vectors are one node, so a vector that a
third of all rows share is compared once.

The first passes unite crowds; later ones look for pairs that are not connected yet, so that a crowd is not verified over
and over. Rows are dealt by ranges of (pass, key, hash of pass and id), so no key is too frequent and vectors of one key
meet others in every pass; a pair that a range border or a pass parts is met in another pass. The number of passes
follows from the number of vectors. Then all vectors of a component are compared in square tiles, which are counted
and not stored, so links within a component are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidewater.llm import kernels
from tidewater.llm.common import scratch
from tidewater.llm.components import components

#: Followers each key is compared with, vectors compared at a time, vectors to a side of a tile (about).
WINDOW, BLOCK, TILE = 64, 256, 1024

#: Bits of a key: 48 of them follow the pass and a code of the vector's length in one number, 64 are another.
HEAD_BITS, KEY_BITS = 48, 112

#: Passes that unite crowds, nearest followers verified in these and in later passes, chance to miss a pair at the threshold.
FIRST, NEAREST, MISS = 3, (1, 2), 0.002

_HEAD = np.uint64((1 << HEAD_BITS) - 1)


def differing(least: float) -> float:
    """Share of hash bits in which vectors of cosine ``least`` differ."""
    return math.acos(least) / math.pi


def passes_needed(n: int, least: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has met with a chance of 1 - ``miss``, in a pass if the bits that
    order ``n`` keys down to a window agree."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    meet = (1 - differing(least)) ** bits
    return min(1000, max(12, math.ceil(math.log(miss) / math.log1p(-min(meet, 0.5)))))


def most_differing(least: float) -> int:
    """Bits in which keys of a pair may differ: three standard deviations more than expected at the threshold."""
    p = differing(least)
    return math.ceil(KEY_BITS * p + 3 * math.sqrt(KEY_BITS * p * (1 - p)))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keys(batches: Iterable[pa.RecordBatch], passes: range, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, label, dim, vector) -> a row for each pass with its key; hyperplanes are the same on every executor."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = _matrix(part.column(3), dim)
            x = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32)
            for k in passes:
                if (dim, k) not in planes:
                    planes[dim, k] = np.random.default_rng([seed, dim, k]).standard_normal((dim, KEY_BITS)).astype(np.float32)
                bits = np.packbits(x @ planes[dim, k] > 0, axis=1)
                wide = np.zeros((len(x), 16), np.uint8)
                wide[:, 2:] = bits
                key = wide.view(">u8").astype(np.uint64)
                head = key[:, 0] | np.uint64(((k << 6) | (dim * 37 % 64)) << HEAD_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(key[:, 1].view(np.int64)), part.column(0), part.column(1)], names=["head", "tail", "node", "label"])


def _candidates(batches: Iterable[pa.RecordBatch], window: int, most: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys -> for each the nearest of its followers within the window that it is not connected with."""
    held = np.zeros((4, 0), np.int64)
    for batch in batches:
        rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), 1)
        head, tail, node, label = rows[0].view(np.uint64), rows[1].view(np.uint64), rows[2], rows[3]
        done, n = held.shape[1], rows.shape[1]
        best = np.full((nearest, n), 1 << 40, np.int64)
        for d in range(1, min(window, n - 1) + 1):
            low = max(0, done - d)  # pairs among rows held from the batch before are known
            x = head[low : n - d] ^ head[low + d :]
            apart = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(tail[low : n - d] ^ tail[low + d :])
            good = (x <= _HEAD) & (apart <= most) & (label[low : n - d] != label[low + d :])
            new = np.where(good, (apart << 20) | d, 1 << 40)
            for rank in best:
                worse = np.maximum(rank[low : n - d], new)
                rank[low : n - d] = np.minimum(rank[low : n - d], new)
                new = worse
        rank, i = np.nonzero(best < 1 << 40)
        j = i + (best[rank, i] & ((1 << 20) - 1))
        pairs = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), 1), axis=0)
        held = rows[:, max(0, n - window) :]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _alike(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs with their vectors (a, b, dim, one, other) -> pairs whose cosine is at least ``least``."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x, y = _matrix(part.column(3), dim), _matrix(part.column(4), dim)
            size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
            near = pa.array(np.einsum("ij,ij->i", x, y) / size >= least)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near)], names=["a", "b"])


def _links(heads: DataFrame, labels: DataFrame | None, passes: range, nearest: int, least: float, window: int, seed: int, name: str) -> DataFrame:
    """Verified pairs ``a < b`` of some passes between vectors of different labels."""
    rows = heads.select("node", "dim", "vector")
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        of = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        rows = rows.join(of, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_r", "node"))
    keyed = rows.select("node", "label", "dim", "vector").mapInArrow(lambda it: kernels.tidy(_keys(it, passes, seed)), "head bigint, tail bigint, node bigint, label bigint")
    order, most = ["head", "tail", F.xxhash64("head", "node"), "node"], most_differing(least)
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = ordered.mapInArrow(lambda it: kernels.tidy(_candidates(it, window, most, nearest)), "a bigint, b bigint").where("a <> b").distinct()
    pairs = scratch(pairs, f"vectors-{name}-candidates")
    one, other = heads.select(F.col("node").alias("_a"), "dim", F.col("vector").alias("one")), heads.select(F.col("node").alias("_b"), F.col("dim").alias("_d"), F.col("vector").alias("other"))
    both = pairs.join(one, F.col("a") == F.col("_a")).join(other, (F.col("b") == F.col("_b")) & (F.col("dim") == F.col("_d")))
    checked = both.select("a", "b", "dim", "one", "other").mapInArrow(lambda it: kernels.tidy(_alike(it, least)), "a bigint, b bigint")
    return scratch(checked, f"vectors-{name}")


def _shares(rows: list[pa.RecordBatch], whole: bool, least: float) -> pa.RecordBatch:
    """Linked copies of each vector of a tile: of all its vectors with each other, or of its sides."""
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    side, nodes, copies = (batch.column(k).to_numpy() for k in (3, 4, 6))
    x = _matrix(batch.column(7), batch.column(5)[0].as_py())
    size, copies, out = np.sqrt(np.einsum("ij,ij->i", x, x)), copies.astype(np.float64), np.zeros(len(x))
    left, right = (np.arange(len(x)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for low in range(0, len(left), BLOCK):
        rows_of = left[low : low + BLOCK]
        cosine = (x[rows_of] @ x[right].T) / (size[rows_of, None] * size[None, right])
        near = cosine >= least + 1e-9
        i, j = np.nonzero(np.abs(cosine - least) < 1e-9)
        a, b = rows_of[i], right[j]
        near[i, j] = np.einsum("ij,ij->i", x[a], x[b]) / (size[a] * size[b]) >= least
        if whole:
            near &= rows_of[:, None] != right[None, :]
        else:
            out[right] += copies[rows_of] @ near
        out[rows_of] += near @ copies[right]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(out.astype(np.int64))], names=["node", "others"])


def _tiles(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile (root, low, high) -> linked copies of each vector within each tile."""
    at, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and at != tuple(keys[a]):
                yield _shares(held, at[1] == at[2], least)
                held = []
            at = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield _shares(held, at[1] == at[2], least)


def _completed(tree: DataFrame, heads: DataFrame, sizes: DataFrame, least: float, tile: int) -> DataFrame:
    """``a, others``: copies of other vectors that a vector links with, exact within every component."""
    roots = tree.select(F.col("root").alias("node"), "root").distinct()
    members = scratch(tree.select("node", "root").unionByName(roots), "vectors-members")
    parts = scratch(members.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "vectors-parts")
    part = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("parts")).cast("int")
    crowd = members.join(parts, F.col("root") == F.col("_r")).select("node", "root", "parts", part.alias("part"))
    crowd = crowd.join(sizes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    crowd = crowd.join(heads.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    spread = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    side = (F.col("part") > F.col("other")).cast("int").alias("side")
    dealt = spread.select("root", low, high, side, "node", "dim", "copies", "vector").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    counted = dealt.mapInArrow(lambda it: kernels.tidy(_tiles(it, least)), "node bigint, others bigint")
    return counted.groupBy(F.col("node").alias("a")).agg(F.sum("others").alias("others"))


def usable(vector):
    """Vectors that can be compared: not null, not empty, finite throughout, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(
    df: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9,
    passes: int | None = None, window: int = WINDOW, seed: int = 7, tile: int = TILE,
) -> DataFrame:
    """One row per vector: ``<ident>, n_links, component_id, kept``.

    ``n_links`` counts other vectors with a cosine of ``least`` or more, equal ones included, and leaves out none
    of its component; ``component_id`` is the smallest identifier reachable by links, ``kept`` marks it. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; neither do vectors of different
    length. Rows without an identifier link with nothing, keep a null ``component_id`` and are not kept. Rows
    of one identifier are separate vectors that share a component. Components of single precision are kept in it, all
    others become doubles. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    rows = df.select(F.col(ident).cast("bigint").alias("ident"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("ident").isNotNull())
    same = F.when(F.col("ok"), F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))  # no negative zeros
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64(F.lit(1), same)), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(2), same))})
    keys = scratch(rows.select("ident", "h1", "h2"), "vectors-keys")
    classes = keys.where("h1 is not null").groupBy("h1", "h2").agg(F.min("ident").alias("node"), F.count("*").alias("copies"))
    classes = scratch(classes, "vectors-classes")
    mine = classes.withColumnsRenamed({"h1": "_1", "h2": "_2"})
    heads = rows.where("ok").join(mine, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & (F.col("ident") == F.col("node")))
    heads = scratch(heads.groupBy("node", "h1", "h2").agg(F.first("vector").alias("vector")).select("node", F.size("vector").alias("dim"), "vector"), "vectors-heads")
    passes = passes_needed(heads.count(), least, window) if passes is None else passes
    first = min(FIRST, passes)
    links = _links(heads, None, range(first), NEAREST[0], least, window, seed, "first")
    if passes > first:
        links = links.unionByName(_links(heads, components(links, "vectors-first"), range(first, passes), NEAREST[1], least, window, seed, "later"))
    tree = components(links, "vectors")
    sizes = classes.groupBy("node").agg(F.sum("copies").alias("copies"))
    linked = _completed(tree, heads, sizes, least, tile)
    stats = sizes.join(linked, F.col("node") == F.col("a"), "left").join(tree.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    stats = scratch(stats.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")), "vectors-stats")
    of = mine.select("_1", "_2", "node").join(stats.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("_1", "_2", "n_links", "component_id")
    of = scratch(of, "vectors-of")
    out = keys.join(of, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    component = F.coalesce("component_id", "ident")
    return out.select(
        F.col("ident").alias(ident), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("ident"), F.lit(False)).alias("kept"),
    )
