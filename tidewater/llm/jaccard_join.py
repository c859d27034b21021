"""N-gram Jaccard join over whole texts.

1. A document becomes its set of hashed five-word shingles; equal sets are one node.
2. Candidates by prefix filter: two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of
   each in any common order. Rare shingles come first: how many nodes hold a shingle is counted for all
   shingles of one hash region, and what only one node holds needs no partner. Holders of a shingle are not
   linked if their sizes, or the shingle's place in their sets, rule each other out. Only packed lists move.
   Groups beyond one tile are grouped again with all their shingles counted: passages that many texts have
   in common then no longer hold them together.
3. Nodes that share a prefix shingle fall into groups; a group's texts meet in tiles of bounded size, ordered
   by set size. In a tile, sizes and hashed bitmaps (set bits of one that the other lacks) bound the overlap
   from above; what is left is decided by exact intersection of sorted arrays. Pairs that links already
   connect are not compared.
4. Groups beyond one tile are compared tile by tile with a hub first; tiles whose nodes all hang together by
   then are not paired at all, the others are paired within size bands. Nothing is capped.

Shingles are compared by 61 bits (a polynomial modulo 2^61 - 1 at a base drawn for the query), whole sets by 125 bits.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import kernels
from tidewater.llm.common import broadcast_if_small, prime_below, range_count, scratch
from tidewater.llm.components import components, thinned

#: Words to a shingle; similarity as a fraction; nodes to a tile; bits to a bitmap.
SHINGLE, NUM, DEN, TILE, BITS = 5, 75, 100, 1000, 1024

#: Shingles that count as one node of a tile: a tile of long texts holds fewer of them.
NODE_SHINGLES = 1000

#: Share of hash space whose shingles are counted: the prefix share and some room.
REGION = np.uint64(int((1 - NUM / DEN + 0.06) * 2**64))

#: All of hash space.
WHOLE = np.uint64(2**64 - 1)


def prefix(n):
    """Length of the prefix of a set of n."""
    return n + (-NUM * n) // DEN + 1


#: Different sets under one 64-bit identity that are told apart; (number of nodes)^2 / 2^65 are expected.
CLASHES = 10_000


class Naming:
    """Sets of shingles and their identities under one salt; what any Python worker needs for either."""

    def __init__(self, salt: int, bits: int = 64, clashes: frozenset[int] = frozenset()):
        self.salt, self.clashes, self.bits = salt, clashes, bits

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text (A-Z folded)."""
        return kernels.hashing(self.salt).shingle_sets(texts, SHINGLE, lower=True)

    def node(self, shingles: np.ndarray) -> int:
        """64-bit identity of a set, the same whatever made it."""
        once = kernels.mixed(shingles + np.uint64(len(shingles)))
        node = self._digest(once) >> (64 - self.bits)
        return self._twin(once) if node in self.clashes else node

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        """Two independent digests of a set, of ``bits`` and of 64 bits."""
        once = kernels.mixed(shingles + np.uint64(len(shingles)))
        return self._digest(once) >> (64 - self.bits), self._twin(once)

    def _digest(self, once: np.ndarray) -> int:
        return int(kernels.mixed(once.sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])

    def _twin(self, once: np.ndarray) -> int:
        return self._digest(kernels.mixed(once ^ np.uint64(0x9E3779B97F4A7C15)))


def _nodes(batches: Iterable[pa.RecordBatch], naming: Naming) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *naming.both(s), int(np.searchsorted(s, REGION, "right"))) for s in naming.sets(batch.column(1))]
        n, node, twin, inside = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, node, twin, inside))], names=["ident", "n", "node", "twin", "inside"],
        )


PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("counts", pa.binary())])
PACKED_DDL = "part int, keys binary, values binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(PACKED.names, map(list, zip(*rows)))), PACKED)


def _prefixes(batches: Iterable[pa.RecordBatch], naming: Naming, ranges: int, region: np.uint64) -> Iterator[pa.RecordBatch]:
    """Texts -> shingles of the counted region, or as many as the prefix needs, with their nodes. Where a second column
    names a node, another set (of a repeated identifier) is left out."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    for batch in (b.slice(k, 50_000) for b in batches for k in range(0, b.num_rows, 50_000)):
        sets: dict[int, np.ndarray] = {}
        wanted = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
        for s, only in zip(naming.sets(batch.column(0)), wanted):
            if len(s) and (node := naming.node(s)) == (node if only is None else only):
                sets[node] = s[: max(int(np.searchsorted(s, region, "right")), prefix(len(s)))]
        if not sets:
            continue
        nodes = np.sort(np.array(list(sets), np.int64))
        hashes = np.concatenate([sets[x] for x in nodes.tolist()])
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint16), [len(sets[x]) for x in nodes.tolist()])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        part = (hashes >> shift).astype(np.int64)
        rows = []
        for a, b in kernels.slices(part):
            here, index = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(part[a]), kernels.pack(hashes[a:b]), index.astype(np.uint16).tobytes(), nodes[here].tobytes()))
        yield _batch(rows)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by part -> (part, its rows), one part at a time."""
    at, rows = None, []
    for batch in batches:
        for part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                if rows:
                    yield at, rows
                at, rows = part, []
            rows.append(rest)
    if rows:
        yield at, rows


def _shared(batches: Iterable[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Shingles by hash range -> by group of nodes, the shingles that several nodes hold and by how many."""
    for _, rows in _grouped(batches):
        hashes = np.concatenate([kernels.unpack(r[0]) for r in rows])
        nodes = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[1], np.uint16)] for r in rows])
        order = np.lexsort((nodes, hashes))
        hashes, nodes = hashes[order], nodes[order]
        keep = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])))
        hashes, nodes = hashes[keep], nodes[keep]
        _, back, held = np.unique(hashes, return_inverse=True, return_counts=True)
        held = held[back]
        hashes, nodes, held = hashes[held > 1], nodes[held > 1], held[held > 1]
        group = nodes % groups
        order = np.lexsort((nodes, group))
        hashes, nodes, group, held = hashes[order], nodes[order], group[order], np.minimum(held[order], 2**32 - 1).astype(np.uint32)
        out = []
        for a, b in kernels.slices(group):
            here, index = np.unique(nodes[a:b], return_inverse=True)
            value = len(here).to_bytes(4, "little") + here.tobytes() + index.astype(np.uint32).tobytes()
            out.append((int(group[a]), hashes[a:b].tobytes(), value, held[a:b].tobytes()))
        if out:
            yield _batch(out)


def _chosen(batches: Iterable[pa.RecordBatch], ranges: int, region: np.uint64) -> Iterator[pa.RecordBatch]:
    """By group of nodes: sizes, and shared shingles -> by hash range, the shared shingles of each prefix with their sets' sizes
    and the largest sets that can be similar if this is the first shingle in common.

    Rows with null ``counts`` are sizes: ``keys`` holds node, n and shingles in the region.
    """
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    for _, rows in _grouped(batches):
        sizes = np.array([np.frombuffer(r[0], ">i8") for r in rows if r[2] is None]).reshape(-1, 3).astype(np.int64)
        lists = [r for r in rows if r[2] is not None]
        if not lists:
            continue
        sizes = sizes[np.argsort(sizes[:, 0], kind="stable")]
        hashes = np.concatenate([np.frombuffer(r[0], np.uint64) for r in lists])
        held = np.concatenate([np.frombuffer(r[2], np.uint32) for r in lists])
        nodes = []
        for r in lists:
            k = int.from_bytes(r[1][:4], "little")
            nodes.append(np.frombuffer(r[1], np.int64, k, 4)[np.frombuffer(r[1], np.uint32, offset=4 + 8 * k)])
        nodes = np.concatenate(nodes)
        inside = hashes <= region
        order = np.lexsort((hashes, np.where(inside, held, np.uint32(2**32 - 1)), nodes))
        hashes, nodes, inside = hashes[order], nodes[order], inside[order]
        first = np.searchsorted(nodes, nodes)
        at = np.searchsorted(sizes[:, 0], nodes)
        n, counted = sizes[at, 1], sizes[at, 2]
        upto = np.concatenate(([0], np.cumsum(inside)))
        last = np.searchsorted(nodes, nodes, "right")
        single = counted - (upto[last] - upto[first])
        room = np.where(counted < prefix(n), np.int64(2**62), prefix(n) - single)
        place = np.arange(len(nodes)) - first
        reach = (NUM + DEN) * (n - single - place) // NUM - n  # shingles from here on bound the overlap
        keep = place < room
        narrow = lambda x: np.clip(x[keep], 0, 2**32 - 1).astype(np.uint32)
        hashes, nodes, n, reach = hashes[keep], nodes[keep], narrow(n), narrow(reach)
        order = np.argsort(hashes, kind="stable")
        hashes, nodes, n, reach = hashes[order], nodes[order], n[order], reach[order]
        part = (hashes >> shift).astype(np.int64)
        out = [(int(part[a]), kernels.pack(hashes[a:b]), nodes[a:b].tobytes(), n[a:b].tobytes() + reach[a:b].tobytes()) for a, b in kernels.slices(part)]
        if out:
            yield _batch(out)


def joined_holders(hashes: np.ndarray, nodes: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Pairs of nodes that connect what may be similar among the holders of each shingle, at most one pair a holder.

    Two holders may be similar if neither is larger than the other's reach. A holder meets the smaller one of the
    farthest reach: if any smaller one may be similar to it, so is this, and all of those are to each other.
    """
    order = np.lexsort((nodes, n, hashes))
    hashes, nodes, n, reach = hashes[order], nodes[order], n[order], reach[order]
    row = np.arange(len(hashes))
    first = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    shingle = np.cumsum(first) - 1
    wide = np.int64(1 << 33)  # beyond any reach: what comes after begins anew with each shingle
    high = shingle * wide + np.where(reach >= n, reach + 1, 0)
    best = np.maximum.accumulate(high)
    record = np.maximum.accumulate(np.where(np.concatenate(([True], best[1:] > best[:-1])), row, 0)) if len(row) else row
    upto = np.where(reach >= n, row - 1, np.searchsorted(shingle * wide + n, shingle * wide + reach, "right") - 1)
    to = record[np.maximum(upto, 0)]
    near = (upto >= 0) & (hashes[to] == hashes) & (reach[to] >= n) & (nodes[to] != nodes)
    return np.unique(np.stack((nodes[near], nodes[to[near]]), 1), axis=0)


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles by hash range -> links that join the holders of each shingle that may be similar."""
    for _, rows in _grouped(batches):
        hashes = np.concatenate([kernels.unpack(r[0]) for r in rows])
        nodes = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
        n, reach = np.concatenate([np.frombuffer(r[2], np.uint32).reshape(2, -1) for r in rows], 1).astype(np.int64)
        pairs = joined_holders(hashes, nodes, n, reach)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, by exact intersection."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def link_tile(nodes: list[int], sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is similar in a tile. Nodes of one label are connected already."""
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    nodes, sets, labels = ([x[k] for k in order] for x in (nodes, sets, labels))
    sizes = np.array([len(s) for s in sets])
    maps = np.array([bitmap(s) for s in sets]).reshape(len(sets), BITS // 64)
    label = np.unique(labels, return_inverse=True)[1]
    links = []
    for k in range(len(nodes) - 1):
        stop = int(np.searchsorted(sizes, sizes[k] * DEN // NUM, "right"))
        open_ = k + 1 + np.flatnonzero(label[k + 1 : stop] != label[k])
        if not len(open_):
            continue
        need = -(-NUM * (sizes[k] + sizes[open_]) // (NUM + DEN))
        lacks = np.bitwise_count(maps[k] & ~maps[open_]).sum(1, dtype=np.int64)
        extra = np.bitwise_count(maps[open_] & ~maps[k]).sum(1, dtype=np.int64)
        bound = np.minimum(sizes[k] - lacks, sizes[open_] - extra)
        for j in open_[bound >= need][np.argsort(-bound[bound >= need], kind="stable")]:
            if label[j] != label[k] and similar(sets[k], sets[j]):
                label[label == label[j]] = label[k]
                links.append((nodes[k], nodes[int(j)]))
    return links


def _verified(batches: Iterable[pa.RecordBatch], naming: Naming) -> Iterator[pa.RecordBatch]:
    """Rows (tile, node, label, text) sorted by tile -> links."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        sets = naming.sets(pa.array([r[2] for r in rows], pa.string())) if len(rows) > 1 else ()
        here = {node: (s, label) for (node, label, _), s in zip(rows, sets) if naming.node(s) == node}
        links = link_tile(list(here), [s for s, _ in here.values()], [x for _, x in here.values()])
        return pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for _, rows in _grouped(batches):
        yield done(rows)


def candidate_groups(docs: DataFrame, classes: DataFrame, naming: Naming, region: np.uint64 = REGION, name: str = "candidates") -> DataFrame:
    """``node, root`` of nodes that may have a partner, from texts (and, if named, their nodes) and all nodes' sizes."""
    ranges = 2 * range_count(docs, "text")
    groups = prime_below(ranges)
    texts = docs.select("text", *[c for c in docs.columns if c == "node"])
    sent = texts.mapInArrow(lambda it: kernels.tidy(_prefixes(it, naming, ranges, region)), PACKED_DDL)
    shared = sent.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: kernels.tidy(_shared(it, groups)), PACKED_DDL)
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    sizes = classes.select(
        F.pmod("node", F.lit(groups)).cast("int").alias("part"), F.concat(number(F.col("node")), number(F.col("n")), number(F.col("inside"))).alias("keys"),
        F.lit(None).cast("binary").alias("values"), F.lit(None).cast("binary").alias("counts"),
    )
    mine = sizes.unionByName(shared).repartition("part").sortWithinPartitions("part")
    chosen = mine.mapInArrow(lambda it: kernels.tidy(_chosen(it, ranges, region)), PACKED_DDL)
    links = chosen.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: kernels.tidy(thinned(_candidates(it))), "a bigint, b bigint")
    return components(links, f"jaccard-{name}", thin=False)


def _grouped_again(texts: DataFrame, members: DataFrame, naming: Naming) -> DataFrame:
    """``members`` with the groups beyond one tile split by candidates among all their shingles."""
    weight = F.sum(F.greatest(F.col("n") / NODE_SHINGLES, F.lit(1.0)))
    wide = scratch(members.groupBy(F.col("root").alias("_w")).agg(weight.alias("weight")).where(F.col("weight") > TILE).select("_w"), "jaccard-chained")
    if not wide.limit(1).count():
        return members
    wide = broadcast_if_small(wide)
    mine = scratch(members.join(wide, F.col("root") == F.col("_w")).select("node", "ident", "n"), "jaccard-again")
    rows = texts.join(broadcast_if_small(mine.select(F.col("ident").alias("_i"), "node")), F.col("ident") == F.col("_i")).select("text", "node")
    groups = candidate_groups(scratch(rows, "jaccard-again-texts"), mine.withColumn("inside", F.col("n")), naming, WHOLE, "again")
    again = _rooted(groups).join(mine.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    return members.join(wide, F.col("root") == F.col("_w"), "left_anti").unionByName(again)


def _rooted(groups: DataFrame) -> DataFrame:
    """``node, root`` with the roots among the nodes."""
    return groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())


def link(docs: DataFrame, members: DataFrame, tiles: DataFrame, naming: Naming, name: str) -> DataFrame:
    """Verified links of the given tiles: ``members`` (node, ident, label, block, root), ``tiles`` (root, block, tile)."""
    placed = members.join(tiles.withColumnsRenamed({"root": "_r", "block": "_b"}), (F.col("root") == F.col("_r")) & (F.col("block") == F.col("_b")))
    wanted = placed.select(F.col("ident").alias("_i"), "tile", "node", "label")
    rows = docs.join(wanted, F.col("ident") == F.col("_i")).select("tile", "node", "label", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiles are small in bytes and long in work: not to be coalesced
    return scratch(rows.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(lambda it: kernels.tidy(_verified(it, naming)), "a bigint, b bigint"), f"jaccard-{name}")


def identified(docs: DataFrame, salt: int, bits: int) -> tuple[DataFrame, DataFrame, Naming]:
    """``ident, n, node, inside`` of every document; ``node, ident, n, inside`` of every different set; and their naming.

    Sets that share 64 bits of identity and differ in the next 64 are few and known: they take the latter for a name.
    """
    naming = Naming(salt, bits)
    nodes = docs.mapInArrow(lambda it: kernels.tidy(_nodes(it, naming)), "ident bigint, n bigint, node bigint, twin bigint, inside bigint")
    nodes = scratch(nodes, "jaccard-nodes")

    def grouped(rows: DataFrame) -> DataFrame:
        out = rows.where("n > 0").groupBy("node").agg(
            F.min("ident").alias("ident"), F.min("n").alias("n"), F.min("inside").alias("inside"), F.min("twin").alias("_low"), F.max("twin").alias("_high"),
        )
        return scratch(out, "jaccard-sets")

    classes = grouped(nodes)
    clashes = frozenset(r.node for r in classes.where("_low <> _high").select("node").limit(CLASHES + 1).collect())
    if len(clashes) > CLASHES:
        raise RuntimeError("more equal identities of different sets than chance allows")
    if clashes:
        naming = Naming(salt, bits, clashes)
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("twin")).otherwise(F.col("node")))
        classes = grouped(nodes)
    return nodes.drop("twin"), classes.drop("_low", "_high"), naming


def near_duplicates(df: DataFrame, *, ident: str = "doc_id", text: str = "text", salt: int | None = None, bits: int = 64) -> DataFrame:
    """One row per document: ``<ident>, n_shingles, component_id``.

    Two documents are linked at a Jaccard similarity of 0.75 or more of their distinct five-word shingles
    (fewer words: the whole sequence is one; none: linked with nothing); ``component_id`` is the smallest
    identifier reachable by links. Null texts have no words. Documents without an identifier take part
    through equal sets only and carry their component's smallest identifier, if it has one. Repeated rows
    are equal sets. A very long text is one row of a task, hashed in pieces. Other columns, whatever their names,
    are not read. An empty table gives an empty result. ``salt`` keys the hashes, by default drawn anew;
    ``bits`` of identity name a set before sets of one name are told apart.
    """
    docs = df.select(F.col(ident).cast("bigint").alias("ident"), F.col(text).alias("text"))
    nodes, classes, naming = identified(docs, secrets.randbits(62) if salt is None else salt, bits)
    groups = candidate_groups(docs, classes, naming)
    first = classes.drop("inside")
    members = _rooted(groups).join(first.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n").where("ident is not null")
    members = scratch(members, "jaccard-grouped")
    # What may have a partner is kept by itself, so that all texts are dealt once at most.
    docs = scratch(docs.join(broadcast_if_small(members.select(F.col("ident").alias("_i")).distinct()), F.col("ident") == F.col("_i"), "left_semi"), "jaccard-texts")
    members = scratch(_grouped_again(docs, members, naming), "jaccard-regrouped")
    sizes = _size_places(members)
    members = scratch(_blocked(members, sizes).withColumn("label", F.col("node")), "jaccard-members")
    blocks = scratch(members.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "jaccard-blocks")
    diagonal = blocks.select("root", "block", F.xxhash64("root", "block").alias("tile"))
    links = link(docs, members, diagonal, naming, "tiles")
    wide = scratch(blocks.groupBy("root").agg(F.max("block").alias("last")).where("last > 0"), "jaccard-wide")
    if wide.limit(1).count():
        links = links.unionByName(_wide_links(docs, members, sizes, blocks, wide, links, naming))
    tree = components(links, "jaccard")
    roots = nodes.join(tree.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    placed = scratch(roots.select("ident", "n", F.coalesce("root", "node").alias("class")), "jaccard-classes")
    least = scratch(placed.where("n > 0").groupBy("class").agg(F.min("ident").alias("component_id")), "jaccard-least")
    out = placed.join(least.withColumnRenamed("class", "_c"), (F.col("class") == F.col("_c")) & (F.col("n") > 0), "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("ident"))
    return out.select(F.col("ident").alias(ident), F.col("n").alias("n_shingles"), whole.alias("component_id"))


def keep_one(df: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the document of the smallest identifier stays.

    Columns stay as they are. Repeated rows (same identifier and text) become one; documents without an
    identifier, which no link can name, all stay.
    """
    found = scratch(near_duplicates(df, ident=ident, text=text), "jaccard-kept")
    stays = F.sum((F.col(ident) == F.col("component_id")).cast("int")).alias("rows")
    first = scratch(found.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_first")).agg(stays), "jaccard-first")
    key = F.col(ident).cast("bigint")
    # What goes is less than what stays: while it is few, no text is dealt.
    out = df.where(key.isNotNull()).join(broadcast_if_small(first.where("rows = 0").select("_first")), key == F.col("_first"), "left_anti")
    if first.where("rows > 1").limit(1).count():
        out = out.dropDuplicates([ident, text])
    return out.unionByName(df.where(F.col(ident).isNull()))


def _size_places(members: DataFrame) -> DataFrame:
    """``root, n`` with ``weight``, the weight ``before`` (of smaller sets) and in ``total``: a histogram of each group's
    set sizes. A node weighs 1, or its set's size by ``NODE_SHINGLES`` if that is more."""
    weight = F.count("*") * F.greatest(F.col("n") / NODE_SHINGLES, F.lit(1.0))
    counts = scratch(members.groupBy("root", "n").agg(weight.alias("weight")), "jaccard-sizes")
    group = Window.partitionBy("root")  # one row for each size
    before = F.coalesce(F.sum("weight").over(group.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return scratch(counts.withColumns({"before": before, "total": F.sum("weight").over(group)}), "jaccard-places")


def _blocked(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Append ``block``: nodes of neighbouring sizes, about ``TILE`` by weight. Nodes of one size are dealt by hash, so
    no group is ever sorted in one task."""
    own = sizes.withColumnsRenamed({"root": "_r", "n": "_s"})
    out = members.join(own, (F.col("root") == F.col("_r")) & (F.col("n") == F.col("_s")))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("weight") / float(1 << 20)
    return out.withColumn("block", F.floor(place / TILE).cast("int")).drop("_r", "_s", "weight", "before", "total")


def _wide_links(docs: DataFrame, members: DataFrame, sizes: DataFrame, blocks: DataFrame, wide: DataFrame, links: DataFrame, naming: Naming) -> DataFrame:
    """Links between the tiles of groups that fill more than one."""
    big = broadcast_if_small(wide).withColumnRenamed("root", "_w")
    mine = members.join(big, F.col("root") == F.col("_w")).drop("_w", "last")
    # Hub: a node of each group's middle size meets every tile that its size allows.
    middle = sizes.where("2 * before <= total and total < 2 * (before + weight)").select(F.col("root").alias("_w"), F.col("n").alias("_m"))
    hub = mine.join(middle, (F.col("root") == F.col("_w")) & (F.col("n") == F.col("_m"))).groupBy("root").agg(F.min(F.struct("node", "ident", "n", "label")).alias("h"))
    hub = scratch(hub.select("root", "h.*"), "jaccard-hub")
    near = blocks.join(broadcast_if_small(hub.select(F.col("root").alias("_w"), F.col("n").alias("_n"))), F.col("root") == F.col("_w")).where(
        (F.col("low") * NUM <= F.col("_n") * DEN) & (F.col("_n") * NUM <= F.col("high") * DEN)
    )
    near = scratch(near.select("root", "block", F.xxhash64(F.lit("hub"), "root", "block").alias("tile")), "jaccard-hub-tiles")
    guests = near.select(F.col("root").alias("_w"), F.col("block").alias("_k")).join(broadcast_if_small(hub), F.col("_w") == F.col("root")).select("node", "ident", "label", F.col("_k").alias("block"), "root")
    found = link(docs, mine.select("node", "ident", "label", "block", "root").unionByName(guests), near, naming, "hub")
    tree = scratch(components(links.unionByName(found), "jaccard-hubs"), "jaccard-hub-tree")
    labelled = mine.drop("label").join(tree.withColumnsRenamed({"node": "_n", "root": "label"}), F.col("node") == F.col("_n"), "left")
    labelled = scratch(labelled.select("node", "ident", F.coalesce("label", "node").alias("label"), "block", "root", "n"), "jaccard-labels")
    seen = labelled.groupBy("root", "block").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.min("n").alias("low"), F.max("n").alias("high"))
    seen = scratch(seen, "jaccard-seen")
    left, right = seen.select([F.col(c).alias(f"l_{c}") for c in seen.columns]), seen.select([F.col(c).alias(f"r_{c}") for c in seen.columns])
    mixed = (F.least("l_one", "r_one") != F.greatest("l_other", "r_other")) & (F.col("r_low") * NUM <= F.col("l_high") * DEN)
    pairs = left.join(right, (F.col("l_root") == F.col("r_root")) & (F.col("l_block") < F.col("r_block"))).where(mixed)
    pairs = scratch(pairs.select(F.col("l_root").alias("root"), F.col("l_block").alias("i"), F.col("r_block").alias("j")), "jaccard-pairs")
    tile = F.xxhash64("root", "i", "j").alias("tile")
    tiles = pairs.select("root", F.col("i").alias("block"), tile).unionByName(pairs.select("root", F.col("j").alias("block"), tile))
    return found.unionByName(link(docs, labelled, tiles, naming, "pairs"))


#: DuckDB SQL of the registered query (pairs by shared shingle, then reachability).
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, w FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(w[i : i + 4], ' ')) AS h FROM e
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), m AS (
  SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, m.v FROM r JOIN m ON m.u = r.v
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.v) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n
"""
