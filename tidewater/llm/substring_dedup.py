"""Substring dedup: passages of fixed length that an earlier document already holds are removed.

Rabin-Karp hashes of every fixed-length word window are dealt out by hash range and counted; a window that
also starts in a document of smaller id is repeated, and the repeated windows of a document merge into
maximal removal intervals.

What is shuffled are packed lists, not rows: a map task sorts its windows, keeps each hash once (with the
least id of its documents, so a passage that many documents share is one entry a task) and sends each
range as one blob of differences. The windows found repeated go back to their documents in the same form,
as 56-bit hashes that are compared only with the windows of that one document. Texts move once.

Beyond ``COARSE`` ranges lists would become shorter than their rows, so they move in two exchanges: to coarse
ranges, where lists of many tasks are merged, and from there to fine ones. A window costs the same bytes at every size.

Windows count as equal by 88 bits: a polynomial modulo 2^61 - 1 and 27 bits of another, at bases drawn for the
query. Among 10^13 windows (100 TB) about one in six runs would see a single false repeat.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels
from tidewater.llm.common import prime_below, range_count

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = np.uint64(1 << 63)

#: Bytes that are compared besides the first 64 bits of a window, and bytes of a reply.
CHECK, REPLY = 3, 7
_CHECK, _REPLY = np.uint64((1 << 8 * CHECK) - 1), np.uint64((1 << 8 * REPLY) - 1)

#: Ranges up to which one exchange does, and windows that are merged at a time between two.
COARSE, MERGED = 4096, 2_000_000


def ordered(ids: np.ndarray) -> np.ndarray:
    """Signed identifiers as unsigned ones in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ _SIGN


def signed(ids: np.ndarray) -> np.ndarray:
    return (ids ^ _SIGN).view(np.int64)


SENT = pa.schema([("part", pa.int32()), ("reply", pa.bool_()), ("hashes", pa.binary()), ("checks", pa.binary()), ("owners", pa.binary())])
SENT_DDL = "part int, reply boolean, hashes binary, checks binary, owners binary"


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(SENT.names, map(list, zip(*rows)))), SENT)


def _replies(owners: np.ndarray, hashes: np.ndarray, parts: int, groups: int) -> Iterator[tuple]:
    """Rows of repeated windows by group of documents (modulo ``parts``): each owner once, with its number of windows."""
    part = signed(owners) % groups % parts
    order = np.lexsort((owners, part))
    part, owners, hashes = part[order], owners[order], hashes[order]
    for a, b in kernels.slices(part):
        own, count = np.unique(owners[a:b], return_counts=True)
        yield int(part[a]), True, kernels.cut_bytes(hashes[a:b], REPLY), count.astype(np.uint32).tobytes(), kernels.narrow(own)


def _opened(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Owners and low bits of a row of replies."""
    return np.repeat(kernels.widen(row[4]), np.frombuffer(row[3], np.uint32)), kernels.uncut_bytes(row[2], REPLY)


def _lists(hashes: np.ndarray, checks: np.ndarray, owners: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Rows of sorted windows by hash range."""
    part = (hashes >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
    for a, b in kernels.slices(part):
        yield int(part[a]), False, kernels.pack(hashes[a:b]), kernels.cut_bytes(checks[a:b], CHECK), kernels.narrow(owners[a:b])


def _once(hashes: np.ndarray, checks: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted windows, each once with its least owner; and owners and hashes of the others' windows."""
    order = np.argsort(hashes, kind="stable")
    hashes, checks, owners = hashes[order], checks[order], owners[order]
    same = hashes[1:] == hashes[:-1]
    many = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(hashes) else np.zeros(0, bool)
    h, c, o = hashes[many], checks[many], owners[many]
    order = np.lexsort((o, c, h))
    h, c, o = h[order], c[order], o[order]
    hashes[many], checks[many], owners[many] = h, c, o  # the places of a hash stay together, and only their order changes
    head = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]))) if len(hashes) else np.zeros(0, bool)
    least = owners[head][np.cumsum(head) - 1]
    again = least != owners
    return hashes[head], checks[head], owners[head], owners[again], hashes[again]


def _send(batches: Iterable[pa.RecordBatch], salt: int, width: int, ranges: int, parts: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) -> lists of windows by hash range, and replies on what is repeated among them."""
    made = kernels.hashing(salt)
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        ids = ordered(batch.column(0).to_numpy(zero_copy_only=False))
        found = []
        for first, words, bounds in made.words(batch.column(1)):
            hashes, checks = made.windows(words, width)
            begin = np.arange(len(hashes))
            doc = np.searchsorted(bounds, begin, "right") - 1
            inside = begin + width <= bounds[doc + 1]
            found.append((hashes[inside], checks[inside] & _CHECK, ids[first + doc[inside]]))
        if found:
            hashes, checks, owners, late, low = _once(*map(np.concatenate, zip(*found)))
            yield from _rows([*_replies(late, low, parts, groups), *_lists(hashes, checks, owners, ranges)])


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """Rows sorted by part -> (part, its lists, its replies), at most about ``MERGED`` windows at a time."""
    at, lists, replies, held = None, [], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at or held > MERGED:
                if lists or replies:
                    yield at, lists, replies
                at, lists, replies, held = row[0], [], [], 0
            (replies if row[1] else lists).append(row)
            held += len(row[2]) // (REPLY if row[1] else CHECK * 2)
    if lists or replies:
        yield at, lists, replies


def _unpacked(lists: list[tuple]) -> tuple[np.ndarray, ...]:
    sides = [(kernels.unpack(r[2]), kernels.uncut_bytes(r[3], CHECK), kernels.widen(r[4])) for r in lists]
    return tuple(np.concatenate(x) for x in zip(*sides))


def _refine(batches: Iterable[pa.RecordBatch], ranges: int, parts: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows by coarse range or group -> merged lists by fine ranges, merged replies by groups modulo ``parts``."""
    for _, lists, replies in _by_part(batches):
        rows = []
        if lists:
            hashes, checks, owners, late, low = _once(*_unpacked(lists))
            rows += [*_replies(late, low, parts, groups), *_lists(hashes, checks, owners, ranges)]
        if replies:
            owners, low = (np.concatenate(x) for x in zip(*map(_opened, replies)))
            rows += _replies(owners, low, parts, groups)
        yield from _rows(rows)


def _count(batches: Iterable[pa.RecordBatch], parts: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Lists sorted by hash range -> replies on repeated windows. A range is held whole: its size is bounded by their number."""
    at, lists = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if len(lists) > 1:
            yield from _rows(list(_replies(*_once(*_unpacked(lists))[3:], parts, groups)))

    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1]:
                rows.append(row)
                continue
            if row[0] != at:
                yield from done()
                at, lists = row[0], []
            lists.append(row)
        yield from _rows(rows)
    yield from done()


def intervals(windows: np.ndarray, width: int, low: np.ndarray) -> np.ndarray:
    """Maximal removal intervals (start, end) of one document from its windows and the low bits of the repeated ones."""
    at = np.flatnonzero(np.isin(windows & _REPLY, low))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(at[1:] > at[:-1] + width)
    return np.stack((at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))] + width), 1)


CUT = pa.schema([
    ("ident", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()),
])


def _cut(batches: Iterable[pa.RecordBatch], salt: int, width: int) -> Iterator[pa.RecordBatch]:
    """Replies of a group of documents, then its documents -> documents without the repeated passages."""
    at, owners, low, none = None, [], [], np.zeros(0, np.uint64)
    made = kernels.hashing(salt)
    for batch in batches:
        rows = []
        grps, kinds, idents, texts, *sides = batch.columns
        hashed = ((first + k, words[b[k] : b[k + 1]]) for first, words, b in made.words(texts) for k in range(len(b) - 1))
        for grp, kind, ident, text, *blobs, (_, words) in zip(
            grps.to_pylist(), kinds.to_pylist(), idents.to_pylist(), texts.to_pylist(), *(x.to_pylist() for x in sides), hashed, strict=True,
        ):
            if grp != at:
                at, owners, low = grp, [], []
            if kind == 0:
                opened = _opened((None, None, *blobs))
                owners.append(opened[0])
                low.append(opened[1])
                continue
            if isinstance(owners, list):
                owners, low = (np.concatenate([none, *x]) for x in (owners, low))
                order = np.argsort(owners, kind="stable")
                owners, low = owners[order], low[order]
            own = none
            if ident is not None:
                key = ordered(np.array([ident], np.int64))[0]
                own = low[np.searchsorted(owners, key) : np.searchsorted(owners, key, "right")]
            said = _WORDS.findall(text or "")
            spans = intervals(made.windows(words, width)[0], width, own) if len(own) else np.zeros((0, 2), np.int64)
            kept, last = [], 0
            for a, b in spans.tolist():
                kept += said[last:a]
                last = b
            kept += said[last:]
            removed = [{"start": a, "end": b} for a, b in spans.tolist()]
            rows.append((ident, len(said), len(said) - len(kept), removed, " ".join(kept)))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(CUT.names, map(list, zip(*rows)))), CUT)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _python(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    return rows.mapInArrow(lambda it: kernels.tidy(make(it)), schema)


def cut_repeats(df: DataFrame, *, width: int = 50, ident: str = "doc_id", text: str = "text", ranges: int | None = None, salt: int | None = None) -> DataFrame:
    """One row per document: ``<ident>, n_words, n_removed, removed`` (word intervals, end exclusive), ``kept``.

    A word goes if a window of ``width`` consecutive words that covers it also starts in a document of smaller
    id; windows are judged on the input. Null texts have no words; texts under ``width`` words lose none;
    documents without an id lose none and make none lose. Rows of one id are one document's parts: they
    lose what smaller ids hold, not each other's. A very long text is one row of a task, hashed in pieces. Other columns,
    whatever their names, are not read. An empty table gives an empty result.

    ``ranges`` (a power of two) is the number of hash ranges, by default one to a few MB of text; ``salt`` keys the
    hashes, by default drawn anew.
    """
    salt = secrets.randbits(62) if salt is None else salt
    docs = df.select(F.col(ident).cast("bigint").alias("ident"), F.col(text).alias("text"))
    ranges = ranges or range_count(docs, "text")
    groups, parts, two = prime_below(ranges), min(ranges, COARSE), ranges > COARSE
    sent = _dealt(_python(docs, lambda it: _send(it, salt, width, parts, parts if two else groups, groups), SENT_DDL))
    if two:
        sent = _dealt(_python(sent, lambda it: _refine(it, ranges, parts, groups), SENT_DDL))
    back = _python(sent, lambda it: _count(it, parts if two else groups, groups), SENT_DDL)
    if two:
        back = _python(_dealt(back), lambda it: _refine(it, ranges, groups, groups), SENT_DDL)
    none = F.lit(None)
    blobs = back.select(F.col("part").alias("grp"), F.lit(0).alias("kind"), none.cast("bigint").alias("ident"), none.cast("string").alias("text"), "hashes", "checks", "owners")
    grouped = docs.withColumn("grp", F.coalesce(F.pmod("ident", F.lit(groups)), F.lit(0)).cast("int"))
    texts = grouped.select("grp", F.lit(1).alias("kind"), "ident", "text", *[none.cast("binary").alias(c) for c in ("hashes", "checks", "owners")])
    both = blobs.unionByName(texts).repartition("grp").sortWithinPartitions("grp", "kind")
    schema = "ident bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept string"
    return _python(both, lambda it: _cut(it, salt, width), schema).withColumnRenamed("ident", ident)


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE m < doc_id
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r
), k AS (
  SELECT d.doc_id, u.p, w[u.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)
), j AS (
  SELECT k.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k.p) AS kept FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
