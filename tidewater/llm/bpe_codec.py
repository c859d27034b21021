"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that never stand side by side inside any token of the vocabulary mark a certain
cut: no merge can cross it. Fragments between cuts are encoded independently and concatenated. The
pre-tokeniser's own boundaries are cuts as well. Fragments are short, so work per text is linear; what
a chunk becomes is remembered in a bounded table for the length of a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels
from tidewater.llm.common import fresh

#: Fixed value: the byte-level pre-tokeniser's published pattern.
_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Chunks end where the pre-tokeniser cuts whatever comes next: between other characters and white space,
#: after a word of letters before white space, full stop or comma, and around a line feed before a word.
_CHUNKS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\s.,])|\n(?=\S)|\s*\S+|\s+")

#: Entries remembered in a task, and the longest chunk that is.
CACHE_CHUNKS, CACHE_LENGTH = 400_000, 48


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Byte-level BPE codec read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte = spec["model"], _byte_of_char()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        } or model["ignore_merges"] or model["dropout"]:
            raise ValueError("only plain byte-level BPE files are supported")
        ids = model["vocab"]
        raw = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        self.token = dict(raw)
        self.of_byte = {t[0]: i for i, t in raw.items() if len(t) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if len(ids) >= 1 << 20:
            raise ValueError("vocabularies of 2^20 tokens or more are not supported")
        self.rank = {ids[a] << 20 | ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.joined = bytearray(65536)
        for t in raw.values():
            for a, b in zip(t, t[1:]):
                self.joined[a << 8 | b] = 1
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or normalising are not supported")
        self.token |= {i: s.encode() for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.chunks: dict[str, tuple[int, str, bytes]] = {}

    def cut(self, piece: bytes) -> list[bytes]:
        """The fragments of a piece between certain cuts."""
        joined = self.joined
        at = [k for k, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not joined[a << 8 | b]]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])] if at else [piece]

    def merged(self, fragment: bytes) -> list[int]:
        """Identifiers of one fragment: lowest-rank pair first, leftmost among equals."""
        ids = [self.of_byte[b] for b in fragment]
        if len(ids) > 400:
            return self._merged_long(ids)
        rank_of, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            new = made[best]
            ids[k : k + 2] = [new]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = rank_of(new << 20 | ids[k + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by heap and linked list, for fragments of many bytes."""
        from heapq import heapify, heappop, heappush

        n, rank_of, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = enumerate(zip(ids, ids[1:]))
        heap = [(r, k, a, b) for k, (a, b) in pairs if (r := rank_of(a << 20 | b)) is not None]
        heapify(heap)
        while heap:
            best, k, a, b = heappop(heap)
            if ids[k] != a or (r := after[k]) >= n or ids[r] != b:
                continue
            new = made[best]
            ids[k], ids[r], after[k] = new, -1, after[r]
            if (f := after[k]) < n:
                before[f] = k
                if (x := rank_of(new << 20 | ids[f])) is not None:
                    heappush(heap, (x, k, new, ids[f]))
            if (p := before[k]) >= 0 and (x := rank_of(ids[p] << 20 | new)) is not None:
                heappush(heap, (x, p, ids[p], new))
        return [i for i in ids if i >= 0]

    def plain(self, text: str) -> list[int]:
        """Identifiers of a text without special tokens."""
        pieces = (text,) if text[text[:1] == " " :].isalpha() else _SPLIT.findall(text)
        return [i for p in pieces for f in self.cut(p.encode()) for i in self.merged(f)]

    def segments(self, text: str):
        """(segment, identifier of the special token it is or None)."""
        if self.cut_special is None or not self.cut_special.search(text):
            return [(text, None)]
        return [(s, self.special.get(s)) for s in self.cut_special.split(text) if s]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text or ""):
            out += self.plain(part) if special is None else [special]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of identifiers, SHA-256 of them joined by commas, SHA-256 of the decoded text."""
        n, said, made = 0, [], []
        for part, special in self.segments(text or ""):
            if special is not None:
                got = [(1, f",{special}", self.token[special])]
            else:
                chunks = _CHUNKS.findall(part)
                got = list(map(self.chunks.get, chunks))
                if None in got:
                    got = [g or self.chunk(c) for g, c in zip(got, chunks)]
            if got:
                counts, ids, back = zip(*got)
                n += sum(counts)
                said += ids
                made += back
        back = b"".join(made).decode("utf-8", "replace").encode()
        return n, hashlib.sha256("".join(said)[1:].encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    def chunk(self, chunk: str) -> tuple[int, str, bytes]:
        """Number of identifiers, the identifiers with leading commas, and the bytes they decode to."""
        got = self.chunks.get(chunk)
        if got is None:
            ids = self.plain(chunk)
            got = (len(ids), "".join([f",{i}" for i in ids]), b"".join(map(self.token.__getitem__, ids)))
            if len(chunk) <= CACHE_LENGTH:
                if len(self.chunks) >= CACHE_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = got
        return got


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file; read once per process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(text: Column, path: str) -> Column:
    """Array of identifiers; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        to = codec(path).encode
        return pa.array([to(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of identifiers; null gives an empty text. Unknown identifiers raise."""

    @F.arrow_udf("string")
    def texts(arrays: pa.Array) -> pa.Array:
        back = codec(path).decode
        return pa.array([back(a or ()) for a in arrays.to_pylist()], pa.string())

    return texts(ids)


def round_trip(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text's encoding and its decoding.

    Null text counts as empty (0 tokens, digests of the empty string). Rows are kept one to one and in
    any number; columns of these names are replaced, all others stay. A very long text is one row, encoded fragment
    by fragment; an empty table gives an empty result. One scan, no shuffle.
    """

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        try:
            for texts in batches:
                n, a, b = zip(*map(own.digest, texts.to_pylist())) if len(texts) else ((), (), ())
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            own.chunks.clear()
            kernels.give_back()

    got = fresh(df, "codec")
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = df.withColumn(got, digests(F.col(text)))
    return out.withColumns({n: F.col(f"{got}.{n}") for n in names}).drop(got)
