"""NumPy kernels over Arrow text batches: words, rolling hashes, packed hash lists."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time, so that arrays stay in a core's cache; a longer text is hashed alone. Powers kept.
CHUNK, KEPT = 1 << 16, 1 << 20



def _system_memory(name: str, *args: int) -> None:
    """Call the C library's allocator control, where there is one."""
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (OSError, AttributeError):
        pass


#: Arrays of this many bytes or more are mapped on their own, so that freeing them frees memory.
MAPPED = 1 << 20
_system_memory("mallopt", -3, MAPPED)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps its Python workers after their tasks."""
    pa.default_memory_pool().release_unused()
    _system_memory("malloc_trim", 0)


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on and give memory back at the end."""
    try:
        yield from batches
    finally:
        give_back()


_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: The prime of the rolling hashes, 2^61 - 1.
PRIME = (1 << 61) - 1
_P = _U(PRIME)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo ``PRIME``."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Product modulo ``PRIME`` of values below it, from 31-bit halves."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(_U(2) * a1 * b1 + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


class Rolling:
    """Polynomials modulo a prime: hashes of all runs of a width from prefix sums (Rabin-Karp)."""

    def __init__(self, base: int):
        self.bases = {1: base, -1: pow(base, -1, PRIME)}
        self.held: dict[int, np.ndarray] = {}

    def powers(self, n: int, sign: int) -> np.ndarray:
        """base^0 .. base^(n-1) (of the inverse for sign -1); kept up to a bound."""
        got = self.held.get(sign, np.ones(1, np.uint64))
        while len(got) < n:
            got = np.concatenate((got, times(got, _U(pow(self.bases[sign], len(got), PRIME)))))
        if len(got) <= KEPT:
            self.held[sign] = got
        return got[:n]

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash (below ``PRIME``) of every run of ``width`` values below ``PRIME``."""
        n, parts = len(values), []
        terms = times(values, self.powers(n, 1))
        for half in (terms >> _U(32), terms & _U((1 << 32) - 1)):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(half, out=total[1:])
            parts.append(total[width:] - total[:-width])
        high, low = parts  # the sum is high * 2^32 + low, and 2^61 is 1
        sums = reduced((high >> _U(29)) + ((high & _U((1 << 29) - 1)) << _U(32)) + low)
        return times(sums, self.powers(n, -1)[: n - width + 1])


#: Positions of a word whose byte values are looked up; later ones are worked out.
_LOOKED_UP = 64


class Hashing:
    """Keyed hashes of words and of word runs.

    A word is the sum of a pseudo-random 64-bit value for each of its (position, byte), so words that are shuffles or
    complements of each other have nothing in common. A run of words is a polynomial modulo a prime at two
    bases. Values and bases come from ``salt``, which callers draw anew for each query: no text can be made to collide.
    """

    def __init__(self, salt: int):
        rng = np.random.default_rng([salt & (2**63 - 1), 61])
        self.key = rng.integers(0, 2**64, 1, np.uint64)
        self.rolling = [Rolling(int(b)) for b in rng.integers(2**40, PRIME - 1, 2, np.uint64)]
        self.table = self._value(np.arange(_LOOKED_UP * 256, dtype=np.uint64))

    def _value(self, cell: np.ndarray) -> np.ndarray:
        """Pseudo-random value of position * 256 + byte."""
        return mixed(mixed(cell + self.key) ^ self.key)

    def words(self, texts: pa.Array, *, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Words of texts as 64-bit hashes, a few texts at a time.

        Yields (index of the first text, hashes of all words in order, bounds): the words of the k-th text of the
        group are ``hashes[bounds[k]:bounds[k + 1]]``. Words are runs of anything but ASCII white space; ``lower``
        folds A-Z. A text beyond ``CHUNK`` bytes is hashed alone, in pieces that end at white space.
        """
        data, offsets = _buffers(texts)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            low, high = int(offsets[first]), int(offsets[last])
            if high - low <= CHUNK:
                yield first, *self._split(data[low:high], offsets[first : last + 1] - low, lower)
            else:
                pieces = [self._split(data[a:b], np.array([0, b - a]), lower)[0] for a, b in _pieces(data, low, high)]
                whole = np.concatenate(pieces)
                yield first, whole, np.array([0, len(whole)])
            first = last

    def _split(self, raw: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        inside = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
        stops = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
        sizes = stops - starts
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value = self.table[(np.minimum(place, _LOOKED_UP - 1) << 8) + raw[at]]
        far = np.flatnonzero(place >= _LOOKED_UP)
        if len(far):
            value[far] = self._value((place[far].astype(np.uint64) << _U(8)) + raw[at[far]])
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        past = np.cumsum(sizes)
        return mixed(total[past] - total[past - sizes]), np.searchsorted(starts, ends)

    def windows(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``width`` words, in two parts: 64 bits that are spread evenly, and 58 further ones."""
        if len(words) < width or not width:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one = self.rolling[0].windows(reduced(words), width)
        other = self.rolling[1].windows(reduced(mixed(words + _U(1))), width)
        return (one << _U(3)) | (other & _U(7)), other >> _U(3)

    def shingle_sets(self, texts: pa.Array, width: int = 5, *, lower: bool = False) -> Iterator[np.ndarray]:
        """The sorted distinct 61-bit hashes, spread over 64 bits, of each text's word runs.

        A text of fewer words is one run; no words give none.
        """
        for _, words, bounds in self.words(texts, lower=lower):
            values = reduced(words)
            runs = mixed(self.rolling[0].windows(values, width)) if len(words) >= width else words[:0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= width:
                    yield np.unique(runs[a : b - width + 1])
                else:
                    yield mixed(self.rolling[0].windows(values[a:b], b - a) + _U(b - a)) if a < b else words[:0]


@functools.lru_cache(4)
def hashing(salt: int) -> Hashing:
    """The hashes of a salt, kept by each Python worker."""
    return Hashing(salt)


def _pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """About ``CHUNK`` bytes at a time of data[low:high], cut at white space."""
    while low < high:
        end = min(low + CHUNK, high)
        while end < high and not _SPACE[data[end]]:
            space = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = end + int(space[0]) if len(space) else min(end + CHUNK, high)
        yield low, end
        low = end


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets into them; null texts are empty."""
    texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences in byte planes: as few bytes each as the largest needs."""
    if not len(values):
        return b"\0"
    gaps = np.diff(values, prepend=_U(0))
    width = max(1, (int(gaps[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(planes).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if len(blob) == 1:
        return np.zeros(0, np.uint64)
    width, n = blob[0], (len(blob) - 9) // blob[0]
    gaps = np.zeros((n + 1, 8), np.uint8)
    gaps[1:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(width, n).T
    gaps = gaps.reshape(-1).view(np.uint64)
    gaps[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    return np.cumsum(gaps, dtype=np.uint64)


def narrow(values: np.ndarray) -> bytes:
    """64-bit values as distances from the least, in as few bytes each as the largest needs."""
    low = values.min()
    off = values - low
    width = max(1, (int(off.max()).bit_length() + 7) // 8)
    return bytes([width]) + low.tobytes() + np.ascontiguousarray(off.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(blob: bytes) -> np.ndarray:
    off = np.zeros(((len(blob) - 9) // blob[0], 8), np.uint8)
    off[:, : blob[0]] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[0])
    return off.reshape(-1).view(np.uint64) + np.frombuffer(blob, np.uint64, 1, 1)


def cut_bytes(values: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def uncut_bytes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(blob) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(-1, n)
    return out.reshape(-1).view(np.uint64)


def slices(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return ((a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]) if a < b)
