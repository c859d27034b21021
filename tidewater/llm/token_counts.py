"""Token counts by heap-and-linked-list byte-pair merging (SentencePiece BPE models).

The lowest-rank adjacent pair is popped from a heap again and again; symbols form a linked list.
The count is the number of initial symbols less the number of merges, so no identifier is made.

Texts are cut before runs of the space symbol and around line feeds, which no piece of the model may
hold inside (checked when the model is read); counts of the resulting chunks add up exactly and are
remembered in a bounded table for the length of a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels

SPACE = "▁"
_CHUNKS = re.compile(r" *[^ \n]+| +|\n")

#: Chunks remembered in a task, and the longest one that is.
CACHE_CHUNKS, CACHE_LENGTH = 600_000, 48


class PieceCounter:
    """Counts tokens as a SentencePiece BPE model with byte fallback and an identity normaliser does."""

    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in rank if len(p) > 1):
            raise ValueError("the model has pieces that cross word boundaries")
        self.known = {p for p in rank if len(p) == 1}
        self.seen: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if model.encode("  a\tﬁ ", out_type=str) != model.encode(f"  a\tﬁ{SPACE}", out_type=str):
            raise ValueError("only models with an identity normaliser are supported")
        return cls({model.id_to_piece(i): -model.get_score(i) for i in plain})

    def merge(self, chunk: str) -> int:
        """Tokens of one chunk. Equal ranks merge leftmost first."""
        rank, n = self.rank, len(chunk)
        count = sum(1 if c in self.known else len(c.encode()) for c in chunk)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, stop = heappop(heap)
            right = end[left]
            if not right or right >= n or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            count -= 1
            if stop < n:
                before[stop] = left
                if (r := rank.get(chunk[left : end[stop]])) is not None:
                    heappush(heap, (r, left, end[stop]))
            if (back := before[left]) >= 0 and (r := rank.get(chunk[back:stop])) is not None:
                heappush(heap, (r, back, stop))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for chunk in _CHUNKS.findall(" " + text.replace(SPACE, " ")):
            n = seen.get(chunk)
            if n is None:
                n = self.merge(chunk.replace(" ", SPACE))
                if len(chunk) <= CACHE_LENGTH:
                    if len(seen) >= CACHE_CHUNKS:
                        seen.clear()
                    seen[chunk] = n
            total += n
        return total


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The worker's counter for a model file; read once per process."""
    if path not in _counters:
        _counters[path] = PieceCounter.load(path)
    return _counters[path]


def token_count(text: Column, model_path: str) -> Column:
    """Column of token counts for a text column; null and empty texts have 0 tokens."""

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = counter(model_path)
        try:
            for texts in batches:
                yield pa.array([model.count(t) for t in texts.to_pylist()], pa.int64())
        finally:
            model.seen.clear()
            kernels.give_back()

    return tokens(text)


def count_tokens(df: DataFrame, model_path: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    Null text counts as empty: 0 bytes, 0 tokens, not over the limit. Rows are neither dropped nor
    merged, so ties and repeats stay; columns of these names that are there already are replaced.
    A very long text is one row; its pieces' counts are what is held. All other columns stay, whatever their
    names; an empty table gives an empty result. One scan, no shuffle.
    """
    out = df.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"),
        "n_tokens": token_count(F.col(text), model_path),
    })
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
