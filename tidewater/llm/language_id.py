"""Language identification as a mixture.

Byte n-gram distributions are learned per language from labelled rows (counted in Spark over hashed
n-grams). A document's text is then explained as a mixture of languages: expectation-maximisation estimates
the proportions, and the set of languages is grown from the best single one as long as the gain in
log-likelihood beats a penalty of half the logarithm of the text's n-grams per language (BIC). The answer is
the language of the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernels
from tidewater.llm.common import fresh

#: Hash buckets of n-grams (a power of two), bytes to an n-gram, labelled documents to learn from at most.
BUCKETS, GRAM, SAMPLE = 1 << 15, 3, 20_000

#: Rounds of expectation-maximisation at most, and the change of proportions that ends them.
ROUNDS, STILL = 30, 1e-4


@dataclass(frozen=True)
class Languages:
    """Names in order, and log-probabilities of n-gram buckets: one row per language."""

    names: tuple[str, ...]
    logp: np.ndarray


def _folded(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


#: ASCII letters and all bytes of longer characters stay, the rest becomes a space.
_LETTER = np.full(256, 0x20, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTER[_b] = _b


def gram_ids(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of each text: letters only, words parted and framed by one space."""
    data, offsets = kernels._buffers(_folded(texts))
    for a, b in zip(offsets[:-1], offsets[1:]):
        raw = np.concatenate(([np.uint8(32)], _LETTER[data[a:b]], [np.uint8(32)]))
        space = raw == 32
        raw = raw[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
        if len(raw) < GRAM:
            yield np.zeros(0, np.int64)
            continue
        code = raw[: len(raw) - GRAM + 1]
        for k in range(1, GRAM):
            code = (code << np.uint32(8)) | raw[k : len(raw) - GRAM + 1 + k]
        yield ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, grams in zip(batch.column(0).to_pylist(), gram_ids(batch.column(1))):
            totals[lang] = totals.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, *, ident: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Languages:
    """Learn from rows with a language and a text; at most ``sample`` rows, those of the least hashes.

    What reaches the driver is languages x ``BUCKETS`` counts at most. No rows: no languages, and every
    prediction is ``und``.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(ident)).alias("h"), F.col(ident).alias("i"))
    edge = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    counts = rows.where(F.col("h") <= F.lit(edge)).select("lang", "text").mapInArrow(_counts, "lang string, gram int, n bigint")
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow() if edge is not None else None
    if got is None or not got.num_rows:
        return Languages((), np.zeros((0, BUCKETS)))
    names = sorted(set(got.column("lang").to_pylist()))
    total = np.full((len(names), BUCKETS), 0.1)
    at = {n: k for k, n in enumerate(names)}
    total[[at[x] for x in got.column("lang").to_pylist()], got.column("gram").to_numpy()] += got.column("n").to_numpy()
    return Languages(tuple(names), np.log(total / total.sum(1, keepdims=True)))


def proportions(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood mixture proportions of the columns of ``p`` (n-grams x languages) and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = counts.sum()
    for _ in range(ROUNDS):
        joint = p * share
        new = (counts / joint.sum(1)) @ joint / total
        still = np.abs(new - share).max() < STILL
        share = new
        if still:
            break
    return share, float(counts @ np.log(p @ share))


def mixture(grams: np.ndarray, logp: np.ndarray) -> dict[int, float]:
    """Languages (by index) of a text and their proportions, from its n-gram buckets."""
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    counts = counts[at].astype(np.float64)
    rows = logp[:, at]
    single = rows @ counts
    chosen = [int(single.argmax())]
    best, share = float(single.max()), np.ones(1)
    penalty = 0.5 * np.log(max(counts.sum(), 2.0))
    shift = rows.max(0)
    p = np.exp(rows - shift).T
    base = float(shift @ counts)
    ceiling = base  # no mixture can be likelier than the best language for every n-gram
    while len(chosen) < len(logp) and ceiling > best + penalty:
        found = []
        for k in range(len(logp)):
            if k not in chosen:
                s, fit = proportions(p[:, [*chosen, k]], counts)
                found.append((fit + base, k, s))
        fit, k, s = max(found, key=lambda x: (x[0], -x[1]))
        if fit <= best + penalty:
            break
        chosen, best, share = [*chosen, k], fit, s
    return dict(zip(chosen, share.tolist()))


def identify(texts: pa.Array, model: Languages, lettered: list[bool]) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, mixture) of each text; the score is the language's proportion."""
    for grams, has in zip(gram_ids(texts), lettered):
        if not has or not len(grams) or not model.names:
            yield "und", 0.0, []
            continue
        got = sorted(mixture(grams, model.logp).items(), key=lambda x: (-x[1], x[0]))
        parts = [{"lang": model.names[k], "share": min(1.0, max(0.0, s))} for k, s in got]
        yield parts[0]["lang"], parts[0]["share"], parts


def predict(df: DataFrame, model: Languages, *, text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` (0 to 1) and ``languages`` (all found, with their shares).

    Null texts and texts without a letter are ``und`` with score 0. Rows are kept one to one; columns of these
    names are replaced, all others stay. Ties go to the language of the smaller name; repeated rows are told alike. A very long
    text is one row, of which ``BUCKETS`` counts are held. An empty table gives an empty result. The model is
    broadcast: languages x ``BUCKETS`` numbers.
    """
    names, logp = model.names, df.sparkSession.sparkContext.broadcast(model.logp.astype(np.float64))

    @F.arrow_udf("struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def told(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        rows = list(identify(texts, Languages(names, logp.value), lettered.to_pylist()))
        part = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], part)],
            names=["lang_pred", "score", "languages"],
        )

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    plain = df.drop("lang_pred", "score", "languages") if text not in ("lang_pred", "score", "languages") else df
    made = fresh(plain, "told")
    out = plain.withColumn(made, told(F.col(text), lettered))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in ("lang_pred", "score", "languages")}).drop(made)


def held_out(ident: Column) -> Column:
    """Rows kept from learning: a fixed quarter by CRC-32 of the identifier; null identifiers are not."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))
