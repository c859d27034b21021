"""Quality rules with thresholds that adapt to each language and source.

Every measure of a document (parts per million of its words or lines) goes into a mergeable quantile sketch of
its (language, source): counts in buckets whose width grows with the value, so a quantile is within 1/32 of its
value and sketches merge by adding counts. Documents that fail the base rules teach nothing. The group's own
quantiles set both fences of a measure:

    lower quartile - REACH * spread  <=  value  <=  upper quartile + REACH * spread

The spread is the interquartile range, but no less than what the least occurrence (one symbol, one line, two
windows of three words) makes of a document of the group's median length, and no less than the sketch's
resolution (1/32 of the upper quartile). So a measure that is zero in three of
four documents still has a fence: ``REACH`` least occurrences in a median document. No threshold is a fixed share.
Groups of few documents use their language's merged sketch, and failing that everyone's. Documents are then
filtered by a join.

All of it is DataFrame expressions: one scan for the measures, a partial aggregate for the sketches, a join
with one small row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import WORD, broadcast_if_small, fresh, scratch, words_of

#: Measure -> what is counted, of what, and the least that can occur of it.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6), "word_chars": ("word_chars", "n_words", 1),
}

#: Fences lie REACH spreads beyond the quartiles; shares are parts of SCALE. Groups under LEAST_ROWS use a merged sketch.
REACH, SCALE, LEAST_ROWS = 6, 1_000_000, 50

#: Hard rules: fewer words than this fail, or more than this share of repeated words (per cent).
MIN_WORDS, MAX_REPEATS = 50, 50


def measures(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Append ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``n_lines``.

    Null text counts as empty: all are 0. ``n_repeat_words`` counts words covered by three-word windows that
    occur at least twice in the text; windows are compared by 64-bit hash.
    """
    words, grams, found, raw = (fresh(df, n) for n in ("q_words", "q_grams", "q_found", "q_text"))
    lines = F.filter(F.split(F.col(raw), "\n", -1), lambda x: x.rlike(WORD))
    out = df.withColumn(raw, F.coalesce(F.col(text), F.lit(""))).withColumns({
        words: words_of(F.col(raw)),
        "word_chars": F.length(F.regexp_replace(F.col(raw), r"[\x20\x09-\x0D]+", "")).cast("bigint"),
        "n_symbols": F.regexp_count(F.col(raw), F.lit(r"[#*$%&|<>]")).cast("bigint"),
        fresh(df, "q_lines"): lines,
    })
    at = fresh(df, "q_lines")
    w = F.col(words)
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "n_lines": F.size(at).cast("bigint"),
        "n_dup_lines": (F.size(at) - F.size(F.array_distinct(at))).cast("bigint"),
        grams: F.when(F.size(w) >= 3, F.sort_array(windows)).otherwise(none),
    }).drop(words, at, raw)
    g = F.col(grams)
    same = lambda x, k: F.coalesce(F.get(g, k)["h"] == x["h"], F.lit(False))
    again = F.filter(g, lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn(found, F.sort_array(F.transform(again, lambda x: x["i"]))).drop(grams)
    p = F.col(found)
    covered = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop(found)
    # Through a generator, so that no filter on a measure is pushed below and works all of them out again.
    made = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
    return out.select(*kept, F.inline(F.array(F.struct(*made))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Lower end of a sketch bucket: exact below 64, then 32 buckets to each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def shares() -> dict[str, Column]:
    """Every measure in parts of ``SCALE``; 0 where there is nothing to measure."""
    div = lambda x, y: F.call_function("div", x, F.greatest(y, F.lit(1).cast("bigint")))
    return {m: div(SCALE * F.col(part), F.col(whole).cast("bigint")) for m, (part, whole, _) in MEASURES.items()}


def sketch(measured: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quantile sketches of documents that pass the base rules: ``lang, source, measure, bucket, n``.

    ``n_words`` and ``n_lines`` are sketched besides the shares. Merge by summing ``n``.
    """
    values = shares() | {"n_words": F.col("n_words"), "n_lines": F.col("n_lines")}
    rows = [F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in values.items()]
    long = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(F.array(*rows)))
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartile_fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """``docs`` behind each group and ``low_<measure>, high_<measure>`` from its sketch counts."""
    merged = counts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "measure")  # a sketch has a bounded number of buckets
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"_upto": F.sum("n").over(upto), "docs": F.sum("n").over(whole)})
    at = lambda quarters: F.min(F.when(4 * F.col("_upto") >= quarters * F.col("docs"), F.col("bucket")))
    q = ranked.groupBy(*by, "measure").agg(at(1).alias("_q1"), at(2).alias("_q2"), at(3).alias("_q3"), F.max("docs").alias("docs"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    out = []
    for m, (_, size, least) in MEASURES.items():
        spread = F.greatest(of(m, "_q3") - of(m, "_q1"), F.call_function("div", F.lit(SCALE * least).cast("bigint"), of(size, "_q2")), F.call_function("div", of(m, "_q3"), F.lit(32).cast("bigint")))
        out += [(of(m, "_q1") - REACH * spread).alias(f"low_{m}"), (of(m, "_q3") + REACH * spread).alias(f"high_{m}")]
    return q.groupBy(*by).agg(F.max("docs").alias("docs"), *out)


#: The fences of a group.
FENCES = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]


def fences(measured: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with its ``FENCES``, from its own or a merged sketch.

    Groups without a document that passes the base rules have no row.
    """
    counts = scratch(sketch(measured, lang=lang, source=source), "quality-sketch")
    own = quartile_fences(counts, ["lang", "source"])
    wide = quartile_fences(counts, ["lang"]).select(F.col("lang").alias("_l"), F.col("docs").alias("_ld"), *[F.col(c).alias(f"_l_{c}") for c in FENCES])
    every = quartile_fences(counts.withColumn("_", F.lit(0)), ["_"]).first()  # one row of as many numbers as there are fences
    out = own.join(wide, F.col("lang").eqNullSafe(F.col("_l")), "left")

    def pick(c: str) -> Column:
        rest = F.lit(every[c] if every else None).cast("bigint")
        return F.when(F.col("docs") >= LEAST_ROWS, F.col(c)).when(F.col("_ld") >= LEAST_ROWS, F.col(f"_l_{c}")).otherwise(rest)

    return scratch(out.select("lang", "source", *[pick(c).alias(c) for c in FENCES]), "quality-fences")


def judge(measured: DataFrame, limits: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Append ``base_failed`` and ``kept`` by joining every document with its group's fences."""
    small = broadcast_if_small(limits).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = measured.join(small, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    beyond = F.lit(False)
    for m, v in shares().items():
        b = bucket(v)  # fences are made of buckets, too
        beyond = beyond | F.coalesce((b < F.col(f"low_{m}")) | (b > F.col(f"high_{m}")), F.lit(False))
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond)
    return out.drop("_lang", "_source", *FENCES)


def assess(df: DataFrame, *, ident: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``.

    Null text is empty and fails; null languages and sources are groups of their own; repeated rows are
    judged alike; a very long text is one row, measured like any other; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    narrow = df.select(F.col(ident).alias("ident"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = scratch(measures(narrow).drop("text"), "quality-measures")
    out = judge(measured, fences(measured))
    return out.select(F.col("ident").alias(ident), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with its columns as they were, whatever they are called.

    Rows that pass the base rules are stored once beside their measures, so that texts are measured once. Nulls, repeated rows, very long
    texts and empty tables as in ``assess``.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held")
    rows = df.select(held, F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = scratch(measures(rows).drop("text").where(~base_failed()), "quality-rows")
    return judge(measured, fences(measured.drop("held"))).where("kept").select("held.*")


#: DuckDB SQL of ``assess`` with the default parameters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, lang, source, words, text, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, unnest(range(1, n_words - 1)) AS i, words FROM l WHERE n_words >= 3
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, lang, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id
), t AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS bad, greatest(n_words, 1)::BIGINT AS w, greatest(n_lines, 1)::BIGINT AS z FROM m
), v AS (
  SELECT doc_id, lang, source, bad, unnest(['symbols', 'dup_lines', 'repeats', 'word_chars']) AS measure, unnest([1, 1, 6, 1]) AS least, unnest([w, z, w, w]) AS size,
    unnest([1000000 * n_symbols // w, 1000000 * n_dup_lines // z, 1000000 * n_repeat_words // w, 1000000 * word_chars // w])::BIGINT AS x
  FROM t
), u AS (
  SELECT *, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)::BIGINT) << (length(bin(x)) - 6)::BIGINT END AS bucket,
    CASE WHEN size < 64 THEN size ELSE (size >> (length(bin(size)) - 6)::BIGINT) << (length(bin(size)) - 6)::BIGINT END AS size_bucket FROM v
), b AS (
  SELECT * FROM u WHERE NOT bad
), q AS (
  SELECT lang, source, measure, grouping(source) AS no_source, grouping(lang) AS no_lang, count(*) AS docs, quantile_disc(bucket, 0.25) AS q1,
    quantile_disc(bucket, 0.75) AS q3, any_value(least) AS least, quantile_disc(size_bucket, 0.5) AS size
  FROM b GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))
), s AS (
  SELECT *, greatest(q3 - q1, 1000000 * least // size, q3 // 32) AS spread FROM q
), f AS (
  SELECT own.lang, own.source, own.measure,
    CASE WHEN own.docs >= 50 THEN own.q1 - 6 * own.spread WHEN wide.docs >= 50 THEN wide.q1 - 6 * wide.spread ELSE every.q1 - 6 * every.spread END AS low,
    CASE WHEN own.docs >= 50 THEN own.q3 + 6 * own.spread WHEN wide.docs >= 50 THEN wide.q3 + 6 * wide.spread ELSE every.q3 + 6 * every.spread END AS high
  FROM (SELECT * FROM s WHERE no_source = 0 AND no_lang = 0) own
    JOIN (SELECT * FROM s WHERE no_source = 1 AND no_lang = 0) wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.measure = wide.measure
    JOIN (SELECT * FROM s WHERE no_lang = 1) every ON own.measure = every.measure
), o AS (
  SELECT DISTINCT u.doc_id FROM u JOIN f ON u.lang IS NOT DISTINCT FROM f.lang AND u.source IS NOT DISTINCT FROM f.source AND u.measure = f.measure WHERE bucket < low OR bucket > high
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND o.doc_id IS NULL AS kept
FROM m LEFT JOIN o ON m.doc_id = o.doc_id
"""
