"""Quality rules with adaptive thresholds.

A pass over the texts counts words, symbols, repeated lines and repeated word windows. Per
language and source, a mergeable quantile sketch of each rate gives the thresholds; rows are
joined with their group's thresholds and judged.

The sketch is a histogram over bins of fixed relative width (``sketch_bin``): counts of equal
bins add up, in tasks before the shuffle and from sources to languages to the whole corpus,
and a quantile is the bin where the running count passes the rank. Bins are integers, so
results do not depend on how the rows were partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from daywatch.llm.text import free_name, stored, with_columns

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: A group with fewer documents uses the sketch of its language, then that of all documents.
GROUP_ROWS = 100
#: A threshold lies this many spreads beyond the median.
SPREADS = 6
#: Rates (per 10,000; word length in hundredths) and the least spread assumed for each.
RATES = {"symbol_rate": 100, "line_rate": 600, "repeat_rate": 800, "word_length": 60}
#: Groups of thresholds up to this many are broadcast (some 200 bytes each, 4 MB).
BROADCAST_GROUPS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
#: UTF-8 bytes that continue a character.
_NOT_START = bytes(range(0x80, 0xC0))


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The values of ``COUNTS`` for one text; null counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    word_chars = len(b"".join(words).translate(None, _NOT_START))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        size = len(known)
        if size > 2_000_000:  # three ids no longer fit in 64 bits: number the pairs first
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].reshape(-1)
            windows = pairs[:-1] * size + ids[2:]
        else:
            windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    return n, word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """Add the counts of each text under ``names``, in the order of ``COUNTS``."""

    def columns(texts: list[bytes | None]) -> list[pa.Array]:
        rows = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return [pa.array(rows[:, i]) for i in range(len(COUNTS))]

    return with_columns(docs, text_col, [StructField(n, LongType()) for n in names], columns)


def rates(c: dict[str, Column]) -> dict[str, Column]:
    """Whole-number rates; a text without words has zeros."""

    def ratio(top: Column, factor: int, below: Column) -> Column:
        return F.coalesce(_div(top * F.lit(factor), below), F.lit(0).cast("long"))

    return {
        "symbol_rate": ratio(c["n_symbols"], 10_000, c["word_chars"]),
        "line_rate": ratio(c["n_dup_lines"], 10_000, c["n_lines"]),
        "repeat_rate": ratio(c["n_repeat_words"], 10_000, c["n_words"]),
        "word_length": ratio(c["word_chars"], 100, c["n_words"]),
    }


def _div(top: Column, below: Column) -> Column:
    """Whole-number division, null for a zero divisor."""
    return F.when(below > 0, F.call_function("div", top, F.greatest(below, F.lit(1)).cast("long")))


def sketch_bin(value: Column) -> Column:
    """The value with all but its seven leading bits cleared: at most 1.6 percent below it."""
    bits = F.greatest(F.length(F.bin(value)) - F.lit(7), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of all rates: ``*keys, rate, bin, n``."""
    each = [F.struct(F.lit(r).alias("rate"), sketch_bin(F.col(r)).alias("bin")) for r in RATES]
    return (
        rows.select(*keys, F.explode(F.array(*each)).alias("s"))
        .groupBy(*keys, F.col("s.rate").alias("rate"), F.col("s.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, rows`` and, for each rate, the highest (and for word length the lowest) value allowed."""
    own = [*keys, "rate"]
    upto = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto))
    total = sketch.groupBy(*own).agg(F.sum("n").alias("rows"))
    joined = ranked.join(total, _same(ranked, total, own), "inner").select(*[ranked[c] for c in own], "bin", "upto", "rows")
    quantiles = joined.groupBy(*own).agg(
        F.max("rows").alias("rows"),
        *[F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 2, 3)],
    )

    def at(rate: str, value: Column) -> Column:
        return F.max(F.when(F.col("rate") == rate, value))

    def high(rate: str) -> Column:
        return F.col("q2") + SPREADS * F.greatest(F.col("q2") - F.col("q1"), F.lit(RATES[rate]))

    low = F.col("q2") - SPREADS * F.greatest(F.col("q3") - F.col("q2"), F.lit(RATES["word_length"]))
    return quantiles.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        *[at(r, high(r)).alias(f"max_{r}") for r in RATES],
        at("word_length", low).alias("min_word_length"),
    )


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


LIMITS = [*[f"max_{r}" for r in RATES], "min_word_length"]


def thresholds(rows: DataFrame) -> DataFrame:
    """``lang, source`` and the limits in force there, from rows with these columns and the rates.

    The rows are those of documents that pass the base rules. A group of fewer than
    ``GROUP_ROWS`` documents takes the limits of its
    language, a language of fewer those of the corpus. Null languages and sources are groups
    like others.
    """
    groups = stored(sketches(rows, ["lang", "source"]), "sketches")
    langs = merge_sketches(groups, ["lang"])
    own, lang, every = fences(groups, ["lang", "source"]), fences(langs, ["lang"]), fences(
        merge_sketches(langs.withColumn("all", F.lit(1)), ["all"]), ["all"]
    )
    lang = lang.select(F.col("lang").alias("_lang"), F.col("rows").alias("_rows"), *[F.col(c).alias("l_" + c) for c in LIMITS])
    every = every.select(*[F.col(c).alias("e_" + c) for c in LIMITS])
    # every is a single row of five limits
    joined = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]), "left").join(F.broadcast(every))
    pick = lambda c: (
        F.when(F.col("rows") >= GROUP_ROWS, F.col(c))
        .when(F.col("_rows") >= GROUP_ROWS, F.col("l_" + c))
        .otherwise(F.col("e_" + c))
    )
    return stored(joined.select("lang", "source", *[pick(c).alias(c) for c in LIMITS]), "thresholds")


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality``: the counts, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated three-word windows.
    ``kept``: not base_failed, and no rate beyond its group's threshold. A null text has no
    words and fails; null languages and sources form groups of their own. Every row is judged
    alone, repeated rows included, so none are merged; an empty table gives an empty result.
    If ``quality`` is taken by an input column, the struct's name gets an underscore before it.
    """
    names = [free_name(docs, name) for name in COUNTS]
    counted = with_counts(docs, text_col, names)
    c = {k: F.col(n) for k, n in zip(COUNTS, names)}
    base_failed = (c["n_words"] < MIN_WORDS) | (
        c["n_repeat_words"] * 100 > c["n_words"] * F.lit(MAX_REPEATED_PERCENT)
    )
    rate = rates(c)
    limits = thresholds(
        counted.where(~base_failed).select(
            F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *[rate[r].alias(r) for r in RATES]
        )
    )
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*LIMITS).alias("_limits"))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = counted.join(
        limits, counted[lang_col].eqNullSafe(limits["_l"]) & counted[source_col].eqNullSafe(limits["_s"]), "left"
    )
    within = F.lit(True)
    for r in RATES:
        within = within & (rate[r] <= limits["_limits"][f"max_{r}"])
    within = within & (rate["word_length"] >= limits["_limits"]["min_word_length"])
    verdict = F.struct(
        *[c[k].alias(k) for k in COUNTS], base_failed.alias("base_failed"), (~base_failed & F.coalesce(within, F.lit(False))).alias("kept")
    )
    return joined.select(*[counted[x] for x in docs.columns], verdict.alias(free_name(docs, "quality")))


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows that ``judge`` keeps, with the columns of ``docs``."""
    quality = free_name(docs, "quality")
    return judge(docs, **columns).where(F.col(quality)["kept"]).select(*docs.columns)
