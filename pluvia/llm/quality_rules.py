"""Quality rules with risk-controlled thresholds, in Spark's own functions only.

Every text gets counts (words, symbols, repeated lines, repeated stretches of eight words) and, from these, one badness:
the largest of its rule measures, each divided by the rule's usual limit.  A text is rejected when its badness is above
the cutoff of its stratum.  Cutoffs come from labelled holdouts: for each cutoff of a fixed grid and each stratum, the
number of good texts that it would reject is held against an exact binomial bound.  A cutoff is certified when the
probability of so few rejections, were the false-rejection rate the allowed one, is at most the error level divided by
the number of (stratum, cutoff) tests (Bonferroni); the strictest certified cutoff is used.  So with the stated
confidence no stratum rejects more than the allowed share of its good texts.

Defined cases: a null or empty text has no words and fails the base rule; strata without a certified cutoff (few or no
labelled texts) reject nothing beyond the base rule; a null stratum is a stratum of its own; labels other than 0 and 1
are left out; repeated rows count each; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise

WINDOW = 8
#: Rule measures and their usual limits (a text at its limit has badness 1).
LIMITS = {"symbols": 0.10, "capitals": 0.30, "lines": 0.30, "repeats": 0.20}
#: Cutoffs that are tested, in units of the limits: from 4 down to a hundredth, in equal ratios.
GRID = [round(4 * 400 ** (-i / 39), 6) for i in range(40)]
BLANK = r"[ \t-\r]"
WORD_CHARACTER = r"[^ \t-\r]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a name inside a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: Column) -> Column:
    """One 64-bit hash for each window of eight words: hashes of words, then of neighbouring pairs, fours and eights."""

    def paired(hashes: Column, apart: int) -> Column:
        return let(hashes, lambda h: F.zip_with(
            h, F.slice(h, F.lit(apart + 1), F.greatest(F.size(h) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y)))

    eights = paired(paired(paired(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return F.slice(eights, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def covered_words(windows: Column) -> Column:
    """Words in windows whose hash occurs again in the text: sorted by hash, equal windows are neighbours."""

    def repeated(by_hash: Column) -> Column:
        return F.filter(by_hash, lambda x, j: F.coalesce(F.get(by_hash, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(by_hash, j + 1)["h"] == x["h"], F.lit(False)))

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.get(places, j + 1) - p, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(by_hash, lambda v: let(F.sort_array(F.transform(repeated(v), lambda x: x["i"])), total))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """One row of counts and the badness for each text; no shuffle."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), stratum.alias("stratum"))
    rows = rows.withColumns({
        "_words": F.filter(F.split(text, BLANK + "+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    })
    rows = rows.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": let(window_hashes(F.col("_words")), lambda w: F.when(
            F.size(F.array_distinct(w)) < F.size(w), covered_words(w)).otherwise(F.lit(0).cast("long"))),
    }).drop("_text", "_words", "_lines")
    n_words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "symbols": F.col("n_symbols") / chars, "capitals": F.col("n_capitals") / chars,
        "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / n_words,
    }
    return rows.withColumns({
        "badness": F.greatest(*[shares[k] / F.lit(limit) for k, limit in LIMITS.items()]),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: moved up by eight and then Stirling's series (error below 1e-12)."""
    y = x + 8.0
    moved = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - moved


def binomial_tail(k: Column, n: Column, p: float, terms: int = 20_000) -> Column:
    """P(X <= k) for X binomial(n, p), summed from k downwards while k is below the mean; 1 otherwise.

    The terms fall at least geometrically below the mean, by the ratio r of the last two; what lies beyond ``terms``
    terms is bounded by that series, so the value is never too small.
    """
    n, k = n.cast("double"), k.cast("double")
    log_term = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(log_term).alias("term"))

    def step(s: Column, j: Column) -> Column:
        i = k - j
        ratio = i * (1 - p) / ((n - i + 1) * p)
        return F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * ratio).alias("term"))

    r = k * (1 - p) / ((n - k + 1) * p)
    tail = F.aggregate(steps, start, step, lambda s: s["sum"] + s["term"] / F.greatest(1 - r, F.lit(1e-12)))
    return F.when(k < n * p, F.least(tail, F.lit(1.0))).otherwise(1.0)


def certified_cutoffs(
    described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    allowed: float = 0.01, error: float = 0.05,
) -> DataFrame:
    """(stratum, cutoff, good, rejected, p_value) of the strictest certified cutoff of each stratum that has one.

    One map-side combined aggregate counts, for all cutoffs at once, the good texts above each.
    """
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id"))
    holdout = described.filter(~F.col("base_failed")).select("doc_id", "stratum", "badness")
    holdout = holdout.join(good, F.col("doc_id") == F.col("_id"))
    counts = holdout.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("good"),
        *[F.count_if(F.col("badness") > c).alias(f"_{i}") for i, c in enumerate(GRID)])
    tests = counts.select("stratum", "good", F.count(F.lit(1)).over(_all()).alias("_strata"), F.posexplode(F.array(
        *[F.col(f"_{i}") for i in range(len(GRID))])).alias("_i", "rejected"))
    tests = tests.withColumns({
        "cutoff": F.get(F.array(*map(F.lit, GRID)), F.col("_i")),
        "p_value": binomial_tail(F.col("rejected"), F.col("good"), allowed),
    }).filter(F.col("p_value") * len(GRID) * F.col("_strata") <= error)
    best = F.min_by(F.struct("cutoff", "good", "rejected", "p_value"), "cutoff").alias("b")
    return tests.groupBy("stratum").agg(best).select("stratum", "b.*")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang",
    label_col: str = "quality", allowed: float = 0.01, error: float = 0.05,
) -> DataFrame:
    """Counts, badness, the stratum's cutoff and the verdict of every text.  The texts are read once: their counts are
    written and read again for the cutoffs and for the verdicts."""
    described = materialise(describe(docs, id_col, text_col, stratum_col))
    cutoffs = materialise(certified_cutoffs(described, labels, id_col, label_col, allowed, error))
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoff")
    joined = described.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    bad = F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad)
