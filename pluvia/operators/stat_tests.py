"""Normality battery and rank tests, one job for all features of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.functions.ordering import (
    average_ranks,
    cumulative_sums,
    ranks_from_counts,
    series,
    value_counts,
    with_positions,
)
from pluvia.functions.storage import materialise
from pluvia.functions.tails import (
    chi2_sf,
    correlation_p,
    let,
    normal_cdf,
    normal_quantile,
    normal_two_sided,
    yes_no,
)
from pluvia.operators.clean import to_long
from pluvia.operators.correlation import weighted_correlation
from pluvia.operators.profile import attach_facts

LEVEL = 0.05
GROUPS = ["Feature"]


def seeded_sample(long: DataFrame, rows: int, id_col: str, seed: int = 42) -> DataFrame:
    """The ``rows`` rows of every feature with the smallest seeded hash of their id.

    Hashes are spread evenly, so a bound on the hash that lets through twelve standard deviations more than ``rows``
    leaves a set of that size to order, whatever the size of the feature.  The sizes (one row per feature) are
    broadcast, so that no rows travel before that bound."""
    sizes = F.broadcast(long.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("_n")))
    share = F.least(F.lit(1.0), F.lit(rows + 12 * math.sqrt(rows) + 50) / F.col("_n"))
    hashed = F.xxhash64(F.col(id_col), F.lit(seed))
    few = long.join(sizes, GROUPS).withColumn("_h", hashed).filter(F.col("_h") <= (share * 2 - 1) * float(2 ** 63))
    w = Window.partitionBy(*GROUPS).orderBy("_h", id_col)
    return few.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows).drop("_rn", "_h", "_n")


# --- moments ------------------------------------------------------------------

def skew_z(g1: Column, n: Column) -> Column:
    """D'Agostino's transformed skewness."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    u = F.when(y == 0, 1.0).otherwise(y) / F.sqrt(2 / (w2 - 1))
    return F.log(u + F.sqrt(u * u + 1)) / F.sqrt(0.5 * F.log(w2))


def kurtosis_z(g2: Column, n: Column) -> Column:
    """Anscombe and Glynn's transformed kurtosis."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    base = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(base) * F.pow((1 - 2 / a) / F.greatest(F.abs(base), F.lit(1e-300)), F.lit(1 / 3))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


def moment_facts(long: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """(groups, Sample_Size, mean, std, g1, g2): what the tests need besides order."""
    v = F.col("v")
    return long.groupBy(*groups).agg(
        F.count(v).alias("Sample_Size"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
    )


def moment_tests(
    long: DataFrame, groups: Sequence[str] = GROUPS, min_rows: int = 8, facts: DataFrame | None = None
) -> DataFrame:
    """Jarque-Bera, skewness, kurtosis and D'Agostino K2 from one aggregate."""
    base = (facts if facts is not None else moment_facts(long, groups)).drop("_mean", "_sd").filter(
        F.col("Sample_Size") >= min_rows
    )
    n = F.col("Sample_Size").cast("double")
    g1, g2 = F.coalesce("g1", F.lit(0.0)), F.coalesce("g2", F.lit(0.0))
    stats = base.withColumns({
        "JB_Stat": n / 6 * (g1 * g1 + g2 * g2 / 4),
        "Skew_Stat": skew_z(g1, n),
        "Kurt_Stat": kurtosis_z(g2, n),
    })
    k2 = F.pow("Skew_Stat", F.lit(2)) + F.pow("Kurt_Stat", F.lit(2))
    return stats.withColumn("DAgostino_Stat", k2).withColumns({
        "JB_P": F.exp(-F.col("JB_Stat") / 2),
        "Skew_P": normal_two_sided(F.col("Skew_Stat")),
        "Kurt_P": normal_two_sided(F.col("Kurt_Stat")),
        "DAgostino_P": F.exp(-F.col("DAgostino_Stat") / 2),
    }).drop("g1", "g2")


# --- order statistics ---------------------------------------------------------

def anderson_darling(
    long: DataFrame, groups: Sequence[str] = GROUPS, rows_bound: int | None = None,
    facts: DataFrame | None = None, ranked: DataFrame | None = None,
) -> DataFrame:
    """A2 against the fitted normal and its 5 % critical value.

    Equal values share their term, so the sum runs over distinct values only
    (``ranked``: their ``average_ranks``, if they are known).
    """
    groups = list(groups)
    counts = ranked if ranked is not None else average_ranks(long, groups, "v", rows_bound=rows_bound)
    facts = facts if facts is not None else moment_facts(long, groups)
    rows = attach_facts(counts, facts.select(*groups, "_mean", "_sd"), groups)
    z = F.try_divide(F.col("v") - F.col("_mean"), F.col("_sd"))
    low = F.col("cnt").cast("double") * (2.0 * F.col("below") + F.col("cnt"))
    above = F.col("total") - F.col("below") - F.col("cnt")
    high = F.col("cnt").cast("double") * (2.0 * above + F.col("cnt"))
    floor = F.lit(1e-300)
    placed = rows.withColumn("_z", z)
    term = low * F.log(F.greatest(normal_cdf(F.col("_z")), floor)) + high * F.log(
        F.greatest(normal_cdf(-F.col("_z")), floor)
    )
    n = F.max("total").cast("double")
    # Fixed value: 5 % point of A2 with both parameters estimated.
    critical = F.round(0.787 / (1 + 4 / n - 25 / n / n), 3)
    return placed.groupBy(*groups).agg(
        (-n - F.sum(term) / n).alias("AD_Stat"), critical.alias("AD_Critical_5pct")
    )


# Royston (1995, AS R94) polynomials, highest power first.
SW_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157]
SW_NEXT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]
SW_MEAN_SMALL = [-0.0006714, 0.025054, -0.39978, 0.5440]
SW_SD_SMALL = [-0.0020322, 0.062767, -0.77857, 1.3822]
SW_MEAN_LARGE = [0.0038915, -0.083751, -0.31082, -1.5861]
SW_SD_LARGE = [0.0030302, -0.082676, -0.4803]


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


#: Positions of equal values that are listed together.
TIE_STRETCH = 4096


def tie_positions(ranked: DataFrame, stretch: int = TIE_STRETCH) -> DataFrame:
    """One row per row that ``average_ranks`` counted, with its 0-based ``_pos``.

    Only the values were ordered; runs of equal values are listed in stretches that are spread over tasks first, so that
    neither a value that is most of a column nor few files of many runs fill one task."""
    spread = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start, end = F.col("_start"), F.col("below") + F.col("cnt")
    runs = ranked.withColumn("_start", F.explode(F.sequence(F.col("below"), end - 1, F.lit(stretch).cast("long"))))
    listed = F.sequence(start, F.least(start + stretch, end) - 1)
    return runs.repartition(spread, "_start").withColumn("_pos", F.explode(listed)).drop("_start")


def shapiro_wilk(
    long: DataFrame, groups: Sequence[str] = GROUPS, rows_bound: int | None = None,
    facts: DataFrame | None = None, ranked: DataFrame | None = None,
) -> DataFrame:
    """W and its p value (Royston's approximation, 6 rows or more).

    With ``ranked`` (``average_ranks`` of the values) nothing is ordered again: equal values stand in a row."""
    groups = list(groups)
    facts = facts if facts is not None else moment_facts(long, groups)
    known = facts.select(*groups, F.col("Sample_Size").cast("double").alias("_n"), "_mean")
    if ranked is not None:
        placed = tie_positions(attach_facts(ranked, known, groups).filter("_n >= 6"))
    else:
        rows = attach_facts(long.select(*groups, "v"), known, groups).filter("_n >= 6")
        placed = with_positions(rows, series(groups, "v", rows_bound=rows_bound))
    placed = placed.withColumn(
        "_q", normal_quantile((F.col("_pos") + 1 - 0.375) / (F.col("_n") + 0.25))
    ).withColumn("_d", F.col("v") - F.col("_mean"))
    last, first = F.col("_pos") == F.col("_n") - 1, F.col("_pos") == 0
    next_hi, next_lo = F.col("_pos") == F.col("_n") - 2, F.col("_pos") == 1

    def only(flag: Column, c: str) -> Column:
        return F.max(F.when(flag, F.col(c)))

    ends = last | first | next_hi | next_lo
    q = placed.groupBy(*groups).agg(
        F.max("_n").alias("n"), F.sum(F.col("_q") * F.col("_q")).alias("qq"),
        F.sum(F.col("_d") * F.col("_d")).alias("ss"),
        F.sum(F.when(~ends, F.col("_q") * F.col("_d")).otherwise(0.0)).alias("inner"),
        only(last, "_q").alias("q1"), only(next_hi, "_q").alias("q2"),
        (only(last, "_d") - only(first, "_d")).alias("d1"),
        (only(next_hi, "_d") - only(next_lo, "_d")).alias("d2"),
    )
    u = 1 / F.sqrt("n")
    a1 = _poly([*SW_LAST, 0.0], u) + F.col("q1") / F.sqrt("qq")
    a2 = _poly([*SW_NEXT, 0.0], u) + F.col("q2") / F.sqrt("qq")
    weights = q.withColumns({"a1": a1, "a2": a2})
    phi = (F.col("qq") - 2 * F.col("q1") * F.col("q1") - 2 * F.col("q2") * F.col("q2")) / (
        1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2")
    )
    top = F.col("a1") * F.col("d1") + F.col("a2") * F.col("d2") + F.col("inner") / F.sqrt(phi)
    w = F.least(F.coalesce(F.try_divide(top * top, F.col("ss")), F.lit(1.0)), F.lit(1.0))
    n, logn = F.col("n"), F.log("n")
    miss = F.log(F.greatest(1 - F.col("W"), F.lit(1e-300)))
    gamma = 0.459 * n - 2.273
    small = (-F.log(F.greatest(gamma - miss, F.lit(1e-300))) - _poly(SW_MEAN_SMALL, n)) / F.exp(_poly(SW_SD_SMALL, n))
    large = (miss - _poly(SW_MEAN_LARGE, logn)) / F.exp(_poly(SW_SD_LARGE, logn))
    return weights.withColumn("W", w).withColumn("_z", F.when(n <= 11, small).otherwise(large)).select(
        *groups, F.col("W").alias("Shapiro_Stat"), let(F.col("_z"), lambda v: normal_cdf(-v)).alias("Shapiro_P")
    )


def normality_battery(
    df: DataFrame, columns: list[str], sample_rows: int | None = None, id_col: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """All six tests per feature.  The whole column is tested; ``sample_rows``
    with a row id tests a seeded sample instead.  Values are counted and ordered
    once, for both tests that need their order."""
    ids = [id_col] if sample_rows else []
    long = to_long(df, ids, columns, "Feature", "v").filter("v IS NOT NULL")
    if sample_rows:
        long = materialise(seeded_sample(long, sample_rows, id_col, seed).drop(id_col))
    found = moment_facts(long)
    known = found.collect()  # one row per feature
    facts = df.sparkSession.createDataFrame(known, found.schema)
    counts = materialise(value_counts(long, GROUPS, "v"))
    ranked = materialise(ranks_from_counts(counts, GROUPS, "v").select(*GROUPS, "v", "cnt", "below", "total"))
    out = moment_tests(long, facts=facts).join(shapiro_wilk(long, GROUPS, facts=facts, ranked=ranked), GROUPS).join(
        anderson_darling(long, GROUPS, facts=facts, ranked=ranked), GROUPS
    )
    for test in ("Shapiro", "DAgostino", "JB", "Skew", "Kurt"):
        out = out.withColumn(f"{test}_Normal", yes_no(F.col(f"{test}_P") > LEVEL))
    return out.withColumn("AD_Normal", yes_no(F.col("AD_Stat") < F.col("AD_Critical_5pct")))


# --- rank tests ---------------------------------------------------------------

def rain_group(target: Column) -> Column:
    """0 dry, 1..3 by rising rain amount, NULL below zero."""
    zero, light, moderate = C.RAIN_GROUP_EDGES
    return (
        F.when(target == zero, 0).when((target > zero) & (target <= light), 1)
        .when((target > light) & (target <= moderate), 2).when(target > moderate, 3)
    )


def aligned_cells(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(Feature, v, _t, w): rows where feature and target are present, equal
    pairs combined map-side.  Every rank test below starts from this table."""
    rows = df.withColumn("_t", F.col(target).cast("double"))
    long = to_long(
        rows.filter("_t IS NOT NULL"), ["_t"], [c for c in columns if c != target], "Feature", "v"
    ).filter("v IS NOT NULL")
    return long.groupBy(*GROUPS, "v", "_t").agg(F.count(F.lit(1)).alias("w"))


def group_sizes(cells: DataFrame) -> DataFrame:
    """(Feature, n, n0..n3): aligned rows and rows per rain group; a few numbers per feature."""
    g = rain_group(F.col("_t"))
    return cells.groupBy(*GROUPS).agg(
        F.sum("w").alias("n"), *[F.coalesce(F.sum(F.when(g == i, F.col("w"))), F.lit(0)).alias(f"n{i}") for i in range(4)]
    )


def known_sizes(cells: DataFrame) -> tuple[DataFrame, int]:
    """``group_sizes`` read back (one row per feature) and the largest of them."""
    rows = group_sizes(cells).collect()
    table = cells.sparkSession.createDataFrame(
        [tuple(r) for r in rows], "Feature string, n long, n0 long, n1 long, n2 long, n3 long"
    )
    return table, max((r["n"] for r in rows), default=0)


def ranked_values(
    cells: DataFrame, sizes: DataFrame | None = None, rows_bound: int | None = None, min_rows: int = 3,
) -> DataFrame:
    """One row per (Feature, v) with the rows that each rank test counts there and their mean ranks, from one ordering.

    ``cnt`` all rows, ``mw`` those of the Mann-Whitney test (of which ``dry``), ``kw`` those of the Kruskal-Wallis test,
    by rain group ``g0`` to ``g3``; ``below_*`` the rows of the kind with smaller values."""
    if sizes is None:
        sizes, rows_bound = known_sizes(cells)
    w, group = F.col("w"), rain_group(F.col("_t"))
    own = F.element_at(F.array(*[F.col(f"n{g}") for g in range(4)]), group + 1)
    in_kw = group.isNotNull() & (own > min_rows)

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0))

    counts = attach_facts(cells, sizes.drop("n"), GROUPS).groupBy(*GROUPS, "v").agg(
        F.sum("w").alias("cnt"), rows(F.col("_t") >= 0).alias("mw"), rows(F.col("_t") == 0).alias("dry"),
        rows(in_kw).alias("kw"), *[rows(in_kw & (group == g)).alias(f"g{g}") for g in range(4)],
    )
    return cumulative_sums(counts, GROUPS, "v", ["cnt", "mw", "kw"], rows_bound)


def mean_rank(kind: str) -> Column:
    return F.col(f"below_{kind}") + (F.col(kind) + 1) / F.lit(2.0)


def mann_whitney(ranked: DataFrame, min_rows: int = 5) -> DataFrame:
    """U of the dry days against the rainy ones, two-sided normal p with ties; from ``ranked_values``."""
    t = F.col("mw").cast("double")
    sums = ranked.groupBy(*GROUPS).agg(
        F.sum("dry").cast("double").alias("n1"), F.sum(F.col("mw") - F.col("dry")).cast("double").alias("n2"),
        F.sum(F.col("dry") * mean_rank("mw")).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    enough = (n1 > min_rows) & (n2 > min_rows)
    out = sums.withColumn("MW_Statistic", F.when(enough, u))
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(
        F.greatest(F.col("MW_Statistic"), n1 * n2 - F.col("MW_Statistic")) - n1 * n2 / 2 - 0.5, spread
    )
    p = F.least(erfc_two_sided(z), F.lit(1.0))
    out = out.withColumn("MW_P_Value", F.when(enough, p))
    return out.withColumn(
        "MW_Significant", F.when(enough, yes_no(F.col("MW_P_Value") < LEVEL)).otherwise("N/A")
    ).select(*GROUPS, "MW_Statistic", "MW_P_Value", "MW_Significant")


def erfc_two_sided(z: Column) -> Column:
    """2 P(Z > z) without folding the sign (z may be slightly negative)."""
    return let(z, lambda v: 2 * normal_cdf(-v))


def kruskal_wallis(ranked: DataFrame, min_groups: int = 3) -> DataFrame:
    """H over the rain groups that ``ranked_values`` counts, tie corrected."""
    t = F.col("kw").cast("double")
    sums = ranked.groupBy(*GROUPS).agg(
        F.sum(t).alias("n"), F.sum(t * t * t - t).alias("ties"),
        *[F.sum(f"g{g}").cast("double").alias(f"n{g}") for g in range(4)],
        *[F.sum(F.col(f"g{g}") * mean_rank("kw")).alias(f"r{g}") for g in range(4)],
    )
    n = F.col("n")
    between = sum(
        (F.coalesce(F.try_divide(F.col(f"r{g}") * F.col(f"r{g}"), F.col(f"n{g}")), F.lit(0.0)) for g in range(4)),
        F.lit(0.0),
    )
    k = sum(((F.col(f"n{g}") > 0).cast("int") for g in range(4)), F.lit(0))
    h = F.try_divide(
        12 / (n * (n + 1)) * between - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n)
    )
    scored = sums.withColumn("k", k).withColumn(
        "KW_Statistic", F.when(F.col("k") >= min_groups, h)
    ).withColumn("KW_P_Value", F.when(
        F.col("KW_Statistic").isNotNull(), chi2_sf(F.col("KW_Statistic"), F.col("k") - 1)
    ))
    return scored.withColumn("KW_Significant", F.when(
        F.col("KW_Statistic").isNotNull(), yes_no(F.col("KW_P_Value") < LEVEL)
    ).otherwise("N/A")).select(*GROUPS, "KW_Statistic", "KW_P_Value", "KW_Significant")


def spearman_with_target(cells: DataFrame, ranked: DataFrame, rows_bound: int | None = None) -> DataFrame:
    targets = cells.groupBy(*GROUPS, "_t").agg(F.sum("w").alias("cnt"))
    rt = ranks_from_counts(targets, GROUPS, "_t", rows_bound).select(*GROUPS, "_t", F.col("rank").alias("rt"))
    joined = cells.join(ranked.select(*GROUPS, "v", mean_rank("cnt").alias("rv")), [*GROUPS, "v"]).join(rt, [*GROUPS, "_t"])
    r = weighted_correlation(joined, GROUPS, "rv", "rt", "w")
    return r.withColumn("Spearman_P_Value", correlation_p(F.col("r"), F.col("n"))).select(
        *GROUPS, F.col("n").alias("Aligned_Rows"), F.col("r").alias("Spearman_Corr"), "Spearman_P_Value",
        yes_no(F.coalesce(F.col("Spearman_P_Value") < LEVEL, F.lit(False))).alias("Spearman_Significant"),
    )


def non_parametric_tests(
    df: DataFrame, target: str, columns: list[str], min_rows: int = 20
) -> DataFrame:
    """Mann-Whitney, Kruskal-Wallis and Spearman of every feature in one table."""
    cells = materialise(aligned_cells(df, target, columns))
    sizes, bound = known_sizes(cells)
    ranked = materialise(ranked_values(cells, sizes, bound))  # one ordering of the values for all three tests
    return (
        spearman_with_target(cells, ranked, bound).filter(F.col("Aligned_Rows") >= min_rows)
        .join(mann_whitney(ranked), GROUPS, "left")
        .join(kruskal_wallis(ranked), GROUPS, "left")
    )
