"""Distribution profiles, calendar profiles, extremes, and the tables behind charts.

``keys`` name the series columns; with ``keys=[]`` the whole table is one
group.  ``rows_bound`` is the proven number of rows of one group; without it
every ordered statistic takes the distributed route of ``functions.ordering``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.functions.ordering import (
    TASK_ROWS,
    Series,
    exact_percentiles,
    longest_series,
    most_frequent,
    series,
    value_counts,
    with_positions,
)
from pluvia.functions.stats import aggregate, kurt_adjusted, label_ladder, skew_adjusted
from pluvia.functions.storage import materialise
from pluvia.functions.tails import normal_quantile
from pluvia.operators.clean import to_long
from pluvia.operators.features import rain_band

# Cut points of the verbal reading of skewness and kurtosis.
SKEW_STEPS = [
    (1, "Highly right-skewed (lệch phải mạnh)"),
    (0.5, "Moderately right-skewed (lệch phải vừa)"),
    (-0.5, "Approximately symmetric (gần đối xứng)"),
    (-1, "Moderately left-skewed (lệch trái vừa)"),
]
SKEW_LOWEST = "Highly left-skewed (lệch trái mạnh)"
KURT_HIGH = "Leptokurtic (nhọn hơn normal)"
KURT_LOW = "Platykurtic (tù hơn normal)"
KURT_MIDDLE = "Mesokurtic (gần normal)"


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Equi-join two tables with one row per group.  Two one-row tables are put
    side by side by a union and one aggregate."""
    if groups:
        return left.join(right, list(groups))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def with_group_facts(df: DataFrame, groups: Sequence[str], facts: dict[str, Column]) -> DataFrame:
    """Adds per-group aggregates to every row.

    The aggregates of the whole table come back as constants; those of groups
    join on the group columns, broadcast only if the planner finds them small.
    """
    found = df.groupBy(*groups).agg(*[c.alias(n) for n, c in facts.items()])
    return attach_facts(df, found, groups)


def attach_facts(df: DataFrame, found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Joins a table of one row per group to every row of the groups.

    The table is written first, so that the planner knows its size: it takes an aggregate to be as large as its input,
    and a shuffle by few groups would send all rows to few tasks."""
    groups = list(groups)
    if not groups:
        row = found.first()
        return df.withColumns({
            n: F.lit(row[n] if row else None).cast(found.schema[n].dataType) for n in found.columns
        })
    return df.join(materialise(found), groups)


def with_series_facts(df: DataFrame, s: Series, facts: dict[str, Column]) -> DataFrame:
    """Adds plain per-series aggregates to every row: a window next to the other
    windows of a bounded series (no second scan), group facts otherwise."""
    if s.keys and s.rows_bound is not None and s.rows_bound <= s.block_rows:
        whole = Window.partitionBy(*s.keys)
        return df.withColumns({n: c.over(whole) for n, c in facts.items()})
    return with_group_facts(df, s.keys, facts)


def calendar_profile(
    df: DataFrame,
    target: str,
    unit: Column,
    unit_name: str,
    aggs: Sequence[str] = ("mean", "std", "median", "count"),
    keys: Sequence[str] = (),
    decimals: int | None = None,
    rows_bound: int | None = None,
) -> DataFrame:
    """Target statistics per month, day of year, year, or any other unit."""
    groups = [*keys, unit_name]
    rows = df.withColumn(unit_name, unit)
    plain = [a for a in aggs if a != "median" or rows_bound is not None]
    out = rows.groupBy(*groups).agg(*[aggregate(a, F.col(target)).alias(a) for a in plain])
    if len(plain) < len(aggs):
        out = out.join(exact_percentiles(rows, groups, target, {"median": 0.5}), groups, "left")
    shown = [
        F.round(a, decimals).alias(a) if decimals is not None and a != "count" else F.col(a)
        for a in aggs
    ]
    return out.select(*groups, *shown)


def seasonal_patterns(
    df: DataFrame,
    target: str,
    date_col: str,
    time_units: Sequence[str] = ("Month", "DayOfYear", "Year"),
    aggs: Sequence[str] = ("mean", "std", "median", "count"),
    quantile_threshold: float = 0.75,
    keys: Sequence[str] = (),
    rows_bound: int | None = None,
) -> dict[str, DataFrame]:
    day = F.col(date_col)
    units = {"Month": F.month(day), "DayOfYear": F.dayofyear(day), "Year": F.year(day)}
    out = {
        u: calendar_profile(
            df, target, units[u], u, aggs, keys, 4 if u == "Month" else None, rows_bound
        ) for u in time_units
    }
    if "Month" in time_units:
        out["season_months"] = wet_dry_months(df, target, date_col, quantile_threshold, keys)
    return out


def wet_dry_months(
    df: DataFrame, target: str, date_col: str, quantile_threshold: float = 0.75,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Months whose mean is above the q-quantile (wet) or below the 1-q one (dry)
    of the at most twelve monthly means of a series."""
    monthly = df.groupBy(*keys, F.month(date_col).alias("Month")).agg(F.avg(target).alias("mean"))
    if not keys:
        monthly = monthly.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*(keys or ["_all"]))
    q = quantile_threshold
    marked = monthly.withColumns({
        "_hi": F.percentile("mean", F.lit(q)).over(w),
        "_lo": F.percentile("mean", F.lit(1 - q)).over(w),
    })
    label = F.when(F.col("mean") > F.col("_hi"), "wet").when(F.col("mean") < F.col("_lo"), "dry")
    return marked.withColumn("season", label).filter("season IS NOT NULL").select(
        *keys, "Month", "season", "mean"
    )


def descriptive_stats(
    df: DataFrame, columns: list[str], keys: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """One row per (keys, Feature); columns without data do not appear."""
    groups = [*keys, "Feature"]
    if rows_bound is None:
        rows_bound = longest_series(df, keys)
    long = to_long(df, list(keys), columns, "Feature", "v").filter("v IS NOT NULL")
    v = F.col("v")
    moments = long.groupBy(*groups).agg(
        F.count(v).alias("Count"), F.avg(v).alias("Mean"), F.stddev_samp(v).alias("Std"),
        F.var_samp(v).alias("Variance"), F.min(v).alias("Min"), F.max(v).alias("Max"),
        skew_adjusted(v).alias("Skewness"), kurt_adjusted(v).alias("Kurtosis"),
    )
    counts = value_counts(long, groups, "v")
    probs = {"P5": 0.05, "Q1": 0.25, "Median": 0.5, "Q3": 0.75, "P95": 0.95}
    if rows_bound <= TASK_ROWS:  # mode and quantiles from one table of values
        q = F.percentile(v.cast("double"), F.array(*[F.lit(p) for p in probs.values()]), F.col("cnt"))
        best = F.max(F.struct(F.col("cnt"), (-v).alias("neg")))
        order = counts.groupBy(*groups).agg(q.alias("_q"), best.alias("_m")).select(
            *groups, (-F.col("_m.neg")).alias("Mode"), *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    else:
        order = most_frequent(counts, groups, "v", "Mode").join(exact_percentiles(long, groups, "v", probs, rows_bound), groups)
    spread = F.coalesce(F.try_divide(F.col("Std") * 100, F.col("Mean")), F.lit(float("inf")))
    return moments.join(order, groups).select(
        *groups, "Count", "Mean", "Median", "Mode", "Std", "Variance",
        spread.alias("CV_pct"), "Min", "P5", "Q1", "Q3", "P95", "Max",
        (F.col("Max") - F.col("Min")).alias("Range"), (F.col("Q3") - F.col("Q1")).alias("IQR"),
        "Skewness", "Kurtosis",
    )


def skew_reading(c: Column) -> Column:
    return label_ladder(c, SKEW_STEPS, SKEW_LOWEST)


def kurtosis_reading(c: Column) -> Column:
    return F.when(c > 3, KURT_HIGH).when(c < -3, KURT_LOW).when(c.isNotNull(), KURT_MIDDLE)


def target_profile(
    df: DataFrame, target: str, keys: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """The descriptive row of the target with its shape in words."""
    return descriptive_stats(df, [target], keys, rows_bound).withColumns({
        "skew_interpretation": skew_reading(F.col("Skewness")),
        "kurtosis_interpretation": kurtosis_reading(F.col("Kurtosis")),
    })


def band_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, *b) for i, b in enumerate(C.RAIN_BANDS)],
        "band_no int, band string, lo double, hi double, label_vi string, label_en string",
    )


def rain_band_counts(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days and percentage per rain band; empty bands count 0.

    All bands are counted in one aggregate row per key and then turned into
    rows, so empty bands need no join.
    """
    x = F.col(target)
    band = rain_band(x)
    total = F.count(x)
    entries = F.array(*[
        F.struct(
            F.lit(key).alias("band"), F.lit(vi).alias("label_vi"), F.lit(en).alias("label_en"),
            F.count_if(band == key).alias("days"),
            F.try_divide(F.count_if(band == key) * 100.0, total).alias("percentage"),
        ) for key, _, _, vi, en in C.RAIN_BANDS
    ])
    return df.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.inline("_e"))


def shape_comparison(
    df: DataFrame, columns: list[str], target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Skewness and kurtosis per feature, with the target and |skew| > 1 marked."""
    long = to_long(df, list(keys), columns, "Feature", "v").filter("v IS NOT NULL")
    return long.groupBy(*keys, "Feature").agg(
        skew_adjusted(F.col("v")).alias("Skewness"), kurt_adjusted(F.col("v")).alias("Kurtosis")
    ).withColumns({
        "Is_Target": F.col("Feature") == target, "High_Skew": F.abs("Skewness") > 1,
    })


# --- extremes -----------------------------------------------------------------

def percentile_name(p: float) -> str:
    # Three well-known names, any other p is named by its thousandths.
    known = {0.95: "p95", 0.99: "p99", 0.999: "p99_9"}
    return known.get(p, f"p{int(p * 1000)}")


def extreme_thresholds(
    df: DataFrame,
    target: str,
    percentiles: Sequence[float] = (0.95, 0.99, 0.999),
    keys: Sequence[str] = (),
    rows_bound: int | None = None,
) -> DataFrame:
    """Exact percentile thresholds and the days strictly above each."""
    names = {percentile_name(p): p for p in percentiles}
    clean = df.select(*keys, F.col(target).cast("double").alias("x")).filter("x IS NOT NULL")
    limits = exact_percentiles(clean, keys, "x", names, rows_bound)
    rows = attach_facts(clean, limits, keys)
    entries = F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.lit(float(p)).alias("percentile"),
            F.first(n).alias("threshold"), F.count_if(F.col("x") > F.col(n)).alias("extreme_days"),
            F.count(F.lit(1)).alias("total_days"),
        ) for n, p in names.items()
    ])
    return rows.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.inline("_e"))


def above_percentile(
    df: DataFrame, target: str, percentile: float = 0.95, keys: Sequence[str] = (),
    rows_bound: int | None = None,
) -> DataFrame:
    """Rows strictly above the percentile, with ``threshold`` added."""
    clean = df.filter(F.col(target).isNotNull())
    limit = exact_percentiles(clean, keys, target, {"threshold": percentile}, rows_bound)
    rows = attach_facts(clean, limit, keys)
    return rows.filter(F.col(target) > F.col("threshold"))


def count_extreme_events(
    df: DataFrame, target: str, threshold: float | None = None, percentile: float = 0.95,
    keys: Sequence[str] = (), rows_bound: int | None = None,
) -> DataFrame:
    """Days above an absolute threshold, or above a percentile of the series."""
    if threshold is not None:
        return df.groupBy(*keys).agg(F.count_if(F.col(target) > threshold).alias("extreme_days"))
    name = percentile_name(percentile)
    found = extreme_thresholds(df, target, [percentile], keys, rows_bound)
    counted = found.filter(F.col("name") == name).select(*keys, "extreme_days")
    if keys:
        return counted
    return counted.agg(F.coalesce(F.sum("extreme_days"), F.lit(0).cast("long")).alias("extreme_days"))


def extremes_by_month(
    df: DataFrame, target: str, date_col: str, percentile: float = 0.95,
    keys: Sequence[str] = (), rows_bound: int | None = None,
) -> DataFrame:
    """Extreme days per month; ``is_peak`` marks the first month with most of them."""
    hot = above_percentile(df, target, percentile, keys, rows_bound)
    monthly = hot.groupBy(*keys, F.month(date_col).alias("Month")).agg(
        F.count(F.lit(1)).alias("extreme_days")
    )
    if not keys:
        monthly = monthly.withColumn("_all", F.lit(0))
    first = Window.partitionBy(*(keys or ["_all"])).orderBy(F.desc("extreme_days"), "Month")
    return monthly.withColumn("is_peak", F.row_number().over(first) == 1).drop("_all")


def return_periods(
    df: DataFrame, target: str, top: int = 100, keys: Sequence[str] = (), tie: str | None = None
) -> DataFrame:
    """The ``top`` largest values with rank and rows / rank (all rows count).

    A rank filter limits every task before the shuffle; the report is top-k.
    """
    order = [F.col(target).desc_nulls_last(), *([F.col(tie)] if tie else [])]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        best = df.select(*keys, *([tie] if tie else []), target).withColumn(
            "rank", F.row_number().over(w)
        ).filter(F.col("rank") <= top)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        best = best.join(sizes, list(keys))
    else:
        n = df.count()
        w = Window.partitionBy("_all").orderBy(*order)
        best = (
            df.select(*([tie] if tie else []), target).orderBy(*order).limit(top)
            .withColumn("_all", F.lit(0)).withColumn("rank", F.row_number().over(w))
            .drop("_all").withColumn("n", F.lit(n))
        )
    return best.withColumn("return_period", F.col("n") / F.col("rank")).drop("n")


# --- tables behind charts -----------------------------------------------------

def histogram(
    df: DataFrame, column: str, bins: int = 30, groups: Sequence[str] = ()
) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes the maximum."""
    x = F.col(column)
    rows = with_group_facts(
        df.select(*groups, x.cast("double").alias("x")).filter("x IS NOT NULL"), groups,
        {"lo": F.min("x"), "hi": F.max("x"), "n": F.count("x")},
    )
    flat = F.col("hi") == F.col("lo")
    start = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / bins)
    slot = F.least(F.floor((F.col("x") - start) / width), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(*groups, slot.alias("bin"), start.alias("_s"), width.alias("_w"), "n").agg(
        F.count(F.lit(1)).alias("days")
    )
    return counted.select(
        *groups, "bin", (F.col("_s") + F.col("bin") * F.col("_w")).alias("bin_start"), "days",
        (F.col("days") / (F.col("n") * F.col("_w"))).alias("density"),
    )


#: Terms of the expansion of a Gaussian kernel in a cell of half a bandwidth; what is left out is below 0.25^12 / sqrt(12!),
#: about 3e-12, of the kernel's height for each value.
KERNEL_TERMS = 12
#: Bandwidths beyond which a kernel is below 3e-16 of its height and is not added.
KERNEL_REACH = 8.5


def density_grid(df: DataFrame, column: str, points: int = 200, groups: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid from min to max; NULL where the values have no spread.

    A fast Gauss transform: values collapse into cells of half a bandwidth, each with the first moments of its values
    about its middle, and the grid reads the cells near each of its points through Hermite polynomials.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    facts = with_group_facts(rows, groups, {"lo": F.min("x"), "hi": F.max("x"), "n": F.count("x"), "_sd": F.stddev_samp("x")})
    width = F.col("_sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    facts = facts.withColumn("h", F.when(width > 0, width))
    place = F.floor((F.col("x") - F.col("lo")) / (F.col("h") / 2))
    middle = F.col("lo") + (F.col("_cell") + 0.5) * F.col("h") / 2
    placed = facts.withColumn("_cell", place).withColumn("_u", (F.col("x") - middle) / F.col("h"))
    power, moments = F.lit(1.0), []
    for k in range(KERNEL_TERMS):
        moments.append((F.sum(power) / math.factorial(k)).alias(f"_m{k}"))
        power = power * F.col("_u")
    cells = placed.groupBy(*groups, "lo", "hi", "n", "h", "_cell").agg(*moments).withColumn("_middle", middle)
    step = (F.col("hi") - F.col("lo")) / (points - 1)

    def bound(side: int) -> Column:
        return (F.col("_middle") + side * KERNEL_REACH * F.col("h") - F.col("lo")) / step

    first = F.greatest(F.ceil(bound(-1)), F.lit(0)).cast("int")
    last = F.least(F.floor(bound(1)), F.lit(points - 1)).cast("int")
    read = cells.filter("h IS NOT NULL").filter(last >= first).withColumn("point", F.explode(F.sequence(first, last)))
    z = (F.col("lo") + step * F.col("point") - F.col("_middle")) / F.col("h")
    read = read.withColumn("_z", z)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("k"))

    def term(s: Column, m: Column) -> Column:
        return F.struct((s["sum"] + m * s["now"]).alias("sum"), s["now"].alias("before"),
                        (F.col("_z") * s["now"] - s["k"] * s["before"]).alias("now"), (s["k"] + 1).alias("k"))

    series_sum = F.aggregate(F.array(*[F.col(f"_m{k}") for k in range(KERNEL_TERMS)]), start, term, lambda s: s["sum"])
    kernel = F.exp(-0.5 * F.col("_z") * F.col("_z")) * series_sum
    sums = read.groupBy(*groups, "point").agg(F.sum(kernel).alias("_sum"))
    grid = cells.groupBy(*groups).agg(*[F.max(c).alias(c) for c in ("lo", "hi", "n", "h")])
    grid = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    same = F.col("point") == F.col("_point")
    for i, k in enumerate(groups):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(groups)], F.col("point").alias("_point"), "_sum")
    density = F.coalesce(F.col("_sum"), F.lit(0.0)) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.join(sums, same, "left").select(
        *groups, "point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)).alias("at"), density.alias("density"))


def empirical_cdf(
    df: DataFrame, column: str, groups: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """(value, position i, i / n) for every row; equal values keep successive i."""
    rows = df.select(*groups, F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    if rows_bound is not None and groups:
        w = Window.partitionBy(*groups)
        placed = rows.withColumns({
            "position": F.row_number().over(w.orderBy("value")).cast("long"),
            "n": F.count(F.lit(1)).over(w),
        })
    else:
        placed = with_group_facts(
            with_positions(rows, series(groups, "value")), groups, {"n": F.count(F.lit(1))}
        ).withColumn("position", (F.col("_pos") + 1).cast("long"))
    return placed.select(
        *groups, "value", "position", (F.col("position") / F.col("n")).alias("cumulative"),
    )


def qq_points(
    df: DataFrame, column: str, groups: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """Ordered values against normal quantiles of Filliben's medians."""
    cdf = empirical_cdf(df, column, groups, rows_bound).withColumn(
        "n", F.round(F.col("position") / F.col("cumulative"))
    )
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    medians = (
        F.when(F.col("position") == 1, 1 - last).when(F.col("position") == F.col("n"), last)
        .otherwise((F.col("position") - 0.3175) / (F.col("n") + 0.365))
    )
    return cdf.withColumn("_m", medians).select(
        *groups, "position", "value", normal_quantile(F.col("_m")).alias("theoretical")
    )


def box_numbers(
    df: DataFrame, column: str, groups: Sequence[str], rows_bound: int | None = None
) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and outlier count."""
    rows = df.select(*groups, F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    quartiles = exact_percentiles(rows, groups, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows_bound)
    joined = attach_facts(rows, quartiles, groups)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return joined.groupBy(*groups, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
