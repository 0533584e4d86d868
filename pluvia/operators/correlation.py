"""Correlation matrices, seasonal / rolling / lagged correlation, VIF, PCA,
feature clusters and the feature network.

The O(rows) part is always a Spark aggregate; only matrices whose size is the
number of columns are handled with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C
from pluvia.functions.ordering import Series, cumulative_sums, over_frames, ranks_from_counts
from pluvia.functions.stats import both, safe_corr
from pluvia.functions.storage import materialise
from pluvia.operators.features import rolling_correlation, season_of
from pluvia.operators.profile import join_groups

PAIRS_IN_ONE_AGGREGATE = 150


def feature_category(name: Column, target: str = C.TARGET_LABEL, terms=None) -> Column:
    """Category of a feature by the terms its name contains, target last."""
    branches = F
    for category, words in terms or C.FEATURE_TERMS:
        hit = name.contains(words[0])
        for w in words[1:]:
            hit = hit | name.contains(w)
        branches = branches.when(hit, category)
    return branches.when(name == target, "Precipitation").otherwise("Other")


def feature_groups(spark, columns: list[str], target: str, terms=None) -> DataFrame:
    """(category, features): the target is Precipitation, "Other" is left out."""
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "n int, feature string")
    feature = F.col("feature")
    category = F.when(feature == target, "Precipitation").otherwise(
        feature_category(feature, target, terms)
    )
    sorted_names = F.array_sort(F.collect_list(F.struct("n", "feature")))
    return names.withColumn("category", category).filter(F.col("category") != "Other").groupBy(
        "category"
    ).agg(F.transform(sorted_names, lambda s: s["feature"]).alias("features"))


def pair_correlations(
    df: DataFrame, columns: list[str], keys: Sequence[str] = (),
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """(keys, feature_a, feature_b, n, r) of the listed column pairs, pairwise complete.

    Few pairs: one aggregate row with one expression per pair.  Many: matrix
    products of Arrow blocks, added up by pair.
    """
    pairs = pairs if pairs is not None else list(combinations(columns, 2))
    if len(pairs) <= PAIRS_IN_ONE_AGGREGATE:
        entries = F.array(*[
            F.struct(
                F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                F.count_if(both(F.col(a), F.col(b))).alias("n"),
                safe_corr(F.col(a), F.col(b)).alias("r"),
            ) for a, b in pairs
        ])
        return df.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.inline("_e"))
    return _wide_correlations(df, keys, pairs)


#: Numbers that a task keeps of the matrices of its keys before it hands them on.
OPEN_NUMBERS = 1 << 22


def _wide_correlations(df: DataFrame, keys: Sequence[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Many pairs: each task multiplies its Arrow blocks with their masks (X'X, X'M, (X^2)'M, M'M), so a row costs one row
    of a matrix product; Spark adds up the six sums of each pair.  Values are shifted by the column's overall mean, which
    keeps the sums of squares exact enough; NaN makes the pairs it is complete in NaN."""
    keys = list(keys)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    left, right = (np.array([at[p[side]] for p in pairs]) for side in (0, 1))
    middle = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([0.0 if v is None else float(v) for v in middle])
    kind = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("_a", "_b")]
                        + [T.StructField(c, T.DoubleType()) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "bad")])

    def add(batches):
        held: dict[tuple, list] = {}

        def flush():
            for key, (xx, xm, qm, mm, bad) in held.items():
                sums = {"_a": left.astype(np.int32), "_b": right.astype(np.int32), "n": mm[left, right], "sx": xm[left, right], "sy": xm[right, left],
                        "sxx": qm[left, right], "syy": qm[right, left], "sxy": xx[left, right], "bad": bad[left, right] + bad[right, left]}
                out = pd.DataFrame(sums)
                for name, value in zip(keys, key, strict=True):
                    out[name] = value
                yield out[kind.names]
            held.clear()

        for pdf in batches:
            parts = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in parts:
                there = part["_there"]
                m = np.array(there.tolist(), bool).reshape(len(part), len(columns)).astype(float)
                x = part[[f"_v{i}" for i in range(len(columns))]].to_numpy(float)
                nan = np.isnan(x) & (m > 0)
                x = np.where(np.isnan(x), 0.0, x - shift) * m
                key = tuple(None if v is not None and v != v else v for v in (key if isinstance(key, tuple) else (key,)))
                made = [x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m, nan.astype(float).T @ m]
                held[key] = [a + b for a, b in zip(held[key], made, strict=True)] if key in held else made
                if len(held) * 5 * len(columns) ** 2 >= OPEN_NUMBERS:
                    yield from flush()
        yield from flush()

    values = [F.col(c).cast("double") for c in columns]
    rows = df.select(*keys, F.array(*[v.isNotNull() for v in values]).alias("_there"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    sums = rows.mapInPandas(add, kind).groupBy(*keys, "_a", "_b").agg(*[F.sum(c).alias(c) for c in kind.names[len(keys) + 2:]])
    n = F.col("n")

    def centred(both_: str, a: str, b: str) -> Column:
        return F.try_divide(F.col(both_) - F.try_divide(F.col(a) * F.col(b), n), n)

    r = F.try_divide(centred("sxy", "sx", "sy"), F.sqrt(F.greatest(centred("sxx", "sx", "sx"), F.lit(0.0))) * F.sqrt(F.greatest(centred("syy", "sy", "sy"), F.lit(0.0))))
    names = F.array(*map(F.lit, columns))
    return sums.select(*keys, F.get(names, F.col("_a")).alias("feature_a"), F.get(names, F.col("_b")).alias("feature_b"), n.cast("long").alias("n"),
                       F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise(r).alias("r"))


def pearson_matrix(df: DataFrame, columns: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs i < j of the Pearson matrix in long form."""
    return pair_correlations(df, columns, keys)


def spearman_matrix(
    df: DataFrame, columns: list[str], keys: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """Pearson correlation of average ranks, ranks taken inside each pair's complete rows.

    Columns without gaps are ranked once each; with gaps once for each pattern
    of gaps (``_ranks_by_pattern``).
    """
    if not keys:
        sizes = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        if all(sizes[f"c{i}"] == sizes["n"] for i in range(len(columns))):
            return pearson_matrix(_ranked_columns(df, columns, sizes["n"]), columns)
    return _ranks_by_pattern(df, columns, list(keys), rows_bound)


#: Pairs whose ranks are correlated in one aggregate.
PAIRS_AT_ONCE = 60


def _ranks_by_pattern(df: DataFrame, columns: list[str], keys: list[str], rows_bound: int | None) -> DataFrame:
    """Spearman with gaps.  Rows fall into patterns of present columns.  The rank of a value among the rows of a pair is a
    sum over the patterns that have both columns: of the rows below it and half of those equal to it.  So each column is
    ordered once, with one running count for each pattern, and no row becomes a row for each pair."""
    values = [F.col(c).cast("double") for c in columns]
    mask = F.lit("")
    for v in values:
        mask = F.concat(mask, v.isNotNull().cast("int").cast("string"))
    rows = materialise(df.select(*keys, mask.alias("_mask"), *[v.alias(f"_v{i}") for i, v in enumerate(values)]))
    patterns = sorted(r["_mask"] for r in rows.select("_mask").distinct().collect())  # 2 ^ columns at most, few in practice
    ranked = rows
    for i in range(len(columns)):
        own = [p for p, m in enumerate(patterns) if m[i] == "1"]
        x = f"_v{i}"
        inside = {p: (F.col("_mask") == patterns[p]).cast("long") for p in own}
        if keys and rows_bound is not None:
            order = Window.partitionBy(*keys).orderBy(x)
            upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            ties = order.rangeBetween(Window.currentRow, Window.currentRow)
            share = [F.sum(inside[p]).over(upto) - F.sum(inside[p]).over(ties) / 2 for p in own]
            ranked = ranked.withColumn(f"_r{i}", F.when(F.col(x).isNotNull(), F.array(*share) if own else F.array().cast("array<double>")))
            continue
        counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(*[F.sum(inside[p]).alias(f"_c{p}") for p in own])
        if not own:
            ranked = ranked.withColumn(f"_r{i}", F.lit(None).cast("array<double>"))
            continue
        sums = cumulative_sums(counts, keys, x, [f"_c{p}" for p in own])
        share = F.array(*[F.col(f"below__c{p}") + F.col(f"_c{p}") / 2 for p in own]).alias(f"_r{i}")
        named = sums.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(x).alias("_x"), share)
        same = F.col(x) == F.col("_x")
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
        ranked = ranked.join(named, same, "left").drop("_x", *[f"_k{n}" for n in range(len(keys))])
    pairs = list(combinations(range(len(columns)), 2))
    if len(pairs) > PAIRS_AT_ONCE:
        ranked = materialise(ranked)

    def rank(i: int, other: int) -> Column:
        own = [p for p, m in enumerate(patterns) if m[i] == "1"]
        parts = [F.get(f"_r{i}", n) for n, p in enumerate(own) if patterns[p][other] == "1"]
        return sum(parts, F.lit(0.5))

    out = None
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        entries = F.array(*[F.struct(
            F.lit(columns[a]).alias("feature_a"), F.lit(columns[b]).alias("feature_b"),
            F.count_if(both(F.col(f"_v{a}"), F.col(f"_v{b}"))).alias("n"),
            safe_corr(F.when(F.col(f"_v{b}").isNotNull(), rank(a, b)), F.when(F.col(f"_v{a}").isNotNull(), rank(b, a))).alias("r"),
        ) for a, b in pairs[start: start + PAIRS_AT_ONCE]])
        part = ranked.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.inline("_e"))
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")


def _ranked_columns(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The columns replaced by their average ranks.  A rank table has one row
    per distinct value, so the planner broadcasts it or splits a hot value."""
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        counts = df.groupBy(F.col(c).cast("double").alias(c)).agg(F.count(F.lit(1)).alias("cnt"))
        ranks = ranks_from_counts(counts, [], c, rows).select(c, F.col("rank").alias("_rank"))
        out = out.join(ranks, c).drop(c).withColumnRenamed("_rank", c)
    return out


def weighted_correlation(df: DataFrame, groups: list[str], x: str, y: str, w: str) -> DataFrame:
    """Correlation of (x, y) rows that each stand for ``w`` equal rows.

    Mean ranks of n rows average (n + 1) / 2, so the ranks are centred there
    before they are multiplied.
    """
    n = F.sum(w)
    sizes = df.groupBy(*groups).agg(n.alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    shifted = df.join(sizes, groups).withColumns({
        "_x": F.col(x) - F.col("_mx"), "_y": F.col(y) - F.col("_my"),
    })

    def total(c: Column) -> Column:
        return F.sum(F.col(w) * c)

    sx, sy = total(F.col("_x")), total(F.col("_y"))
    sxx, syy = total(F.col("_x") * F.col("_x")), total(F.col("_y") * F.col("_y"))
    sxy = total(F.col("_x") * F.col("_y"))
    size = F.max("n")
    r = F.try_divide(sxy - sx * sy / size, F.sqrt((sxx - sx * sx / size) * (syy - sy * sy / size)))
    return shifted.groupBy(*groups).agg(size.alias("n"), r.alias("r"))


def nonlinearity_matrix(
    df: DataFrame, columns: list[str], keys: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """Spearman minus Pearson for every pair."""
    on = [*keys, "feature_a", "feature_b"]
    linear = pearson_matrix(df, columns, keys).select(*on, F.col("r").alias("pearson"))
    ranked = spearman_matrix(df, columns, keys, rows_bound).select(*on, F.col("r").alias("spearman"))
    return linear.join(ranked, on).withColumn("difference", F.col("spearman") - F.col("pearson"))


def target_correlations(
    df: DataFrame, target: str, columns: list[str], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, feature, n, r) of every column with the target."""
    pairs = [(target, c) for c in columns if c != target]
    return pair_correlations(df, columns, keys, pairs).select(
        *keys, F.col("feature_b").alias("feature"), "n", "r"
    )


def rank_predictors(
    df: DataFrame, target: str, columns: list[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Predictors by |r| with the strong (> .3) and moderate (> .2) ones named."""
    size = F.abs("r")
    strength = F.when(size > 0.3, "strong").when(size > 0.2, "moderate").otherwise("weak")
    return target_correlations(df, target, columns, keys).withColumn("strength", strength).orderBy(
        *keys, size.desc(), "feature"
    )


def top_variables(
    df: DataFrame, target: str, columns: list[str], n: int = 2, keys: Sequence[str] = ()
) -> DataFrame:
    """The n columns with the highest signed correlation with the target."""
    corr = target_correlations(df, target, columns, keys)
    if not keys:
        return corr.orderBy(F.col("r").desc_nulls_last(), "feature").limit(n).select("feature", "r")
    w = Window.partitionBy(*keys).orderBy(F.col("r").desc_nulls_last(), "feature")
    return corr.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(
        *keys, "feature", "r"
    )


def seasonal_correlations(
    df: DataFrame, target: str, columns: list[str], date_col: str, keys: Sequence[str] = (),
    min_rows: int = 30,
) -> DataFrame:
    """Correlation with the target inside each season that has more than ``min_rows`` days."""
    groups = [*keys, "season"]
    pairs = [c for c in columns if c != target]
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), safe_corr(F.col(c), F.col(target)).alias("r"))
        for c in pairs
    ])
    return (
        df.withColumn("season", season_of(F.col(date_col))).groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("days"), entries.alias("_e"))
        .filter(F.col("days") > min_rows).select(*groups, "days", F.inline("_e"))
    )


def daily_means(df: DataFrame, columns: list[str], date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of every measure per (keys, date); days missing any measure are dropped.

    This is also the step that bounds a series by its calendar: copies and
    repeated readings of a day combine map-side, however many there are.
    """
    return df.groupBy(*keys, date_col).agg(*[F.avg(c).alias(c) for c in columns]).na.drop("any")


def rolling_correlation_summary(
    daily: DataFrame, target: str, variables: list[str], window: int = 30, *, by: Series
) -> DataFrame:
    """Mean and std over time of the rolling correlation; stable when std < .1."""
    out = None
    for v in variables:
        rolled = rolling_correlation(daily.select(*by.keys, by.order, target, v), target, v, window, by=by)
        one = rolled.filter("rolling_corr IS NOT NULL").groupBy(*by.keys).agg(
            F.avg("rolling_corr").alias("mean_correlation"),
            F.stddev_samp("rolling_corr").alias("std_correlation"),
        ).withColumn("feature", F.lit(v))
        out = one if out is None else out.unionByName(one)
    stable = F.when(F.col("std_correlation") < 0.1, "Stable").otherwise("Variable")
    return out.select(*by.keys, "feature", "mean_correlation", "std_correlation", stable.alias("stability"))


def lagged_correlations(
    daily: DataFrame, target: str, variables: list[str], max_lag: int = 5, *, by: Series
) -> DataFrame:
    """(keys, feature, lag, r): a positive lag compares the target with the variable
    that many rows earlier, a negative one with the variable that many rows later."""
    lags = range(-max_lag, max_lag + 1)
    shifted = over_frames(daily, by, max_lag, max_lag, lambda w: {
        f"_s{i}_{k + max_lag}": F.lag(v, k).over(w)
        for i, v in enumerate(variables) for k in lags
    })
    entries = F.array(*[
        F.struct(
            F.lit(v).alias("feature"), F.lit(k).alias("lag"),
            F.coalesce(safe_corr(F.col(target), F.col(f"_s{i}_{k + max_lag}")), F.lit(0.0)).alias("r"),
        ) for i, v in enumerate(variables) for k in lags
    ])
    return shifted.groupBy(*by.keys).agg(entries.alias("_e")).select(*by.keys, F.inline("_e"))


def best_lag(lagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lag with the largest |r| per feature, the first one on ties."""
    w = Window.partitionBy(*keys, "feature").orderBy(F.abs("r").desc(), "lag")
    return lagged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        *keys, "feature", F.col("lag").alias("best_lag"), F.col("r").alias("best_correlation")
    )


def feature_quality(
    df: DataFrame, target: str, columns: list[str], corr_threshold: float = 0.05,
    var_threshold: float = 0.01, missing_threshold: float = 0.1,
) -> DataFrame:
    """Correlation with the target, variance, missing share and the drop flags.

    An undefined correlation is not a low one."""
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), safe_corr(F.col(c), F.col(target)).alias("correlation"),
            F.var_samp(F.col(c).cast("double")).alias("variance"),
            F.avg(F.col(c).isNull().cast("double")).alias("missing_share"),
        ) for c in columns if c != target
    ])
    facts = df.agg(entries.alias("_e")).select(F.inline("_e"))
    low_r = F.coalesce(F.abs("correlation") < corr_threshold, F.lit(False))
    low_v = F.coalesce(F.col("variance") < var_threshold, F.lit(False))
    gaps = F.col("missing_share") > missing_threshold
    return facts.withColumns({
        "low_correlation": low_r, "low_variance": low_v, "high_missing": gaps,
        "recommended_to_drop": low_r | low_v | gaps,
    })


# --- multicollinearity --------------------------------------------------------

def correlation_array(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """k x k matrix over rows complete in all columns (k = number of columns)."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")
    place = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    n = 0
    for row in pearson_matrix(complete, columns).collect():
        i, j = place[row["feature_a"]], place[row["feature_b"]]
        m[i, j] = m[j, i] = np.nan if row["r"] is None else row["r"]
        n = row["n"]
    return m, n


def risk_level(vif: Column) -> Column:
    return F.when(vif < 5, "Low").when(vif < 10, "Moderate").otherwise("High")


def vif_table(df: DataFrame, columns: list[str], target: str = C.TARGET_LABEL, terms=None) -> DataFrame:
    """Variance inflation factors = diagonal of the inverse correlation matrix."""
    matrix, _ = correlation_array(df, columns)
    try:
        scores = np.diag(np.linalg.inv(matrix)) if np.isfinite(matrix).all() else None
    except np.linalg.LinAlgError:
        scores = None
    if scores is None:
        return vif_by_closest_pair(df, columns, target, terms)
    table = df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, scores)], "Feature string, VIF_Score double"
    )
    return _with_risk(table, target, terms)


def vif_by_closest_pair(
    df: DataFrame, columns: list[str], target: str = C.TARGET_LABEL, terms=None
) -> DataFrame:
    """Fallback score 1 / (1 - max r^2), 100 where the closest |r| reaches .99."""
    complete = df.select(*columns).na.drop("any")
    pairs = pearson_matrix(complete, columns)
    sides = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("Feature"), F.abs("r").alias("a"))
    closest = sides.groupBy("Feature").agg(F.max("a").alias("a"))
    score = F.when(F.col("a") < 0.99, 1 / (1 - F.col("a") * F.col("a"))).otherwise(100.0)
    return _with_risk(closest.select("Feature", score.alias("VIF_Score")), target, terms)


def _with_risk(table: DataFrame, target: str, terms) -> DataFrame:
    return table.withColumns({
        "Category": feature_category(F.col("Feature"), target, terms),
        "Risk_Level": risk_level(F.col("VIF_Score")),
    }).orderBy(F.desc("VIF_Score"), "Feature")


def vif_by_category(vif: DataFrame) -> DataFrame:
    return vif.groupBy("Category").agg(
        F.avg("VIF_Score").alias("mean_vif"), F.max("VIF_Score").alias("max_vif"),
        F.count(F.lit(1)).alias("n_features"),
    )


def vif_by_risk(vif: DataFrame) -> DataFrame:
    return vif.groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("n_features"))


def vif_summary(vif: DataFrame) -> DataFrame:
    v = F.col("VIF_Score")
    return vif.agg(
        F.count_if(v > 10).alias("high"), F.count_if((v > 5) & (v <= 10)).alias("moderate"),
        F.count_if(v <= 5).alias("low"), F.avg(v).alias("mean_vif"),
        F.median(v).alias("median_vif"), F.stddev_samp(v).alias("std_vif"),
    )


# --- PCA and clusters ---------------------------------------------------------

def pca_against_target(
    df: DataFrame, columns: list[str], target: str, show: int = 5
) -> DataFrame:
    """Explained share, cumulative share and correlation with the target of the
    first components of the standardised columns."""
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_t")
    ).na.drop("any", subset=columns)
    k = len(columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors)
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(scaled)
    parts = vector_to_array("_pc")
    wide = model.transform(scaled).select("_t", parts.alias("_a"))
    n = min(show, k)
    entries = F.array(*[
        F.struct(
            F.lit(f"PC{i + 1}").alias("PC"),
            safe_corr(F.col("_a")[i], F.col("_t")).alias("Target_Correlation"),
        ) for i in range(n)
    ])
    corr = wide.agg(entries.alias("_e")).select(F.inline("_e"))
    shares = [float(v) for v in model.explainedVariance.toArray()]
    table = df.sparkSession.createDataFrame(
        [(f"PC{i + 1}", shares[i], float(sum(shares[: i + 1]))) for i in range(n)],
        "PC string, Explained_Variance double, Cumulative_Variance double",
    )
    return table.join(corr, "PC").select(
        "PC", "Explained_Variance", "Cumulative_Variance", "Target_Correlation"
    )


def ward_merges(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward linkage of a k x k distance matrix (k = number of columns)."""
    k = len(distance)
    d = {(i, j): float(distance[i, j]) for i in range(k) for j in range(i + 1, k)}
    size = {i: 1 for i in range(k)}
    merges = []
    for step in range(k - 1):
        (a, b), height = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        new = k + step
        for c in [c for c in size if c not in (a, b)]:
            ac, bc = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
            total = size[a] + size[b] + size[c]
            squared = (
                (size[a] + size[c]) * ac**2 + (size[b] + size[c]) * bc**2 - size[c] * height**2
            ) / total
            d[(c, new)] = float(np.sqrt(max(squared, 0.0)))
        d.pop((a, b))
        size[new] = size.pop(a) + size.pop(b)
        merges.append((a, b, height))
    return merges


def feature_clusters(df: DataFrame, columns: list[str], n_clusters: int | None = None) -> DataFrame:
    """(feature, cluster): Ward clusters of the columns at distance 1 - |r|."""
    k = len(columns)
    wanted = max(1, n_clusters or min(5, k // 3))
    matrix, _ = correlation_array(df, columns)
    distance = 1 - np.abs(np.nan_to_num(matrix))
    members = {i: [i] for i in range(k)}
    for step, (a, b, _h) in enumerate(ward_merges(distance)):
        if len(members) <= wanted:
            break
        members[k + step] = members.pop(a) + members.pop(b)
    label = {}
    for number, group in enumerate(sorted(members.values(), key=min), start=1):
        label.update({columns[i]: number for i in group})
    return df.sparkSession.createDataFrame(
        [(c, label[c]) for c in columns], "feature string, cluster int"
    )


# --- network ------------------------------------------------------------------

def network_edges(df: DataFrame, columns: list[str], threshold: float = 0.25) -> DataFrame:
    """(feature_a, feature_b, correlation, weight) for pairs with |r| at the threshold."""
    return pearson_matrix(df, columns).filter(F.abs("r") >= threshold).select(
        "feature_a", "feature_b", F.col("r").alias("correlation"), F.abs("r").alias("weight")
    )


def _held(edges: DataFrame) -> DataFrame:
    """The edge list read back once: at most one row per pair of columns."""
    return edges.sparkSession.createDataFrame(edges.collect(), edges.schema)


def network_nodes(spark, columns: list[str], target: str, terms=None) -> DataFrame:
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return names.select(
        "feature", feature_category(F.col("feature"), target, terms).alias("category"),
        (F.col("feature") == target).alias("is_target"),
    )


def network_metrics(edges: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nodes, edges, density, edge weights, mean clustering coefficient."""
    n = len(columns)
    edges = _held(edges)
    summary = edges.agg(
        F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("mean_weight"),
        F.max("weight").alias("max_weight"),
    )
    clustering = node_metrics(edges, columns).agg(F.avg("clustering").alias("average_clustering"))
    density = (2.0 * F.col("n_edges")) / F.lit(float(max(1, n * (n - 1))))
    return join_groups(summary, clustering, []).select(
        F.lit(n).alias("n_nodes"), "n_edges", density.alias("density"),
        "mean_weight", "max_weight", "average_clustering",
    )


def node_metrics(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Degree, degree centrality and clustering coefficient; isolated nodes have 0."""
    spark = edges.sparkSession
    edges = _held(edges)
    pairs = edges.select(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"))
    links = pairs.union(pairs.select("b", "a"))
    degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    # Two neighbours u < v of a node that are linked themselves close a triangle.
    paths = links.alias("l").join(links.alias("m"), F.col("l.a") == F.col("m.a")).filter(
        F.col("l.b") < F.col("m.b")
    ).select(F.col("l.a").alias("node"), F.col("l.b").alias("u"), F.col("m.b").alias("v"))
    closed = paths.join(links.alias("c"), (F.col("u") == F.col("c.a")) & (F.col("v") == F.col("c.b")))
    triangles = closed.groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    nodes = spark.createDataFrame([(c,) for c in columns], "feature string")
    joined = nodes.join(degree, nodes.feature == degree.a, "left").join(
        triangles, nodes.feature == triangles.node, "left"
    )
    d = F.coalesce("degree", F.lit(0))
    possible = d * (d - 1) / 2
    return joined.select(
        "feature", d.alias("degree"),
        (d / F.lit(float(max(1, len(columns) - 1)))).alias("degree_centrality"),
        F.coalesce(F.try_divide(F.coalesce("triangles", F.lit(0)), possible), F.lit(0.0)).alias("clustering"),
    )
