"""Column choice, interactions and missing-value strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C
from pluvia.functions.ordering import Series, fits_one_task, series, with_positions


def select_features(
    df: DataFrame,
    features_to_keep: list[str],
    target_col: str = C.TARGET_LABEL,
    date_col: str = C.DATE_LABEL,
    keep_essential: bool = True,
) -> DataFrame:
    """Date, target, then the requested columns that exist, each once."""
    wanted = ([date_col, target_col] if keep_essential else []) + list(features_to_keep)
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def distribution_columns(df: DataFrame) -> list[str]:
    return numeric_columns(df, C.COORDINATE_LABELS)


def correlation_columns(df: DataFrame, date_col: str = C.DATE_LABEL) -> list[str]:
    return numeric_columns(df, [*C.COORDINATE_LABELS, date_col, C.GROUP_LABEL])


def predictor_columns(
    df: DataFrame, target_col: str = C.TARGET_LABEL, date_col: str = C.DATE_LABEL
) -> list[str]:
    return [c for c in correlation_columns(df, date_col) if c != target_col]


def to_long(
    df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value"
) -> DataFrame:
    """One row per (row, column); every value as double."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, columns, name, value)


# name -> (infix of the new column, expression).  The epsilon is a fixed value.
INTERACTIONS = {
    "multiply": ("x", lambda a, b: a * b),
    "divide": ("div", lambda a, b: F.try_divide(a, b + F.lit(1e-8))),
    "add": ("plus", lambda a, b: a + b),
    "subtract": ("minus", lambda a, b: a - b),
}


def create_interaction_features(
    df: DataFrame,
    feature_pairs: list[tuple[str, str]],
    operations: tuple[str, ...] | list[str] = tuple(INTERACTIONS),
) -> DataFrame:
    """Unknown pairs and operations are skipped."""
    made: dict[str, Column] = {}
    for a, b in feature_pairs:
        if a in df.columns and b in df.columns:
            for op in operations:
                if op in INTERACTIONS:
                    infix, combine = INTERACTIONS[op]
                    made[f"{a}_{infix}_{b}"] = combine(F.col(a), F.col(b))
    return df.withColumns(made)


def missing_counts(df: DataFrame) -> Column:
    """Array of NULL counts in column order (one aggregate pass)."""
    return F.array(*[F.count_if(F.col(c).isNull()) for c in df.columns])


def fill_forward(df: DataFrame, s: Series, columns: list[str] | None = None) -> DataFrame:
    """Last non-null value in series order.

    A fill has no frame length, so a split series cannot use a fixed halo:
    every block is filled on its own and then takes the last known value of
    the blocks before it.
    """
    columns = columns or [c for c in df.columns if c not in (*s.keys, s.order, *s.ties)]
    if fits_one_task(df, s):
        frame = s.window().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, True).over(frame) for c in columns})
    rows = with_positions(df, s).withColumn("_block", F.floor(F.col("_pos") / s.block_rows))
    inside = Window.partitionBy(*s.keys, "_block").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ends = rows.groupBy(*s.keys, "_block").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct("_pos", F.col(c).alias("v"))))
        .getField("v").alias(f"_e_{i}") for i, c in enumerate(columns)
    ])
    earlier = Window.partitionBy(*s.keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = ends.select(*s.keys, "_block", *[
        F.last(f"_e_{i}", True).over(earlier).alias(f"_c_{i}") for i in range(len(columns))
    ])
    filled = rows.withColumns({c: F.last(c, True).over(inside) for c in columns})
    right = carried.select(
        F.col("_block").alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(s.keys)],
        *[f"_c_{i}" for i in range(len(columns))],
    )
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(s.keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return filled.join(right, on, "left").select(*[
        F.coalesce(F.col(c), F.col(f"_c_{columns.index(c)}")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def fill_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric NULLs become the mean of the whole column (one row of means is read back)."""
    columns = columns or numeric_columns(df)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(means[i])) for i, c in enumerate(columns)
    })


def drop_sparse_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Keeps columns whose share of non-null values reaches the threshold."""
    row = df.agg(F.count(F.lit(1)).alias("n"), missing_counts(df).alias("m")).first()
    if not row["n"]:
        return df
    return df.select(*[
        c for c, m in zip(df.columns, row["m"]) if (row["n"] - m) / row["n"] >= threshold
    ])


def handle_missing_values(
    df: DataFrame,
    strategy: str = "drop",
    threshold: float = 0.8,
    date_col: str = C.DATE_LABEL,
    keys: tuple[str, ...] | list[str] = (),
    rows_bound: int | None = None,
    ties: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """drop | fill_forward | fill_mean | drop_columns; anything else changes nothing."""
    if strategy == "drop":
        return df.na.drop("any")
    if strategy == "fill_forward":
        return fill_forward(df, series(keys, date_col, ties=ties, rows_bound=rows_bound))
    if strategy == "fill_mean":
        return fill_mean(df)
    if strategy == "drop_columns":
        return drop_sparse_columns(df, threshold)
    return df


def missing_summary(before: DataFrame, after: DataFrame, date_col: str) -> DataFrame:
    """Rows and missing cells before and after a strategy, and the date range kept."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing"),
            F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"),
        ).withColumn("at", F.lit(tag))

    both = facts(before, "before").unionByName(facts(after, "after"))

    def pick(at: str, c: str) -> Column:
        return F.max(F.when(F.col("at") == at, F.col(c)))

    return both.agg(
        pick("before", "rows").alias("rows_before"),
        pick("after", "rows").alias("rows_after"),
        (pick("before", "rows") - pick("after", "rows")).alias("rows_removed"),
        pick("before", "missing").alias("missing_before"),
        pick("after", "missing").alias("missing_after"),
        pick("after", "first_day").alias("first_day"),
        pick("after", "last_day").alias("last_day"),
    )
