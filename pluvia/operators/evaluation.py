"""Prediction metrics as aggregates, time-ordered splits and fold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import constants as C
from pluvia.functions.ordering import TASK_ROWS, Series, average_ranks, cumulative_sums, with_positions
from pluvia.functions.storage import materialise
from pluvia.operators.profile import join_groups


def regression_aggregates(y: Column, pred: Column) -> dict[str, Column]:
    """MAE, RMSE and R2 as aggregate columns; NULL without rows.

    A constant truth scores 1 when hit exactly and 0 otherwise."""
    ok = y.isNotNull() & pred.isNotNull()
    yy, miss = F.when(ok, y), F.when(ok, y - pred)
    ssr, sst = F.sum(miss * miss), F.var_pop(yy) * F.count(yy)
    r2 = F.when(sst > 0, 1 - ssr / F.when(sst > 0, sst)).when(ssr == 0, 1.0).when(F.count(yy) > 0, 0.0)
    return {"MAE": F.avg(F.abs(miss)), "RMSE": F.sqrt(F.avg(miss * miss)), "R2": r2}


def regression_metrics(df: DataFrame, y: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    made = regression_aggregates(F.col(y).cast("double"), F.col(pred).cast("double"))
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in made.items()])


def roc_auc(
    df: DataFrame, label: str, score: str, groups: Sequence[str] = (), rows_bound: int | None = None
) -> DataFrame:
    """(groups, ROC_AUC) from rank sums; NULL when only one class is present."""
    ranks = average_ranks(
        df.filter(F.col(label).isNotNull()), groups, score, {"pos": F.sum(F.col(label).cast("long"))}, rows_bound
    )
    sums = ranks.groupBy(*groups).agg(
        F.sum("pos").cast("double").alias("p"), F.sum(F.col("cnt") - F.col("pos")).cast("double").alias("n"),
        F.sum(F.col("pos") * F.col("rank")).alias("r"),
    )
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n"))
    return sums.select(*groups, auc.alias("ROC_AUC"))


def calculate_metrics(
    df: DataFrame, y: str, pred: str, task: str = "regression", groups: Sequence[str] = ()
) -> DataFrame:
    if task == "regression":
        return regression_metrics(df, y, pred, groups)
    if task == "classification":
        return roc_auc(df, y, pred, groups)
    raise ValueError("task must be 'classification' or 'regression'")


def combined_prediction(p_rain: Column, amount: Column, threshold: float = 0.5) -> Column:
    return F.when(p_rain >= threshold, amount).otherwise(0.0)


def evaluate_two_stage(
    df: DataFrame, y: str, p_rain: str, amount: str, rain_threshold: float = C.RAIN_THRESHOLD,
    groups: Sequence[str] = (), rows_bound: int | None = None,
) -> DataFrame:
    """One row per group: AUC on all days, amount metrics on rainy days,
    metrics of the combined prediction, and the counts."""
    truth, rain = F.col(y).cast("double"), (F.col(y) > rain_threshold).cast("int")
    wet_y = F.when(F.col("_rain") == 1, truth)
    combined = combined_prediction(F.col(p_rain), F.col(amount))
    rows = df.withColumn("_rain", rain)
    metrics = {f"rain_{n}": c for n, c in regression_aggregates(wet_y, F.col(amount)).items()}
    metrics.update({f"combined_{n}": c for n, c in regression_aggregates(truth, combined).items()})
    table = rows.groupBy(*groups).agg(
        *[c.alias(n) for n, c in metrics.items()],
        F.sum("_rain").alias("rain_days"), F.count(F.lit(1)).alias("total_rows"),
    )
    return join_groups(table, roc_auc(rows, "_rain", p_rain, groups, rows_bound), groups)


def evaluate_single_stage(df: DataFrame, y: str, pred: str, groups: Sequence[str] = ()) -> DataFrame:
    made = regression_aggregates(F.col(y).cast("double"), F.col(pred))
    return df.groupBy(*groups).agg(
        *[c.alias(n) for n, c in made.items()], F.count(F.lit(1)).alias("total_rows")
    )


# --- time-ordered splits ------------------------------------------------------

def numbered_rows(df: DataFrame, order: str, ties: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Adds ``_pos``, the 0-based place in time of every row of the whole table.

    Rows are counted by day (or whatever ``order`` holds), the counts are added up, and rows are numbered only inside their
    day, so no sort runs over the table.  Where a single day has more rows than a task should order, the table is numbered
    in pieces instead."""
    limit = block_rows or TASK_ROWS
    counts = materialise(df.groupBy(F.col(order).alias("_day")).agg(F.count(F.lit(1)).alias("cnt")))
    facts = counts.agg(F.max("cnt"), F.count(F.lit(1))).first()
    if (facts[0] or 0) > limit:
        return with_positions(df, Series((), order, tuple(ties), block_rows=limit))
    before = cumulative_sums(counts, [], "_day", ["cnt"], facts[1], limit).select("_day", "below_cnt")
    inside = Window.partitionBy(order).orderBy(*(ties or [F.lit(0)]))
    joined = df.withColumn("_inner", F.row_number().over(inside) - 1).join(before, F.col(order).eqNullSafe(F.col("_day")))
    return joined.withColumn("_pos", (F.col("below_cnt") + F.col("_inner")).cast("long")).drop("_inner", "_day", "below_cnt")


def prepare_data(
    df: DataFrame, target: str, features: list[str] | None = None, order: str = C.DATE_LABEL,
    ties: Sequence[str] = (), test_size: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows without a feature are dropped, the first share trains.

    Both sides keep ``_pos`` so that folds need no second numbering.  The
    prepared rows are written once, since every fit reads them again."""
    features = features or [c for c in df.columns if c not in (target, order, *ties)]
    complete = df.select(*dict.fromkeys([order, *ties, target, *features])).na.drop("any", subset=features)
    rows = materialise(numbered_rows(complete, order, ties))
    cut = int(rows.count() * (1 - test_size))
    return rows.filter(F.col("_pos") < cut), rows.filter(F.col("_pos") >= cut)


def fold_bounds(rows: int, n_splits: int = 5) -> list[tuple[int, int, int]]:
    """(fold, train_end, test_end) of an expanding window: equal test parts at the end."""
    size = rows // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{rows} rows are too few for {n_splits} folds")
    return [(i, rows - (n_splits - i) * size, rows - (n_splits - i - 1) * size) for i in range(n_splits)]


def fold_table(df: DataFrame, n_splits: int = 5) -> DataFrame:
    return df.sparkSession.createDataFrame(
        fold_bounds(df.count(), n_splits), "fold int, train_end long, test_end long"
    )


def assign_folds(numbered: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """One row per (row, fold it takes part in) with its role; the few bounds
    are constants of the plan, so no join is needed."""
    pos = F.col("_pos")
    roles = F.array_compact(F.array(*[
        F.when(pos < test_end, F.struct(
            F.lit(fold).alias("fold"), F.when(pos < train_end, "train").otherwise("test").alias("role")
        )) for fold, train_end, test_end in bounds
    ]))
    return numbered.withColumn("_f", F.explode(roles)).select("*", "_f.*").drop("_f")
