"""Ordered feature recipes: a list of named steps folded over one DataFrame.

Every step only extends the logical plan; lag and rolling steps of the same
series share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pluvia.functions.ordering import Series
from pluvia.operators import clean, features


def _mstl(df: DataFrame, **params) -> DataFrame:
    from pluvia.operators.decomposition import create_mstl_features

    return create_mstl_features(df, **params)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "select_features": clean.select_features,
    "create_temporal_features": features.create_temporal_features,
    "create_lag_features": features.create_lag_features,
    "create_rolling_features": features.create_rolling_features,
    "create_interaction_features": clean.create_interaction_features,
    "handle_missing_values": clean.handle_missing_values,
    "create_mstl_features": _mstl,
}
NEED_SERIES = {"create_lag_features", "create_rolling_features", "create_mstl_features"}


def apply_steps(df: DataFrame, steps: list[dict], *, by: Series) -> DataFrame:
    """Applies {"function", "params"} steps in order; unknown names are skipped.

    ``by`` says how rows form series; steps that need no order ignore it.
    """
    for step in steps:
        name, params = step["function"], dict(step.get("params", {}))
        if name not in STEPS:
            continue
        if name in NEED_SERIES:
            params.setdefault("by", by)
        if name == "handle_missing_values" and params.get("strategy") == "fill_forward":
            params.setdefault("keys", list(by.keys))
            params.setdefault("date_col", by.order)
            params.setdefault("rows_bound", by.rows_bound)
        df = STEPS[name](df, **params)
    return df
