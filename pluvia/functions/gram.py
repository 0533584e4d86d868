"""Cross-product matrices per key, combined before they are shuffled.

Regressions over lag columns need only X'X.  Every task adds up the matrices
of the keys it meets (numpy on Arrow batches) and sends one small matrix per
key; the solver then sees k x k numbers per key, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_KEYS = 256  # matrices a task keeps before it hands them on


def gram_by_key(
    df: DataFrame, keys: Sequence[str], vector: str, head: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """(keys, carry, at, n, gram): partial sums of outer products.

    Several rows per key are possible.  Where the ``head`` column is not NULL
    the row is handed on as it is (``at`` = head, n = 0, gram = its vector);
    sums have ``at`` = -1.  ``carry`` columns are constant within a key.
    """
    ids = [*keys, *carry]
    rest = [head] if head else []
    schema = T.StructType(
        [df.schema[k] for k in ids]
        + [T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
           T.StructField("gram", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches):
        held: dict[tuple, list] = {}

        def flush():
            rows = [(*k, -1, n, g.ravel().tolist()) for k, (n, g) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=schema.names)

        for pdf in batches:
            if head:
                early = pdf[pdf[head].notna()]
                if len(early):
                    yield early.assign(at=early[head].astype("int64"), n=0, gram=early[vector])[schema.names]
                pdf = pdf[pdf[head].isna()]
            parts = pdf.groupby(ids, sort=False, dropna=False) if ids else [((), pdf)]
            for k, part in parts:
                if not len(part):
                    continue
                k = k if isinstance(k, tuple) else (k,)
                x = np.vstack(part[vector].to_numpy())
                n, g = held.get(k, (0, 0.0))
                held[k] = (n + len(x), g + x.T @ x)
                if len(held) >= OPEN_KEYS:
                    yield flush()
        if held:
            yield flush()

    return df.select(*ids, *rest, vector).mapInPandas(partial, schema)


def solve_by_key(
    grams: DataFrame, keys: Sequence[str], solve: Callable, fields: list[T.StructField],
) -> DataFrame:
    """Adds a key's partial matrices and applies ``solve(matrix, n) -> list of row tuples``."""
    keys = list(keys)
    schema = T.StructType([grams.schema[k] for k in keys] + fields)
    names = schema.names

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack(pdf["gram"].to_numpy()).sum(axis=0)
        size = int(round(len(stacked) ** 0.5))
        rows = solve(stacked.reshape(size, size), int(pdf["n"].sum()))
        return pd.DataFrame([(*key, *r) for r in rows], columns=names)

    if not keys:
        def combine_all(pdf: pd.DataFrame) -> pd.DataFrame:
            return combine((), pdf)

        return grams.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(combine_all, schema)
    return grams.groupBy(*keys).applyInPandas(combine, schema)
