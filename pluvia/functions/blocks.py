"""Series as rows of consecutive values: the layout of filters that reach over many rows.

A row holds one block of a series: arrays of up to ``size`` values at positions ``_from`` to ``_to`` (excluded) of a series
of ``_n`` rows.  Before a filter runs, every block receives the stretches of its neighbours that the filter reaches into
(``with_reach``): one shuffle of arrays, with any length of series and any reach.  No task holds more than a block and
its two reaches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.ordering import Series, with_positions

BLOCK_VALUES = 1 << 18
PLACE = ["_n", "_block", "_from", "_to"]


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


def series_blocks(df: DataFrame, columns: Sequence[str], *, by: Series, size: int = BLOCK_VALUES) -> DataFrame:
    """(keys, _n, _block, _from, _to, arrays of the order, the ties and the columns)."""
    keys = list(by.keys)
    names = [by.order, *by.ties, *columns]
    placed = with_positions(df.select(*keys, *names), by)
    if keys and by.rows_bound is not None and by.rows_bound <= by.block_rows:
        placed = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        sizes = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        placed = placed.join(sizes, same).drop(*[f"_k{i}" for i in range(len(keys))])
    block = F.floor(F.col("_pos") / size)
    rows = F.array_sort(F.collect_list(F.struct("_pos", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)])))
    cut = placed.groupBy(*keys, "_n", block.alias("_block")).agg(rows.alias("_rows"))
    start = F.col("_block") * size
    return cut.select(
        *keys, "_n", "_block", start.alias("_from"), (start + F.size("_rows")).alias("_to"),
        *[_field("_rows", f"_v{i}").alias(c) for i, c in enumerate(names)])


def block_rows(blocks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each value again: (keys, columns)."""
    return blocks.select(*keys, F.inline(F.arrays_zip(*columns)))


def minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def with_reach(
    blocks: DataFrame, keys: Sequence[str], near: dict[str, Column], reach: int, size: int = BLOCK_VALUES,
    cover: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The blocks with, for each name of ``near``, its values from ``reach`` rows before the block to as many after it,
    as far as the series goes; ``_lo`` is the position of the first of them.

    ``cover``: the positions that the arrays of a block cover, where these are not its own (a filter's output may go on
    beyond the ends of the series).
    """
    begin, end = cover or (F.col("_from"), F.col("_to"))
    far = math.ceil(reach / size)
    state = [c for c in blocks.columns if c not in keys]
    last = F.floor((F.col("_n") - 1) / size)
    targets = F.sequence(F.greatest(F.col("_block") - far, F.lit(0).cast("long")), F.least(F.col("_block") + far, last))
    sent = blocks.withColumns({f"_near_{k}": v for k, v in near.items()} | {"_begin": begin, "_end": end})
    sent = sent.withColumn("_target", F.explode(targets))
    lo = F.greatest(F.col("_begin"), F.col("_target") * size - reach)
    hi = F.least(F.col("_end"), (F.col("_target") + 1) * size + reach)
    pieces = [F.slice(f"_near_{k}", (lo - F.col("_begin") + 1).cast("int"), (hi - lo).cast("int")).alias(k) for k in near]
    sent = sent.filter(hi > lo).select(
        *keys, "_target", F.when(F.col("_target") == F.col("_block"), F.struct(*state)).alias("_own"),
        F.struct(lo.alias("lo"), *pieces).alias("_piece"))
    met = sent.groupBy(*keys, "_target").agg(
        F.first("_own", ignorenulls=True).alias("_own"),
        F.array_sort(F.collect_list("_piece"), lambda a, b: (a["lo"] - b["lo"]).cast("int")).alias("_pieces"))
    joined = [F.flatten(_field("_pieces", k)).alias(f"_near_{k}") for k in near]
    return met.select(*keys, "_own.*", F.get("_pieces", 0)["lo"].alias("_lo"), *joined)
