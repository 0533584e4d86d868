"""Ordered work that stays distributed when one key holds most of the rows.

Three building blocks:

* ``over_frames``     row-frame windows (lag, rolling, ...) per series.  A series
  with a proven small length is one window group; any other series is cut into
  blocks of consecutive positions and every block also receives the few rows
  its frames reach into (the halo), so no task ever holds a whole hot series.
* ``with_cumulative`` prefix sums over distinct ordered values: Spark's range
  partitioning cuts the ordered rows into pieces, each piece is summed on its
  own and shifted by the total of the pieces below it.
* ``exact_percentiles`` exact interpolated quantiles: a sketch brackets every
  requested rank, only the values inside the bracket are ordered, in pieces.

The number of pieces follows the number of rows; NULL comes first and NaN last
in every route.  Pieces are cut on the value, the tie breakers and a random
salt, so equal values never fill a piece of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from pluvia.functions.storage import materialise

TASK_ROWS = 1_000_000          # rows one task may order
SKETCH_ACCURACY = 10_000
BRACKET = 4.0 / SKETCH_ACCURACY


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns, order column, optional tie breakers.

    ``rows_bound`` is a proven maximum number of rows of one key (for a daily
    calendar: its number of days).  Without it the maximum is counted.
    """

    keys: tuple[str, ...]
    order: str
    ties: tuple[str, ...] = ()
    rows_bound: int | None = None
    block_rows: int = TASK_ROWS

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order, *self.ties)


def series(keys, order, **options) -> Series:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    ties = options.pop("ties", ())
    return Series(keys, order, (ties,) if isinstance(ties, str) else tuple(ties), **options)


def longest_series(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key; one number comes back."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def fits_one_task(df: DataFrame, s: Series) -> bool:
    bound = s.rows_bound if s.rows_bound is not None else longest_series(df, s.keys)
    return bool(s.keys) and bound <= s.block_rows


def as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        t = F.col(name)  # wall-clock seconds, whatever the session's time zone
        day = F.unix_date(t.cast("date")).cast("double")
        second = F.extract(F.lit("SECOND"), t).cast("double")
        return day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + second
    return F.col(name).cast("double")


def in_ordered_pieces(df: DataFrame, order: Sequence[str], rows: int, per_piece: int) -> DataFrame:
    """``df`` written in pieces of about ``per_piece`` rows that follow each other in order; adds ``_piece``.

    Written once, because the random salt that parts equal rows, and with it the cut, must not change between uses.
    """
    salted = df.withColumn("_salt", F.rand(7))
    ranged = salted.repartitionByRange(max(1, math.ceil(rows / per_piece)), *order, "_salt")
    return materialise(ranged.withColumn("_piece", F.spark_partition_id()))


def _on_keys(keys: Sequence[str], condition: Column) -> Column:
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return condition


def _totals_below(rows: DataFrame, keys: Sequence[str], weights: Sequence[Column]) -> DataFrame:
    """(_k0.., _p, _shift0.., _total0..): for each key and piece the weights of the key's earlier pieces, and of all."""
    sums = rows.groupBy(*keys, "_piece").agg(*[F.sum(w).alias(f"_w{i}") for i, w in enumerate(weights)])
    by = [F.col(k) for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"),
        *[F.coalesce(F.sum(f"_w{i}").over(before), F.lit(0)).alias(f"_shift{i}") for i in range(len(weights))],
        *[F.sum(f"_w{i}").over(Window.partitionBy(*by)).alias(f"_total{i}") for i in range(len(weights))],
    )


def with_positions(df: DataFrame, s: Series, name: str = "_pos") -> DataFrame:
    """Adds ``name`` (0-based row number inside the key) without a task per key
    (unless the keys are proven small enough for one).  Rows that the order and
    the ties leave equal are numbered in any order."""
    if s.keys and s.rows_bound is not None and s.rows_bound <= s.block_rows:
        return df.withColumn(name, F.row_number().over(s.window()).cast("long") - 1)
    n = df.count()
    if n <= s.block_rows:
        by = [F.col(k) for k in s.keys] or [F.lit(0)]
        order = Window.partitionBy(*by).orderBy(s.order, *s.ties)
        return df.withColumn(name, F.row_number().over(order).cast("long") - 1)
    rows = in_ordered_pieces(df, [s.order, *s.ties], n, s.block_rows)
    shift = _totals_below(rows, s.keys, [F.lit(1)])
    inside = Window.partitionBy(*s.keys, "_piece").orderBy(s.order, *s.ties, "_salt")
    return (
        rows.withColumn("_inner", F.row_number().over(inside) - 1)
        .join(shift, _on_keys(s.keys, F.col("_piece") == F.col("_p")), "inner")
        .withColumn(name, F.col("_inner") + F.col("_shift0"))
        .drop("_inner", "_shift0", "_total0", "_p", "_piece", "_salt", *[f"_k{i}" for i in range(len(s.keys))])
    )


def over_frames(
    df: DataFrame,
    s: Series,
    before: int,
    after: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """Adds the window columns of ``build``; frames reach at most ``before``
    rows back and ``after`` rows ahead of the current row."""
    if fits_one_task(df, s):
        return df.withColumns(dict(build(s.window())))
    size = max(s.block_rows, before + after + 1)
    rows = with_positions(df, s, "_place")
    home = F.floor(F.col("_place") / size)
    offset = F.col("_place") % size
    blocks = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when(offset < after, home - 1),
        )
    )
    spread = rows.withColumn("_block", F.explode(blocks))
    window = Window.partitionBy(*s.keys, "_block").orderBy("_place")
    return (
        spread.withColumns(dict(build(window)))
        .filter(F.col("_block") == home)
        .drop("_block", "_place")
    )


def value_counts(
    df: DataFrame, groups: Sequence[str], value: str, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct value; ties collapse before anything is ordered."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in (extra or {}).items()])
    )


def cumulative_sums(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weights: Sequence[str],
    rows_bound: int | None = None,
    per_piece: int = TASK_ROWS,
) -> DataFrame:
    """Adds ``below_w`` (weight of strictly smaller values) and ``total_w`` for each weight column w.

    ``df`` has one row per (groups, value)."""
    groups = list(groups)
    by = [F.col(g) for g in groups] or [F.lit(0)]
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if rows_bound is None:
        rows_bound = longest_series(df, groups)
    if rows_bound <= per_piece:
        return df.withColumns({
            **{f"below_{w}": F.coalesce(F.sum(w).over(below), F.lit(0)) for w in weights},
            **{f"total_{w}": F.sum(w).over(Window.partitionBy(*by)) for w in weights},
        })
    rows = in_ordered_pieces(df, [*groups, value], df.count(), per_piece)
    shift = _totals_below(rows, groups, [F.col(w) for w in weights])
    inside = Window.partitionBy(*groups, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    made = {f"_in{i}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for i, w in enumerate(weights)}
    extra = [f"{c}{i}" for i in range(len(weights)) for c in ("_in", "_shift", "_total")]
    return (
        rows.withColumns(made)
        .join(shift, _on_keys(groups, F.col("_piece") == F.col("_p")))
        .withColumns({
            **{f"below_{w}": F.col(f"_in{i}") + F.col(f"_shift{i}") for i, w in enumerate(weights)},
            **{f"total_{w}": F.col(f"_total{i}") for i, w in enumerate(weights)},
        })
        .drop(*extra, "_p", "_piece", "_salt", *[f"_k{i}" for i in range(len(groups))])
    )


def with_cumulative(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weight: str,
    rows_bound: int | None = None,
    per_piece: int = TASK_ROWS,
) -> DataFrame:
    """``cumulative_sums`` of one weight, as ``below`` and ``total``."""
    sums = cumulative_sums(df, groups, value, [weight], rows_bound, per_piece)
    return sums.withColumnsRenamed({f"below_{weight}": "below", f"total_{weight}": "total"})


def average_ranks(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    extra: Mapping[str, Column] | None = None,
    rows_bound: int | None = None,
    per_piece: int = TASK_ROWS,
) -> DataFrame:
    """(groups, value, cnt, extra..., below, total, rank): ties share their mean rank."""
    return ranks_from_counts(value_counts(df, groups, value, extra), groups, value, rows_bound, per_piece)


def ranks_from_counts(
    counts: DataFrame, groups: Sequence[str], value: str, rows_bound: int | None = None,
    per_piece: int = TASK_ROWS,
) -> DataFrame:
    """Mean ranks of distinct values that stand for ``cnt`` rows each."""
    return with_cumulative(counts, groups, value, "cnt", rows_bound, per_piece).withColumn(
        "rank", F.col("below") + (F.col("cnt") + 1) / F.lit(2.0)
    )


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows_bound: int | None = None,
    per_piece: int = TASK_ROWS,
) -> DataFrame:
    """(groups, one column per name in ``probs``), exact linear interpolation.

    Groups whose rows are proven or counted to fit one task are aggregated
    directly; larger ones take the bracket route."""
    groups = list(groups)
    names, ps = list(probs), list(probs.values())
    v = F.col(value).cast("double")
    if rows_bound is None:
        rows_bound = longest_series(df, groups)
    if rows_bound <= per_piece:
        q = F.percentile(v, F.array(*[F.lit(float(p)) for p in ps])).alias("_q")
        return df.groupBy(*groups).agg(q).select(
            *groups, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
        )
    probes = []
    for p in ps:
        probes += [max(0.0, p - BRACKET), min(1.0, p + BRACKET)]
    sketch = (
        df.select(*groups, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*groups)
        .agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.percentile_approx(
                "_v", F.array(*[F.lit(x) for x in probes]), SKETCH_ACCURACY
            ).alias("_q"),
        )
    )
    sketch = materialise(sketch)
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (F.lit(p) * (F.col("_n") - 1)).alias("at"),
            (F.col("_lo") if p - BRACKET <= 0 else F.col("_q")[2 * i]).alias("lo"),
            (F.col("_hi") if p + BRACKET >= 1 else F.col("_q")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(ps)
    ])
    targets = sketch.select(*groups, brackets.alias("_b"))
    rows = df.select(*groups, v.alias("_v")).filter(F.col("_v").isNotNull())
    if groups:
        rows = rows.join(targets, groups)
    else:
        only = targets.first()
        if only is None:
            return sketch.select(*[F.lit(None).cast("double").alias(n) for n in names])
        rows = rows.withColumn("_b", F.array(*[
            F.struct(
                F.lit(b["i"]).alias("i"), F.lit(b["at"]).alias("at"),
                F.lit(b["lo"]).alias("lo"), F.lit(b["hi"]).alias("hi"),
            ) for b in only["_b"]
        ]))
    hits = (
        rows.withColumn("_t", F.explode(F.filter("_b", lambda b: b["hi"] >= F.col("_v"))))
        .select(
            *groups, F.col("_t.i").alias("i"), F.col("_t.at").alias("at"),
            F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")).alias("x"),
        )
        .groupBy(*groups, "i", "at", "x").agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = with_cumulative(materialise(hits), [*groups, "i"], "x", "c", per_piece=per_piece)
    ranked = ranked.withColumns({"from": F.col("below"), "upto": F.col("below") + F.col("c")})

    def value_at(rank: Column) -> Column:
        hit = (F.col("from") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(hit, F.col("x")))

    low = F.floor(F.col("at"))
    high = F.ceil(F.col("at"))
    per_prob = ranked.groupBy(*groups, "i", "at").agg(
        value_at(low).alias("a"), value_at(high).alias("b")
    )
    interpolated = F.when(
        F.col("a").isNull() | F.col("b").isNull(),
        F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    values = per_prob.select(*groups, "i", interpolated.alias("q"))
    return values.groupBy(*groups).agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    )


def most_frequent(counts: DataFrame, groups: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Mode from ``value_counts`` output; the smallest value wins a tie."""
    best = F.max(F.struct(F.col("cnt"), (-F.col(value)).alias("neg")))
    return counts.groupBy(*groups).agg(best.alias("_m")).select(
        *groups, (-F.col("_m.neg")).alias(name)
    )


def running_total(df: DataFrame, s: Series, column: str, name: str) -> DataFrame:
    """Adds the running sum of ``column`` in series order and ``_pos``.

    A split series sums inside blocks and adds the totals of earlier blocks."""
    if fits_one_task(df, s):
        w = s.window()
        return df.withColumns({
            "_pos": F.row_number().over(w).cast("long") - 1,
            name: F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        })
    rows = with_positions(df, s).withColumn("_block", F.floor(F.col("_pos") / s.block_rows))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(s.keys)]
    sums = rows.groupBy(*s.keys, "_block").agg(F.sum(column).alias("_w"))
    earlier = Window.partitionBy(*s.keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = sums.select(
        *named, F.col("_block").alias("_b"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)).alias("_shift"),
    )
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(s.keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*s.keys, "_block").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        rows.withColumn(name, F.sum(column).over(inside)).join(shift, on)
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_shift", "_b", "_block", *[f"_k{i}" for i in range(len(s.keys))])
    )
