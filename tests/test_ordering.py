"""The split routes give what one sorted task would give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.functions import ordering as od
from pluvia.operators import clean, features as fx

SMALL = od.series("site", "day", block_rows=16)
PLAIN = od.series("site", "day", rows_bound=1000)


def table(df, order):
    return df.toPandas().sort_values(order).reset_index(drop=True)


def test_blocked_frames_equal_plain_frames(panel_rows):
    def make(by):
        out = fx.create_lag_features(panel_rows, ["x", "y"], [1, 3, -2], by=by)
        out = fx.create_rolling_features(out, "y", [4, 9], ["mean", "std", "max"], by=by)
        return table(out, ["site", "day"])

    pd.testing.assert_frame_equal(make(PLAIN), make(SMALL)[make(PLAIN).columns])


def test_rolling_matches_pandas(panel_rows):
    got = table(fx.create_rolling_features(panel_rows, "x", [5], ["mean", "std", "sum", "min"], by=SMALL), ["site", "day"])
    src = table(panel_rows, ["site", "day"])
    for stat in ("mean", "std", "sum", "min"):
        want = src.groupby("site")["x"].transform(lambda s: getattr(s.rolling(5), stat)())
        np.testing.assert_allclose(got[f"x_{stat}_5d"], want, atol=1e-9)


def test_centred_detrend_matches_pandas(panel_rows):
    src = table(panel_rows, ["site", "day"])
    want = src["y"] - src.groupby("site")["y"].transform(lambda s: s.rolling(6, center=True).mean())
    for by in (PLAIN, SMALL):
        got = table(fx.detrend_centred(panel_rows, "y", 6, by=by), ["site", "day"])
        np.testing.assert_allclose(got["detrended"], want.dropna(), atol=1e-9)


def test_forward_fill_crosses_blocks(panel_rows):
    want = table(panel_rows, ["site", "day"]).groupby("site")["x"].ffill()
    for by in (PLAIN, SMALL, od.series("site", "day", block_rows=2)):
        got = table(clean.fill_forward(panel_rows, by, ["x"]), ["site", "day"])
        np.testing.assert_allclose(got["x"], want)


def test_positions_and_running_total(panel_rows):
    src = table(panel_rows, ["site", "day"])
    for by in (PLAIN, SMALL):
        got = table(od.running_total(panel_rows, by, "y", "total"), ["site", "day"])
        np.testing.assert_array_equal(got["_pos"], src.groupby("site").cumcount())
        np.testing.assert_allclose(got["total"], src.groupby("site")["y"].cumsum(), atol=1e-9)


def test_positions_of_whole_table(panel_rows):
    rows = od.with_positions(panel_rows, od.Series((), "day", ("site",), block_rows=10))
    got = table(rows, ["day", "site"])
    np.testing.assert_array_equal(got["_pos"], np.arange(len(got)))


def test_average_ranks_split_and_plain(panel_rows):
    src = table(panel_rows, ["site", "day"])
    want = src.groupby("site")["x"].rank().groupby([src["site"], src["x"]]).first()
    for options in ({"rows_bound": 1000}, {"per_piece": 10}):
        got = od.average_ranks(panel_rows, ["site"], "x", **options).toPandas().set_index(["site", "x"])["rank"]
        np.testing.assert_allclose(got.sort_index(), want.sort_index())
    flat = od.average_ranks(panel_rows, [], "x", per_piece=10).toPandas().set_index("x")["rank"].sort_index()
    np.testing.assert_allclose(flat, src["x"].rank().groupby(src["x"]).first().sort_index())


def test_split_percentiles_of_groups(panel_rows):
    q = od.exact_percentiles(panel_rows, ["site"], "x", {"m": 0.5}, per_piece=5).toPandas().set_index("site")["m"]
    np.testing.assert_allclose(q.sort_index(), panel_rows.toPandas().groupby("site")["x"].median())


@pytest.mark.parametrize("kind", ["ties", "nan", "null", "equal"])
def test_split_routes_with_ties_nan_and_null(spark, kind):
    """The split routes give the plain routes' rows, and no piece grows beyond twice its size, whatever the values."""
    rng = np.random.default_rng(3)
    values = [0.0 if rng.random() < 0.9 else float(rng.integers(1, 50)) for _ in range(4000)]
    if kind == "equal":
        values = [7.0] * 4000
    if kind in ("nan", "null"):
        values = [(float("nan") if kind == "nan" else None) if i % 3 == 0 else v for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(4)
    split = od.with_positions(df, od.Series((), "v", ("id",), block_rows=200))
    plain = od.with_positions(df, od.Series((), "v", ("id",), block_rows=10_000))
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    loose = od.with_positions(df, od.Series((), "v", block_rows=200))
    assert sorted(r._pos for r in loose.collect()) == list(range(4000))
    pieces = od.in_ordered_pieces(df, ["v"], 4000, 200).groupBy("_piece").count().collect()
    assert max(r["count"] for r in pieces) <= 400
    a = od.average_ranks(df, [], "v", per_piece=5).collect()
    b = od.average_ranks(df, [], "v", rows_bound=10_000, per_piece=10_000).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_bracket_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(20000), rng.gamma(2, 3, 30000), [5.0] * 7000])
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(values), "v": values}))
    probs = {"q0": 0.0, "q05": 0.05, "q25": 0.25, "q5": 0.5, "q95": 0.95, "q999": 0.999, "q1": 1.0}
    want = np.quantile(values, list(probs.values()))
    for groups in (["g"], []):
        got = od.exact_percentiles(df, groups, "v", probs, per_piece=100).first()
        np.testing.assert_allclose([got[n] for n in probs], want, rtol=1e-12)


def test_percentile_without_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert od.exact_percentiles(empty, ["g"], "v", {"m": 0.5}, per_piece=-1).count() == 0


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (1.0,), (3.0,)], "v double")
    assert od.most_frequent(od.value_counts(df, [], "v"), [], "v").first()["mode"] == 1.0


def test_series_facts_in_plain_plan_use_one_exchange(spark):
    from pluvia.sources.panel import panel, site_series

    rows = panel(spark, "/root/testdata/sf0.001")
    by = site_series()
    out = fx.create_rolling_features(fx.create_lag_features(rows, "rain", [1, 7], by=by), "rain", [7, 30], by=by)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(site") == 2  # the daily roll-up and one for all windows
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recent_rows_break_ties_from_the_end(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("a", 2, 3), ("b", 5, 9)]
    df = spark.createDataFrame(rows, "k string, t int, tie int")
    for options in ({"rows_bound": 10}, {"block_rows": 2}, {}):
        by = od.series("k", "t", ties="tie", **options)
        for n in (1, 2, 3):
            got = {tuple(r) for r in fx.recent_rows(df, n, by=by).select("k", "t", "tie").collect()}
            assert got == set(sorted(rows[:4])[-n:]) | {rows[4]}
    whole = od.Series((), "t", ("tie",), block_rows=2)
    assert {tuple(r) for r in fx.recent_rows(df, 2, by=whole).select("k", "t", "tie").collect()} == {("a", 2, 3), ("b", 5, 9)}


def test_seeded_sample_equals_one_sort(spark):
    from pyspark.sql import Window

    from pluvia.operators.stat_tests import seeded_sample

    long = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("Feature"), F.rand(1).alias("v"))
    got = {r["id"] for r in seeded_sample(long, 50, "id").collect()}
    w = Window.partitionBy("Feature").orderBy(F.xxhash64("id", F.lit(42)), "id")
    want = {r["id"] for r in long.withColumn("n", F.row_number().over(w)).filter("n <= 50").collect()}
    assert got == want


def test_rows_of_few_groups_stay_in_their_tasks(spark):
    """Facts of a few groups come to the rows: a shuffle by them would send a group's rows to one task."""
    from pluvia.operators.profile import with_group_facts
    from pluvia.operators.stat_tests import seeded_sample

    long = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("Feature"), F.rand(1).alias("v"))
    long = spark.createDataFrame(long.collect(), long.schema)
    for df in (seeded_sample(long, 50, "id"), with_group_facts(long, ["Feature"], {"hi": F.max("v")})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    found = with_group_facts(long, ["Feature"], {"hi": F.max("v")}).select("Feature", "hi").distinct().collect()
    assert {(r.Feature, r.hi) for r in found} == {(r[0], r[1]) for r in long.groupBy("Feature").agg(F.max("v")).collect()}


def test_event_features_in_forced_blocks(spark):
    """Lags, rolling frames and fills of few large keys: blocks of 500 rows against one window for each key."""
    from pluvia.functions.ordering import series
    from pluvia.sources.panel import table

    rows = table(spark, "/root/testdata/sf0.001", "events").select("event_type", "ts", "event_id", "value")
    gaps = rows.withColumn("value", F.when(F.col("value") >= 20, F.col("value")))
    split = series("event_type", "ts", ties="event_id", block_rows=50)
    whole = series("event_type", "ts", ties="event_id")

    def same(make):
        a, b = (make(by).collect() for by in (split, whole))
        columns = [c for c in make(whole).columns if c.startswith("value")]
        made = [{r.event_id: [None if r[c] is None else round(r[c], 9) for c in columns] for r in x} for x in (a, b)]
        assert made[0] == made[1] and len(made[0]) == len(a) == len(b)

    same(lambda by: fx.create_lag_features(rows, "value", [1, 3], by=by))
    same(lambda by: fx.create_rolling_features(rows, "value", [20], ["mean", "max"], by=by))
    same(lambda by: clean.fill_forward(gaps, by, ["value"]))
