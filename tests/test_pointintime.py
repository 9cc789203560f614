from datetime import timedelta

import pytest
from helpers import at, count, plan, rows, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import hindsight as hs

SPINE = "obs long, acc string, ts timestamp"
FEATURE = "acc string, ts timestamp, x double, y string"
PLAIN = None
HOT = hs.SkewPolicy(hot_rows=1)
WARM = hs.SkewPolicy(hot_rows=4, max_groups=3)
ROUTES = [PLAIN, hs.SkewPolicy(), HOT]


def view(spark, data, **options):
    return hs.FeatureView(table(spark, FEATURE, data), ["acc"], "ts", ["x", "y"], **options)


def join(spark, spine, data, policy=PLAIN, shift=True, **options):
    df = hs.point_in_time(table(spark, SPINE, spine), "ts", [view(spark, data, **options)], policy, shift)
    return {r[0]: r[3:] for r in rows(df)}


@pytest.mark.parametrize("policy", ROUTES)
def test_exact_match_and_later_rows(spark, policy):
    data = [("a", at(), 1.0, "now"), ("a", at(microseconds=1), 2.0, "later"), ("a", at(days=-1), 3.0, "old")]
    assert join(spark, [(1, "a", at()), (2, "a", at(days=-2))], data, policy) == {1: (1.0, "now"), 2: (None, None)}


@pytest.mark.parametrize("policy", ROUTES)
def test_delay(spark, policy):
    spine = [(1, "a", at()), (2, "b", at())]
    data = [("a", at(minutes=-19, seconds=-59), 1.0, "x"), ("b", at(minutes=-20), 2.0, "y")]
    assert join(spark, spine, data, policy, delay=timedelta(minutes=20)) == {1: (None, None), 2: (2.0, "y")}
    assert join(spark, spine, data, policy, False, delay=timedelta(minutes=20)) == {1: (1.0, "x"), 2: (2.0, "y")}


@pytest.mark.parametrize("policy", ROUTES)
def test_lookback_edge(spark, policy):
    spine = [(1, "a", at()), (2, "b", at())]
    data = [("a", at(days=-2), 1.0, "x"), ("b", at(days=-2, microseconds=-1), 2.0, "y")]
    assert join(spark, spine, data, policy, lookback=timedelta(days=2)) == {1: (1.0, "x"), 2: (None, None)}


@pytest.mark.parametrize("policy", ROUTES)
def test_age_counts_from_the_time_of_visibility(spark, policy):
    data = [("a", at(days=-2, minutes=-20), 1.0, "x")]
    options = dict(delay=timedelta(minutes=20), lookback=timedelta(days=2))
    assert join(spark, [(1, "a", at())], data, policy, **options) == {1: (1.0, "x")}


@pytest.mark.parametrize("policy", ROUTES)
def test_unmatched_and_null_rows_are_kept(spark, policy):
    spine = [(1, "a", at()), (2, None, at()), (3, "b", None), (4, "none", at()), (5, None, None)]
    data = [("a", None, 1.0, "x"), (None, at(days=-1), 2.0, "y"), ("b", at(days=-1), 3.0, "z")]
    assert join(spark, spine, data, policy) == {i: (None, None) for i in range(1, 6)}


@pytest.mark.parametrize("policy", ROUTES)
def test_missing_value_in_the_latest_row_stays_missing(spark, policy):
    data = [("a", at(days=-2), 1.0, "x"), ("a", at(days=-1), None, "y")]
    assert join(spark, [(1, "a", at())], data, policy) == {1: (None, "y")}


@pytest.mark.parametrize("policy", ROUTES)
def test_equal_observations_are_all_kept(spark, policy):
    spine = table(spark, SPINE, [(1, "a", at())] * 5)
    result = hs.point_in_time(spine, "ts", [view(spark, [("a", at(), 1.0, "x")])], policy)
    assert rows(result) == [(1, "a", at(), 1.0, "x")] * 5


@pytest.mark.parametrize("policy", ROUTES)
def test_tie_goes_to_one_whole_row(spark, policy):
    data = [("a", at(), 1.0, "z"), ("a", at(), 2.0, "a"), ("a", at(), 2.0, "b"), ("a", at(), None, "zz")]
    assert join(spark, [(1, "a", at(days=1))], data, policy) == {1: (2.0, "b")}


@pytest.mark.parametrize("policy", ROUTES)
def test_composite_key(spark, policy):
    spine = table(spark, "obs long, a string, b long, ts timestamp", [(1, "x", 1, at()), (2, "x", 2, at()), (3, "x", None, at())])
    features = table(spark, "a string, b long, ts timestamp, v double", [("x", 1, at(), 1.0), ("y", 2, at(), 2.0)])
    result = hs.point_in_time(spine, "ts", [hs.FeatureView(features, ["a", "b"], "ts", ["v"])], policy)
    assert {r[0]: r[4] for r in rows(result)} == {1: 1.0, 2: None, 3: None}


def test_name_clash_needs_a_prefix(spark):
    first, second = view(spark, [("a", at(), 1.0, "x")]), view(spark, [("a", at(), 2.0, "y")])
    spine = table(spark, SPINE, [(1, "a", at())])
    with pytest.raises(ValueError, match="prefix"):
        hs.point_in_time(spine, "ts", [first, second])
    prefixed = view(spark, [("a", at(), 2.0, "y")], prefix="second_")
    assert rows(hs.point_in_time(spine, "ts", [first, prefixed])) == [(1, "a", at(), 1.0, "x", 2.0, "y")]


def test_bad_input_is_rejected_before_any_job(spark):
    spine = table(spark, SPINE, [(1, "a", at())])
    features = table(spark, "acc long, ts timestamp, x double", [(1, at(), 1.0)])
    with pytest.raises(ValueError, match="acc"):
        hs.point_in_time(spine, "ts", [hs.FeatureView(features, ["acc"], "ts", ["x"])])
    with pytest.raises(ValueError, match="unknown columns"):
        hs.point_in_time(spine, "ts", [hs.FeatureView(features, ["acc"], "ts", ["nope"])])


@pytest.mark.parametrize("policy", ROUTES)
def test_sets_with_different_keys_and_null_keys(spark, policy):
    spine = table(spark, "obs long, a string, b string, ts timestamp", [
        (1, "a", "b", at()), (2, None, "b", at()), (3, "a", None, at()), (4, None, None, None),
    ])
    by_a = hs.FeatureView(table(spark, "a string, ts timestamp, x double", [("a", at(), 1.0)]), ["a"], "ts", ["x"])
    by_b = hs.FeatureView(table(spark, "b string, ts timestamp, y double", [("b", at(), 2.0)]), ["b"], "ts", ["y"])
    got = {r[0]: r[4:] for r in rows(hs.point_in_time(spine, "ts", [by_a, by_b], policy))}
    assert got == {1: (1.0, 2.0), 2: (None, 2.0), 3: (1.0, None), 4: (None, None)}


moments = st.builds(
    lambda d, s: at(days=d, seconds=s), st.integers(-3, 3), st.sampled_from([0, 1, 59, 60, 61, 3600, 43_200])
)
maybe_moment = st.one_of(st.none(), moments, moments, moments)
account = st.sampled_from(["a", "a", "a", "b", None])
spines = st.lists(st.tuples(account, maybe_moment), min_size=1, max_size=40)
features = st.lists(
    st.tuples(account, maybe_moment, st.one_of(st.none(), st.integers(0, 3).map(float)), st.sampled_from(["p", "q"])),
    min_size=1, max_size=40,
)


def expected(spine, data, delay, lookback):
    """By definition: every feature row against every observation."""
    result = {}
    for i, acc, ts in spine:
        visible = [
            (f[1] + delay, f[2] is not None, f[2] or 0.0, f[3], f[2:4])
            for f in data
            if acc is not None and ts is not None and f[0] == acc and f[1] is not None and f[1] + delay <= ts
        ]
        best = max(visible, default=None)
        result[i] = best[-1] if best and best[0] >= ts - lookback else (None, None)
    return result


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(spines, features, st.sampled_from([timedelta(0), timedelta(minutes=1)]), st.sampled_from([timedelta(days=2), timedelta(hours=12)]))
def test_every_route_equals_the_definition(spark, observations, data, delay, lookback):
    spine = [(i, *o) for i, o in enumerate(observations)]
    wanted = expected(spine, data, delay, lookback)
    for policy in (PLAIN, HOT, WARM):
        assert join(spark, spine, data, policy, delay=delay, lookback=lookback) == wanted


def range_join(spine, features, delay, lookback):
    """A second implementation: equi-join with a range condition, latest match per row."""
    shown = features.withColumn("visible", F.col("ts") + F.lit(delay)).drop("ts").withColumnRenamed("acc", "k")
    condition = (
        (F.col("acc") == F.col("k")) & (F.col("visible") <= F.col("ts")) & (F.col("visible") >= F.col("ts") - F.lit(lookback))
    )
    return (
        spine.join(shown, condition, "left")
        .groupBy("obs", "acc", "ts")
        .agg(F.max(F.struct("visible", "x", "y")).alias("best"))
        .select("obs", "acc", "ts", "best.x", "best.y")
    )


@pytest.mark.parametrize("policy", [PLAIN, hs.SkewPolicy(hot_rows=60)])
def test_equals_a_range_join_and_shows_nothing_from_the_future(spark, policy):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    spine = events.where("event_type = 'purchase'").selectExpr("event_id AS obs", "user_id AS acc", "ts")
    data = events.where("event_type <> 'purchase'").selectExpr("user_id AS acc", "ts", "value AS x", "event_type AS y")
    delay, lookback = timedelta(minutes=20), timedelta(hours=30)
    joined = hs.point_in_time(
        spine, "ts", [hs.FeatureView(data, ["acc"], "ts", ["x", "y"], lookback, delay)], policy
    )
    assert rows(joined) == rows(range_join(spine, data, delay, lookback))
    assert rows(joined.select("obs", "acc", "ts")) == rows(spine)

    seen = hs.FeatureView(data.withColumn("at", F.col("ts")), ["acc"], "ts", ["at"], lookback, delay)
    leaks = hs.point_in_time(spine, "ts", [seen], policy).where(F.col("at") + F.lit(delay) > F.col("ts"))
    assert leaks.count() == 0


def test_two_sets_share_one_shuffle_and_one_window(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spine = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = [
        hs.FeatureView(
            events.where(f"event_type = '{kind}'").select("user_id", "ts", F.col("value").alias(kind)),
            ["user_id"], "ts", [kind], delay=timedelta(minutes=delay),
        )
        for kind, delay in (("click", 0), ("error", 20))
    ]
    result = hs.point_in_time(spine, "ts", views, PLAIN)
    assert (count(result, "Exchange"), count(result, "Sort"), count(result, "Window")) == (1, 1, 1)
    text = plan(result)
    assert "Join" not in text and "CartesianProduct" not in text
    assert "props" not in text


def test_hot_entities_are_cut_into_cells(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spine = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = hs.FeatureView(events.where("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", ["value"])
    result = hs.point_in_time(spine, "ts", [v], hs.SkewPolicy(hot_rows=20))
    text = plan(result)
    assert "_range" in text and "NestedLoop" not in text and "CartesianProduct" not in text
    assert rows(result) == rows(hs.point_in_time(spine, "ts", [v], PLAIN))


def test_an_instant_that_is_too_large_for_one_task(spark):
    """A third of all observations and of all feature rows lies on one key and instant."""
    spine = [(i, "hot", at()) for i in range(60)] + [(100 + i, f"c{i % 7}", at(hours=i)) for i in range(120)]
    data = [("hot", at(hours=-1), float(i % 5), "x") for i in range(60)]
    data += [(f"c{i % 7}", at(hours=i, minutes=-30), float(i), "y") for i in range(120)]
    policy = hs.SkewPolicy(hot_rows=25)
    assert join(spark, spine, data, policy) == join(spark, spine, data, PLAIN)
    assert join(spark, spine, data, policy)[7] == (4.0, "x")


def test_default_policy_deals_a_hot_entity_and_a_hot_instant_evenly(spark):
    """A third of all rows on one entity, a third on one of its instants: tasks get about the same."""
    n = 3000
    hot, instant = F.lit("hot"), F.lit(at()).cast("timestamp")
    spine = spark.range(n, numPartitions=4).select(
        F.col("id").alias("obs"),
        F.when(F.col("id") % 3 < 2, hot).otherwise(F.concat(F.lit("c"), (F.col("id") % 701).cast("string"))).alias("acc"),
        F.when(F.col("id") % 3 == 1, instant).otherwise(instant + F.make_dt_interval(mins=F.col("id").cast("int") - n // 2)).alias("ts"),
    )
    data = spine.select("acc", "ts", F.col("obs").cast("double").alias("x"), F.lit("y").alias("y"))
    view_ = hs.FeatureView(data, ["acc"], "ts", ["x", "y"], delay=timedelta(seconds=30))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = hs.point_in_time(spine, "ts", [view_])
        assert "_range" in plan(joined)
        per_task = [r["count"] for r in joined.where("NOT (acc = 'hot' AND obs % 3 = 1)").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(per_task) <= 2 * sorted(per_task)[len(per_task) // 2]
        assert rows(joined) == rows(hs.point_in_time(spine, "ts", [view_], PLAIN))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_count_up_to(spark):
    from hindsight.operators.pointintime import _count_up_to

    lists = [[], [5], [1, 3], [1, 3, 5, 7, 9], list(range(0, 200, 3)), None]
    df = spark.createDataFrame([(a, v) for a in lists for v in (-1, 0, 1, 4, 5, 9, 100, 500)], "a array<long>, v long")
    for r in df.withColumn("n", _count_up_to("a", F.col("v"))).collect():
        assert r.n == sum(x <= r.v for x in r.a or [])


def test_only_feature_rows_of_the_observed_entities_are_shuffled(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spine = events.where("event_type = 'purchase' AND user_id < 4").select("event_id", "user_id", "ts")
    rolled = hs.rolling(events, ["user_id"], "ts", [hs.Rolling("n", "count", "event_id", timedelta(days=3))])
    view = hs.FeatureView(rolled, ["user_id"], "ts", ["n"], delay=timedelta(minutes=1))
    few, many = hs.SkewPolicy(), hs.SkewPolicy(broadcast_bytes=50)
    filtered = hs.point_in_time(spine, "ts", [view], few)
    text = plan(filtered)
    assert "LeftSemi" in text[text.index("Union"):]
    unfiltered = hs.point_in_time(spine, "ts", [view], many)
    assert "LeftSemi" not in plan(unfiltered)
    assert rows(filtered) == rows(unfiltered) == rows(hs.point_in_time(spine, "ts", [view], PLAIN))


@pytest.mark.parametrize("policy", ROUTES)
def test_features_without_time(spark, policy):
    """Beside features with time; of several rows one wins as a whole; nothing multiplies observations."""
    spine = [(1, "a", at()), (2, "b", None), (3, None, at()), (4, "c", at()), (5, "a", at())]
    always = table(spark, "acc string, x double, y string", [
        ("a", 1.0, "z"), ("a", 2.0, "a"), ("a", 2.0, "b"), ("b", None, "y"), (None, 9.0, "n"),
    ])
    views = [hs.FeatureView(always, ["acc"], None, ["x", "y"], prefix="s_"), view(spark, [("a", at(days=-1), 5.0, "t")])]
    joined = hs.point_in_time(table(spark, SPINE, spine), "ts", views, policy)
    assert joined.columns == ["obs", "acc", "ts", "s_x", "s_y", "x", "y"]
    assert {r[0]: r[3:] for r in rows(joined)} == {
        1: (2.0, "b", 5.0, "t"), 2: (None, "y", None, None), 3: (None,) * 4, 4: (None,) * 4, 5: (2.0, "b", 5.0, "t"),
    }
    alone = hs.point_in_time(table(spark, SPINE, spine), "ts", views[:1], policy)
    assert {r[0]: r[3:] for r in rows(alone)}[1] == (2.0, "b")
