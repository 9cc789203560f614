from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from helpers import at, plan, rows, table
from pyspark.sql import functions as F

import hindsight as hs
from hindsight.plans.materialize import compute_features, gaps
from hindsight.spec.model import Column

EVENTS = "/root/testdata/sf0.001/events.parquet"
NAMES = {"user_id": "acc", "ts": "at", "value": "amount", "event_id": "id"}
AGGS = [
    hs.Rolling("n3", "count", "id", timedelta(days=3)),
    hs.Rolling("n7", "count", "id", timedelta(days=7)),
    hs.Rolling("last", "sum", "id", timedelta(seconds=1)),
]


def feature_set(path=EVENTS, **options):
    return hs.FeatureSet(
        "tx", "1", hs.Source(path, "ts", timedelta(minutes=20), NAMES), (Column("acc", "long"),),
        options.pop("transformer", hs.RollingTransformer(["acc"], "at", AGGS)), **options,
    )


@pytest.fixture
def store(spark, tmp_path):
    return hs.OfflineStore(spark, str(tmp_path / "store"))


def full(spark, start=None, end=None):
    everything = compute_features(spark, feature_set())
    if start is not None:
        everything = everything.where((F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end)))
    return rows(everything)


def test_backfill_equals_the_full_computation_cut_to_the_window(spark, store):
    fs = feature_set()
    hs.backfill(fs, "2024-01-10T06:00:00", "2024-01-20 23:59:00", store)
    wanted = full(spark, "2024-01-10 06:00:00", "2024-01-20 23:59:00")
    assert rows(store.read(fs)) == wanted and len(wanted) > 100


def test_a_source_lookback_that_is_too_short_is_rejected():
    with pytest.raises(ValueError, match="shorter than the frame"):
        feature_set(source_lookback=timedelta(days=6))


def test_running_twice_changes_nothing(spark, store):
    fs = feature_set()
    for _ in range(2):
        hs.backfill(fs, "2024-01-05", "2024-01-06", store)
    assert rows(store.read(fs)) == full(spark, "2024-01-05", "2024-01-06")
    assert store.covered(fs) == [(datetime(2024, 1, 5), datetime(2024, 1, 6))]


def test_two_windows_equal_one(spark, store, tmp_path):
    fs, other = feature_set(), hs.OfflineStore(spark, str(tmp_path / "other"))
    hs.backfill(fs, "2024-01-05 07:30:00", "2024-01-09 11:00:01", store)
    hs.backfill(fs, "2024-01-09 11:00:01", "2024-01-12", store)
    hs.backfill(fs, "2024-01-05 07:30:00", "2024-01-12", other)
    assert rows(store.read(fs)) == rows(other.read(fs)) != []
    assert store.covered(fs) == other.covered(fs)


def test_a_later_run_replaces_only_its_window(spark, store, tmp_path):
    fs = feature_set()
    hs.backfill(fs, "2024-01-05", "2024-01-08", store)
    # The source changes: from now on every amount of a transaction is missing its id.
    changed = str(tmp_path / "changed")
    spark.read.parquet(EVENTS).withColumn("event_id", F.lit(None).cast("long")).write.parquet(changed)
    hs.backfill(feature_set(changed), "2024-01-06 06:00:00", "2024-01-06 18:00:00", store)
    window = (F.col("at") >= "2024-01-06 06:00:00") & (F.col("at") < "2024-01-06 18:00:00")
    stored = store.read(fs)
    assert stored.where(window).agg(F.sum("n7")).first()[0] == 0
    assert rows(stored.where(~window)) == sorted(
        full(spark, "2024-01-05", "2024-01-06 06:00:00") + full(spark, "2024-01-06 18:00:00", "2024-01-08"), key=repr
    )


def test_a_run_that_was_not_committed_is_invisible(spark, store, monkeypatch):
    fs = feature_set()
    hs.backfill(fs, "2024-01-05", "2024-01-06", store)
    before = rows(store.read(fs))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", fail)
        with pytest.raises(RuntimeError):
            hs.backfill(fs, "2024-01-05", "2024-01-07", store)
    assert rows(store.read(fs)) == before
    hs.backfill(fs, "2024-01-05", "2024-01-07", store)
    assert rows(store.read(fs)) == full(spark, "2024-01-05", "2024-01-07")


def test_versions_do_not_mix(spark, store):
    fs = feature_set()
    hs.backfill(fs, "2024-01-05", "2024-01-06", store)
    assert store.read(replace(fs, version="2")) is None


@pytest.mark.parametrize("start, end", [("2024-01-05 00:00:00.5", "2024-01-06"), ("2024-01-06", "2024-01-06")])
def test_bad_windows(store, start, end):
    with pytest.raises(ValueError):
        hs.backfill(feature_set(), start, end, store)


def test_incremental_runs(spark, store):
    fs, hours_3 = feature_set(), timedelta(hours=3)
    first = "2024-01-05 00:00:00"
    assert hs.next_window(fs, store, "2024-01-05 03:19:59", hours_3, first) is None
    assert hs.next_window(fs, store, "2024-01-05 03:20:00", hours_3, first) == (
        datetime(2024, 1, 5), datetime(2024, 1, 5, 3),
    )
    hs.materialize_next(fs, store, "2024-01-05 10:00:00", hours_3, first)
    assert store.covered(fs) == [(datetime(2024, 1, 5), datetime(2024, 1, 5, 9))]
    assert hs.materialize_next(fs, store, "2024-01-05 11:00:00", hours_3, first) is None
    assert hs.materialize_next(fs, store, "2024-01-05T14:20:00+02:00", hours_3, first) == (
        datetime(2024, 1, 5, 9), datetime(2024, 1, 5, 12),
    )
    assert rows(store.read(fs)) == full(spark, "2024-01-05", "2024-01-05 12:00:00")


ODD = [
    hs.Rolling("n7", "count", "id", timedelta(days=7)),
    hs.Rolling("sum_1d1s", "sum", "amount", timedelta(days=1, seconds=1)),
    hs.Rolling("avg_50m", "avg", "amount", timedelta(minutes=50)),
    hs.Rolling("sum_3d", "sum", "amount", timedelta(days=3)),
]


@pytest.mark.parametrize("policy", [None, hs.SkewPolicy(dense_rows=25, hot_rows=9)])
def test_runs_go_on_from_kept_sums(spark, store, policy):
    """In every bit as all at once: on and off the hour, over runs with and without sums, replaced in part."""
    fs = feature_set(transformer=hs.RollingTransformer(["acc"], "at", ODD, policy=policy))
    bounds = ["2024-01-03 00:04:10", "2024-01-08 01:00:00", "2024-01-12 04:00:00", "2024-01-12 07:30:01", "2024-01-16"]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        hs.backfill(fs, a, b, store, keep_state=i != 2)
    hs.backfill(fs, "2024-01-10 02:20:00", "2024-01-11 03:40:30", store, keep_state=True)
    hs.backfill(fs, "2024-01-16", "2024-01-18 09:00:00", store, keep_state=True)
    everything = compute_features(spark, fs)
    wanted = rows(everything.where((F.col("at") >= F.lit(bounds[0])) & (F.col("at") < F.lit("2024-01-18 09:00:00"))))
    assert rows(store.read(fs)) == wanted != []


def test_a_short_run_reads_its_own_source_rows_and_tiles(spark, store):
    from hindsight.plans.materialize import resumed

    fs = feature_set()
    for a, b in ((-9, -3), (-3, 1), (1, 4)):
        hs.backfill(fs, at(days=a), at(days=b), store, keep_state=True)
    start, end = datetime(2024, 1, 14), datetime(2024, 1, 14, 3)
    assert store.covered(fs)[-1][1] == start
    features, state = resumed(fs, start, end, store)
    text = plan(features)
    sources = [part[: part.index("ReadSchema")] for part in text.split("FileScan")[1:] if "events.parquet" in part]
    assert sources and all("GreaterThanOrEqual(ts,2024-01-14T00:00)" in s and "LessThan(ts,2024-01-14T03:00)" in s for s in sources)
    sums = {r["__grain"]: r["count"] for r in store.read_table(fs, "sums", "__at", store.snapshot(fs), (None, None)).groupBy("__grain").count().collect()}
    assert sums[3600] < sums[1]
    assert rows(features) == full(spark, "2024-01-14", "2024-01-14 03:00:00")
    hs.materialize_next(fs, store, end + timedelta(minutes=20), timedelta(hours=3))
    assert rows(store.read(fs, (start, end))) == full(spark, "2024-01-14", "2024-01-14 03:00:00")


def test_schedule_of_the_feature_set(spark, store):
    schedule = {"interval": 3, "frequency": "Hour", "start_time": "2024-01-05 00:30:20"}
    fs = replace(feature_set(), schedule=schedule)
    assert hs.next_window(fs, store, "2024-01-05 09:59:59") == (
        datetime(2024, 1, 5, 0, 30, 20), datetime(2024, 1, 5, 9, 30, 20),
    )
    with pytest.raises(ValueError, match="no schedule"):
        hs.next_window(feature_set(), store, "2024-01-05 09:59:59")
    with pytest.raises(ValueError, match="no first time"):
        hs.next_window(feature_set(), store, "2024-01-05 09:59:59", timedelta(hours=3))


def test_read_through_equals_the_computation(spark, store):
    fs = feature_set()
    hs.backfill(fs, "2024-01-05", "2024-01-08", store)
    hs.backfill(fs, "2024-01-07", "2024-01-09 12:00:00", store)
    hs.backfill(fs, "2023-01-01", "2023-01-02", store)  # a window without rows
    assert rows(hs.read_features(spark, fs, store)) == full(spark)
    span = ("2024-01-06 05:00:00", "2024-01-10 01:00:00")
    assert rows(hs.read_features(spark, fs, store, *span)) == full(spark, *span)
    inside = ("2024-01-06", "2024-01-07")
    result = hs.read_features(spark, fs, store, *inside)
    assert rows(result) == full(spark, *inside)
    assert "events.parquet" not in plan(result)


def test_a_store_with_empty_windows_only(spark, store):
    fs = feature_set()
    hs.backfill(fs, "2023-01-01", "2023-01-02", store)
    assert rows(hs.read_features(spark, fs, store, "2023-01-01", "2023-01-02")) == []
    assert rows(hs.read_features(spark, fs, store)) == full(spark)


def test_rows_without_time_come_with_an_unlimited_read_only(spark, store, tmp_path):
    path = str(tmp_path / "source")
    table(spark, "user_id long, ts timestamp, value double, event_id long", [
        (1, None, 1.0, 1), (1, None, 2.0, 2), (1, at(), 4.0, 3), (1, at(days=1), 8.0, 4),
    ]).write.parquet(path)
    fs = feature_set(path)
    assert rows(hs.read_features(spark, fs, start=at(), end=at(days=1))) == [(1, at(), 1, 1, 3)]
    hs.backfill(fs, at(), at(days=1), store)
    wanted = [(1, at(), 1, 1, 3), (1, at(days=1), 2, 2, 4), (1, None, 2, 2, 3), (1, None, 2, 2, 3)]
    assert rows(hs.read_features(spark, fs)) == rows(hs.read_features(spark, fs, store)) == sorted(wanted, key=repr)


def test_filters_reach_the_files(spark, store):
    fs = feature_set()
    source = plan(compute_features(spark, fs, [(datetime(2024, 1, 10), datetime(2024, 1, 12))]))
    pushed = source[source.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed
    hs.backfill(fs, "2024-01-10", "2024-01-14", store)
    hs.backfill(fs, "2024-01-12", "2024-01-13", store)
    stored = plan(store.read(fs, (datetime(2024, 1, 11), datetime(2024, 1, 12))))
    partitions = stored[stored.index("PartitionFilters"):stored.index("PushedFilters")]
    assert "day" in partitions and "run" in partitions
    assert "GreaterThanOrEqual(at," in stored


def test_gaps():
    h = lambda n: datetime(2024, 1, 1, n)
    covered = [(h(2), h(4)), (h(6), h(8))]
    assert gaps(covered, (None, None)) == [(None, h(2)), (h(4), h(6)), (h(8), None)]
    assert gaps(covered, (h(2), h(4))) == []
    assert gaps(covered, (h(3), h(7))) == [(h(4), h(6))]
    assert gaps(covered, (h(0), h(1))) == [(h(0), h(1))]
    assert gaps(covered, (h(9), None)) == [(h(9), None)]
    assert gaps([], (h(1), h(2))) == [(h(1), h(2))]


def test_output_must_conform_to_the_declared_features(spark):
    wrong = feature_set(features=(Column("n3", "double"),))
    with pytest.raises(ValueError, match="declared double"):
        compute_features(spark, wrong)
    missing = feature_set(features=(Column("n4", "long"),))
    with pytest.raises(ValueError, match="missing column 'n4'"):
        compute_features(spark, missing)
    fs = feature_set()
    frozen = fs.frozen(compute_features(spark, fs).schema)
    assert [(c.name, c.type) for c in frozen.features] == [("n3", "long"), ("n7", "long"), ("last", "long")]
    assert compute_features(spark, frozen).columns == ["acc", "at", "n3", "n7", "last"]


def test_function_and_no_transformer(spark):
    doubled = feature_set(transformer=lambda df: df.select("acc", "at", (F.col("amount") * 2).alias("twice")))
    assert compute_features(spark, doubled).columns == ["acc", "at", "twice"]
    same = feature_set(transformer=None)
    assert compute_features(spark, same).columns == ["acc", "at", "id", "event_type", "amount", "props"]


def test_outline_has_the_rows_of_the_features(spark, store):
    from hindsight.plans.materialize import outline

    fs = feature_set()
    hs.backfill(fs, "2024-01-05", "2024-01-08", store)
    span = ("2024-01-04", "2024-01-10 06:00:00")
    lines = outline(spark, fs, store, *span)
    assert rows(lines) == rows(hs.read_features(spark, fs, store, *span).select("acc", "at"))
    assert "Window" not in plan(lines)
    renamed = feature_set(transformer=lambda df: df.selectExpr("CAST(acc AS STRING) AS name", "at", "amount"))
    assert outline(spark, replace(renamed, index_columns=(Column("name", "string"),)), store) is None


def test_features_of_some_entities(spark, store):
    few = spark.sql("SELECT explode(array(1L, 3L, 1000L)) AS acc").distinct()
    hs.backfill(feature_set(), "2024-01-05", "2024-01-08", store)
    for fs in (feature_set(), feature_set(transformer=lambda df: hs.rolling(df, ["acc"], "at", AGGS))):
        found = hs.read_features(spark, fs, store, "2024-01-04", "2024-01-12", few)
        wanted = hs.read_features(spark, fs, store, "2024-01-04", "2024-01-12").where("acc IN (1, 3)")
        assert rows(found) == rows(wanted) != []


@pytest.fixture
def elsewhere(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_other_zones_are_an_error_and_lose_no_row(spark, store, elsewhere, zone):
    fs = feature_set()
    hs.backfill(fs, "2024-01-10", "2024-01-12", store)
    wanted = store.read(fs).count()
    elsewhere(zone)
    spine = spark.sql("SELECT 1L AS acc, TIMESTAMP '2024-01-11 00:00:00' AS at")
    view = hs.FeatureView(spine.withColumnRenamed("at", "seen"), ["acc"], "seen", [])
    for action in (
        lambda: hs.backfill(fs, "2024-01-10", "2024-01-12", store), lambda: store.read(fs),
        lambda: hs.read_features(spark, fs, store), lambda: hs.point_in_time(spine, "at", [view]),
    ):
        with pytest.raises(ValueError, match="UTC"):
            action()
    elsewhere("Etc/UTC")
    assert store.read(fs).count() == wanted == len(full(spark, "2024-01-10", "2024-01-12"))


def test_no_more_is_read_than_the_frames_need(spark):
    fs = feature_set(source_lookback=timedelta(days=60))
    text = plan(compute_features(spark, fs, [(datetime(2024, 1, 20), datetime(2024, 1, 20, 3))]))
    assert "GreaterThanOrEqual(ts,2024-01-13T00:00" in text


def test_only_declared_transformers_see_a_part_of_the_entities(spark):
    class Ranks(hs.RollingTransformer.__mro__[1]):
        keys = ["acc"]

        def _transform(self, df):
            return df.groupBy("acc").agg(F.max("at").alias("at"), F.sum("amount").alias("own")).withColumn(
                "place", F.expr("rank() OVER (ORDER BY own, acc)").cast("long")
            )

    fs = feature_set(transformer=Ranks())
    one = spark.createDataFrame([(3,)], "acc long")
    everything = compute_features(spark, fs).where("acc = 3").first()
    assert compute_features(spark, fs, entities=one).collect() == [everything]


def test_scratch_folders_are_shared(monkeypatch):
    from types import SimpleNamespace

    from hindsight.session import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://there:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("local-cluster[2,1,1024]"))
    assert shared_folder(session("yarn", "hdfs://x/tmp/")).startswith("hdfs://x/tmp/hindsight-")
    assert shared_folder(session("yarn"), "s3://given").startswith("s3://given/hindsight-")
    assert shared_folder(session("local[2]")).startswith("/")


def test_feature_sets_without_time(spark, store, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double").write.parquet(path)
    spark.createDataFrame([(1, 7.0)], "k long, v double").write.parquet(other)
    fs = hs.FeatureSet("s", "1", hs.Source(path, rename={"k": "acc"}), (Column("acc", "long"),))
    changed = replace(fs, source=hs.Source(other, rename={"k": "acc"}))
    assert rows(hs.read_features(spark, fs, store)) == [(1, 2.0), (2, 3.0)]
    hs.backfill_whole(fs, store)
    assert rows(hs.read_features(spark, changed, store)) == [(1, 2.0), (2, 3.0)]
    in_flight = hs.read_features(spark, fs, store)
    hs.backfill_whole(changed, store)
    assert rows(hs.read_features(spark, fs, store)) == [(1, 7.0)] and rows(in_flight) == [(1, 2.0), (2, 3.0)]
    one = spark.createDataFrame([(2,)], "acc long")
    assert rows(hs.read_features(spark, fs, entities=one)) == [(2, 3.0)]
    assert len(store.vacuum(fs, 2)) == 1 and rows(hs.read_features(spark, fs, store)) == [(1, 7.0)]
    with pytest.raises(ValueError, match="no time"):
        compute_features(spark, fs, [(at(), at(days=1))])
