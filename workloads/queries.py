"""The library's operators as queries over the test tables.

`events` plays the transactions, its purchases the observations; `orders` is a second
transaction table with many equal times.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import hindsight as hs
from hindsight.plans.learn import training_matrix as make_numeric
from hindsight.session import prepare, shared_folder
from hindsight.sources.scan import write_table
from hindsight.spec.model import Column

# Column names, frames and the requested features of the feature sets.
DAYS_3, DAYS_7 = timedelta(days=3), timedelta(days=7)
TRANSACTIONS = {
    "event_id": "transactionID",
    "user_id": "accountID",
    "ts": "timestamp",
    "value": "transactionAmount",
}
ROLLING_3D = [
    hs.Rolling("transaction_3d_count", "count", "transactionID", DAYS_3),
    hs.Rolling("transaction_amount_3d_sum", "sum", "transactionAmount", DAYS_3),
    hs.Rolling("transaction_amount_3d_avg", "avg", "transactionAmount", DAYS_3),
]
ROLLING_7D = [
    hs.Rolling("transaction_7d_count", "count", "transactionID", DAYS_7),
    hs.Rolling("transaction_amount_7d_sum", "sum", "transactionAmount", DAYS_7),
    hs.Rolling("transaction_amount_7d_avg", "avg", "transactionAmount", DAYS_7),
]
ROLLING = ROLLING_3D + ROLLING_7D
REQUESTED = [
    hs.FeatureRef("accountAge", "accounts", "4"),
    hs.FeatureRef("numPaymentRejects1dPerUser", "accounts", "4"),
    hs.FeatureRef("transaction_amount_7d_sum", "transactions", "4"),
    hs.FeatureRef("transaction_amount_3d_sum", "transactions", "4"),
    hs.FeatureRef("transaction_amount_7d_avg", "transactions", "4"),
]
KEYS = ["accountID"]
# Small sizes that send keys of the test tables down the routes for crowded keys.
SOME_CROWDED = hs.SkewPolicy(dense_rows=22, hot_rows=70)
ALL_CROWDED = hs.SkewPolicy(dense_rows=1, hot_rows=3)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return hs.scan(prepare(spark), f"{sf}/{name}.parquet")


def _transactions(spark, sf) -> DataFrame:
    events = _table(spark, sf, "events").withColumnsRenamed(TRANSACTIONS)
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _rounded(df: DataFrame) -> DataFrame:
    """Sums and averages rounded, times as stored in the tables, for the comparison."""
    digits = {"sum": 4, "avg": 7}
    return df.select(*[
        F.round(f.name, digits[f.name[-3:]]).alias(f.name) if f.name[-3:] in digits
        else F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
        else F.col(f.name)
        for f in df.schema
    ])


def _accounts(spark, sf) -> DataFrame:
    """One row per account and day, stamped at the next midnight."""
    events = _table(spark, sf, "events")
    daily = events.groupBy(
        F.col("user_id").alias("accountID"), F.col("ts").cast("date").alias("day")
    ).agg(F.count_if(F.col("event_type") == "error").alias("rejects"))
    first = F.min("day").over(Window.partitionBy("accountID"))
    return daily.select(
        "accountID",
        F.date_add("day", 1).cast("timestamp").alias("timestamp"),
        F.col("rejects").cast("double").alias("numPaymentRejects1dPerUser"),
        F.date_diff(F.date_add("day", 1), first).cast("double").alias("accountAge"),
    )


def _observations(spark, sf) -> DataFrame:
    events = _table(spark, sf, "events")
    return events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("transactionID"),
        F.col("user_id").alias("accountID"),
        F.col("ts").alias("timestamp"),
        (F.col("value") > 100).alias("is_fraud"),
    )


def _other_events(spark, sf) -> DataFrame:
    return _table(spark, sf, "events").where("event_type <> 'purchase'").select(
        F.col("user_id").alias("accountID"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("lastType"),
        F.col("value").alias("lastValue"),
    )


def _transactions_set(sf: str) -> hs.FeatureSet:
    return hs.FeatureSet(
        name="transactions",
        version="4",
        source=hs.Source(f"{sf}/events.parquet", "ts", timedelta(minutes=20), TRANSACTIONS),
        index_columns=(Column("accountID", "long"),),
        transformer=hs.RollingTransformer(KEYS, "timestamp", ROLLING),
        features=tuple(Column(a.name, "long" if a.func == "count" else "double") for a in ROLLING),
        source_lookback=timedelta(days=60),
        join_lookback=timedelta(days=60),
    )


def _accounts_set(spark, sf, folder: str) -> hs.FeatureSet:
    """The accounts set over its precalculated table, written first."""
    write_table(_accounts(spark, sf), f"{folder}/accounts")
    return hs.FeatureSet(
        name="accounts",
        version="4",
        source=hs.Source(f"{folder}/accounts", "timestamp"),
        index_columns=(Column("accountID", "long"),),
    )


# Scans, projections, scalar functions


def scan_filter_project(spark, sf):
    events = hs.filter_rows(_table(spark, sf, "events"), "col('value') > 50 and event_type <> 'error'")
    return hs.drop_columns(hs.pick(events, "event_id", "user_id", "ts", "value", "props"), ["props"])


def scan_head(spark, sf):
    return hs.preview(_table(spark, sf, "events").select("event_id", "user_id", "value"), 5, ["event_id"])


def scan_path_column(spark, sf):
    orders = hs.scan(prepare(spark), f"{sf}/orders.parquet", path_column="Path")
    return orders.groupBy(F.regexp_extract("Path", "([^/]+)$", 1).alias("file")).agg(F.count("o_orderkey").alias("n"))


def load_recipe(spark, sf):
    """A recipe with every kind of step, saved, opened and replayed."""
    folder = shared_folder(prepare(spark))
    kinds = {"true_values": ["purchase", "signup"], "false_values": ["view", "click"]}
    recipe = (
        hs.Recipe((f"{sf}/events.parquet",))
        .then("filter", "col('value') > 20")
        .then("drop_columns", ["props"])
        .then("convert_column_types", {"event_type": kinds})
        .then("extract_columns_from_partition_format", "/{source}.parquet")
    )
    recipe.save(spark, folder)
    return hs.Recipe.open(spark, folder).load(spark)


def to_bool(spark, sf):
    orders = _table(spark, sf, "orders")
    return orders.select("o_orderkey", hs.to_bool("o_orderstatus", ["F"], ["O"]).alias("is_done"))


def epoch_seconds(spark, sf):
    return _table(spark, sf, "events").select("event_id", hs.epoch_seconds("ts").alias("sec"))


def sample_by_key(spark, sf):
    return hs.sample_by_key(_table(spark, sf, "events"), "event_id", 0.1).select("event_id", "user_id", "value")


def sample_rows(spark, sf):
    """What holds of any sample: rows of the table, none twice, about as many as asked for."""
    events = _table(spark, sf, "events").select("event_id", "user_id", "value")
    sample, share = hs.sample_rows(events, 0.05, 735), 0.05
    of_table = sample.join(events, ["event_id", "user_id", "value"], "left_semi").agg(F.count("*").alias("known"))
    counts = sample.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
    whole = events.agg(F.count("*").alias("all"))
    # six standard deviations around the mean
    near = F.abs(F.col("n") - share * F.col("all")) <= 6 * F.sqrt(share * (1 - share) * F.col("all"))
    one = [df.withColumn("_", F.lit(1)) for df in (of_table, counts, whole)]
    return one[0].join(one[1], "_").join(one[2], "_").select(
        (F.col("known") == F.col("n")).alias("subset"), (F.col("ids") == F.col("n")).alias("distinct"), near.alias("near")
    )


def sample_of_content(spark, sf):
    """A sample of rows most of which have many copies, the same under another partitioning."""
    kinds = _table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"))
    one, other = (hs.sample_by_content(df, 0.05, 735) for df in (kinds, kinds.repartition(7)))
    counted = [df.groupBy(*df.columns).agg(F.count("*").alias(n)) for df, n in ((one, "n"), (other, "again"))]
    return counted[0].join(counted[1], kinds.columns, "full")


def time_coverage(spark, sf):
    return hs.time_coverage(_table(spark, sf, "events"), "ts")


# Rolling aggregates


def _rolling(aggs, policy=hs.SkewPolicy()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        return _rounded(hs.rolling(_transactions(spark, sf), KEYS, "timestamp", aggs, policy=policy))

    return run


def rolling_transformer(spark, sf):
    """The transactions feature set computed from its source."""
    return _rounded(hs.read_features(prepare(spark), _transactions_set(sf)))


def rolling_odd_frames(spark, sf):
    """Frames of 7 days, 90 seconds and a day and a second, for crowded keys."""
    aggs = [
        hs.Rolling("count_7d", "count", "transactionID", DAYS_7),
        hs.Rolling("sum_90s", "sum", "transactionAmount", timedelta(seconds=90)),
        hs.Rolling("sum_1d1s", "sum", "transactionAmount", timedelta(days=1, seconds=1)),
    ]
    rows = hs.rolling(_transactions(spark, sf), KEYS, "timestamp", aggs, keep=["transactionID"], policy=ALL_CROWDED)
    return _rounded(rows.withColumnsRenamed({"sum_90s": "short_sum", "sum_1d1s": "long_sum"}))


def rolling_orders_30d(spark, sf, policy=hs.SkewPolicy()):
    orders = _table(spark, sf, "orders")
    aggs = [
        hs.Rolling("orders_30d_count", "count", "o_orderkey", timedelta(days=30)),
        hs.Rolling("price_30d_sum", "sum", "o_totalprice", timedelta(days=30)),
        hs.Rolling("price_90d_sum", "sum", "o_totalprice", timedelta(days=90)),
    ]
    rolled = hs.rolling(orders, ["o_custkey"], "o_orderdate", aggs, keep=["o_orderkey"], policy=policy)
    return rolled.select(
        "o_orderkey", "o_custkey", "o_orderdate", "orders_30d_count",
        F.round("price_30d_sum", 2).alias("price_30d_sum"), F.round("price_90d_sum", 2).alias("price_90d_sum"),
    )


def rolling_orders_30d_crowded(spark, sf):
    return rolling_orders_30d(spark, sf, hs.SkewPolicy(dense_rows=1, hot_rows=1))


# Point-in-time joins


def pit_hot_entity(spark, sf):
    """A third of all observations and feature rows on one entity, a sixth on one of its instants."""
    events = _table(spark, sf, "events")
    third, instant = F.col("event_id") % 3 == 0, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    events = events.select(
        "event_id", F.when(third, -1).otherwise(F.col("user_id")).alias("accountID"), "event_type", "value",
        F.when(F.col("event_id") % 6 == 0, instant).otherwise(F.col("ts")).alias("timestamp"),
    )
    view = hs.FeatureView(
        events.where("event_type <> 'purchase'").select("accountID", "timestamp", F.col("value").alias("lastValue"), F.col("event_id").alias("lastEvent")),
        KEYS, "timestamp", ["lastValue", "lastEvent"], timedelta(hours=30), timedelta(minutes=20),
    )
    spine = events.where("event_type = 'purchase'").select("event_id", "accountID", "timestamp")
    return hs.point_in_time(spine, "timestamp", [view]).withColumn("lastEvent", F.col("lastEvent").cast("string"))


def _pit_events(policy=hs.SkewPolicy(), **bounds) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        view = hs.FeatureView(
            _other_events(spark, sf), KEYS, "timestamp", ["lastType", "lastValue"], name="others", **bounds
        )
        return hs.point_in_time(_observations(spark, sf), "timestamp", [view], policy)

    return run


def _pit_two_sets(policy=hs.SkewPolicy()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        source = _transactions(spark, sf)
        transactions = hs.rolling(source, KEYS, "timestamp", ROLLING, policy=policy)
        views = [
            hs.FeatureView(
                _accounts(spark, sf), KEYS, "timestamp", ["accountAge", "numPaymentRejects1dPerUser"],
                timedelta(days=365), name="accounts",
            ),
            hs.FeatureView(
                transactions, KEYS, "timestamp",
                ["transaction_amount_7d_sum", "transaction_amount_3d_sum", "transaction_amount_7d_avg"],
                timedelta(days=60), timedelta(minutes=20), name="transactions", outline=source,
            ),
        ]
        return _rounded(hs.point_in_time(_observations(spark, sf), "timestamp", views, policy))

    return run


def pit_composite_key(spark, sf):
    """Every event finds the one before of its user and kind, on two key columns."""
    events = _table(spark, sf, "events")
    view = hs.FeatureView(
        events.select("user_id", "event_type", "ts", F.col("value").alias("previous")),
        ["user_id", "event_type"], "ts", ["previous"], timedelta(days=5), timedelta(seconds=1),
    )
    return hs.point_in_time(events.select("event_id", "user_id", "event_type", "ts"), "ts", [view])


def _pit_ties(policy=hs.SkewPolicy()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        orders = _table(spark, sf, "orders")
        spine = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
        view = hs.FeatureView(
            orders.where("o_orderpriority <> '1-URGENT'").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"),
            ["o_custkey"], "o_orderdate", ["o_totalprice", "o_orderstatus"], timedelta(days=400), prefix="last_",
        )
        return hs.point_in_time(spine, "o_orderdate", [view], policy)

    return run


def pit_two_keys(spark, sf):
    """Two sets with different keys: per customer and per order priority."""
    orders = _table(spark, sf, "orders")
    done = orders.where("o_orderstatus <> 'O'")
    spine = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    by_customer = hs.FeatureView(
        done.select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("customer_price")),
        ["o_custkey"], "o_orderdate", ["customer_price"],
    )
    by_priority = hs.FeatureView(
        done.select("o_orderpriority", "o_orderdate", F.col("o_totalprice").alias("priority_price")),
        ["o_orderpriority"], "o_orderdate", ["priority_price"], delay=timedelta(days=1),
    )
    return hs.point_in_time(spine, "o_orderdate", [by_customer, by_priority])


# Materialisation

WINDOW = ("2024-01-10 06:00:00", "2024-01-20 23:59:00")


def backfill_window(spark, sf):
    """One window stored, from mid-day to mid-day, and read back; run twice."""
    fs, store = _transactions_set(sf), hs.OfflineStore(prepare(spark), shared_folder(spark))
    hs.backfill(fs, *WINDOW, store)
    hs.backfill(fs, *WINDOW, store)
    return _rounded(store.read(fs))


def incremental_equals_full(spark, sf):
    """Recurring runs at a three-hour grid, catching up at three moments."""
    fs, store = _transactions_set(sf), hs.OfflineStore(prepare(spark), shared_folder(spark))
    for now in ("2024-01-08 01:00:00", "2024-01-08 03:30:00", "2024-01-17 12:05:00"):
        hs.materialize_next(fs, store, now, timedelta(hours=3), "2024-01-05 00:00:00")
    return _rounded(store.read(fs))


def read_through(spark, sf):
    """Two stored windows, one partly replaced, the rest computed."""
    fs, store = _transactions_set(sf), hs.OfflineStore(prepare(spark), shared_folder(spark))
    hs.backfill(fs, "2024-01-04 00:00:00", "2024-01-09 12:00:00", store)
    hs.backfill(fs, "2024-01-08 00:00:00", "2024-01-10 00:00:00", store)
    hs.backfill(fs, "2024-01-20 00:00:00", "2024-01-21 06:30:00", store)
    return _rounded(hs.read_features(spark, fs, store))


def passthrough_set(spark, sf):
    """A feature set without transformer: the precalculated accounts table."""
    fs = _accounts_set(prepare(spark), sf, shared_folder(spark))
    return _rounded(hs.read_features(spark, fs))


# Retrieval


def _retrieved(spark, sf) -> tuple[DataFrame, list[hs.FeatureSet], str]:
    folder = shared_folder(prepare(spark))
    sets = [_accounts_set(spark, sf, folder), _transactions_set(sf)]
    store = hs.OfflineStore(spark, f"{folder}/store")
    hs.backfill(sets[1], "2024-01-03 00:00:00", "2024-01-15 00:00:00", store)
    rows = hs.get_offline_features(spark, REQUESTED, sets, _observations(spark, sf), "timestamp", store)
    return rows, sets, folder


def training_matrix(spark, sf):
    """Training data written with its spec, read back, and made numeric."""
    rows, _, folder = _retrieved(spark, sf)
    hs.write_dataset(rows, hs.RetrievalSpec(tuple(REQUESTED)), f"{folder}/training")
    data, spec = hs.read_dataset(spark, f"{folder}/training")
    return _rounded(make_numeric(data, [f.feature for f in spec.features], "is_fraud"))


def inference_dataset(spark, sf):
    """Features for unlabelled observations by the spec found in a model folder."""
    folder = shared_folder(prepare(spark))
    sets = [_accounts_set(spark, sf, folder), _transactions_set(sf)]
    hs.RetrievalSpec(tuple(REQUESTED)).save(spark, f"{folder}/model")
    unlabelled = _observations(spark, sf).drop("is_fraud")
    return _rounded(hs.retrieve_for_model(spark, f"{folder}/model", sets, unlabelled, "timestamp"))


def _customers_set(sf: str) -> hs.FeatureSet:
    """A feature set without a time column."""
    return hs.FeatureSet(
        name="customers",
        version="1",
        source=hs.Source(f"{sf}/customer.parquet", rename={"c_custkey": "o_custkey"}),
        index_columns=(Column("o_custkey", "long"),),
        features=(Column("c_acctbal", "double"), Column("c_mktsegment", "string")),
    )


def timeless_set(spark, sf):
    """Features without time of stored and of computed rows, beside a set with time."""
    folder = shared_folder(prepare(spark))
    fs, store = _customers_set(sf), hs.OfflineStore(spark, folder)
    orders = _table(spark, sf, "orders")
    done = hs.FeatureSet(
        name="orders", version="1", source=hs.Source(f"{sf}/orders.parquet", "o_orderdate"), index_columns=(Column("o_custkey", "long"),),
        transformer=lambda df: df.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("last_price")),
        features=(Column("last_price", "double"),), join_lookback=timedelta(days=10_000),
    )
    spine = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    refs = [fs.feature("c_acctbal"), done.feature("last_price"), fs.feature("c_mktsegment")]
    hs.backfill_whole(fs, store)
    return hs.get_offline_features(spark, refs, [fs, done], spine, "o_orderdate", store)


def timeless_duplicates(spark, sf):
    """Of an entity's rows without time the greatest by its values wins."""
    orders = _table(spark, sf, "orders")
    view = hs.FeatureView(orders, ["o_custkey"], None, ["o_orderpriority", "o_totalprice"], prefix="top_")
    spine = _table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return hs.point_in_time(spine, "at", [view]).drop("at")


def saved_set(spark, sf):
    """A feature set written as a spec file, read again, and computed."""
    fs = hs.FeatureSet("amounts", "1", hs.Source(f"{sf}/events.parquet", "ts"), (Column("user_id", "long"),), hs.RollingTransformer(["user_id"], "ts", [
        hs.Rolling("day_sum", "sum", "value", timedelta(days=1)), hs.Rolling("day_count", "count", "event_id", timedelta(days=1)),
    ]))
    fs = fs.frozen(hs.compute_features(prepare(spark), fs).schema)
    path = hs.save_feature_set(spark, fs, shared_folder(spark))
    known = {f"{type(fs.transformer).__module__}.{type(fs.transformer).__name__}": fs.transformer}
    return _rounded(hs.read_features(spark, hs.load_feature_set(path, fs.name, fs.version, known)).withColumnRenamed("day_count", "n"))


# Learning


def split_by_key(spark, sf):
    train_rows, test_rows = hs.split(_table(spark, sf, "events").select("event_id", "value"), "event_id")
    return train_rows.withColumn("part", F.lit("train")).unionByName(test_rows.withColumn("part", F.lit("test")))


def confusion(spark, sf):
    return hs.confusion(_table(spark, sf, "labels"), "quality", "toxic")


def classification_metrics(spark, sf):
    metrics = hs.evaluate(_table(spark, sf, "labels"), "quality", "toxic")
    return metrics.select(
        "n", "tp", "fp", "fn", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1", "accuracy")]
    )


def _trained(spark, sf):
    rows, _, folder = _retrieved(spark, sf)
    hs.write_dataset(rows, hs.RetrievalSpec(tuple(REQUESTED)), f"{folder}/training")
    data, spec = hs.read_dataset(spark, f"{folder}/training")
    features = [f.feature for f in spec.features]
    trained = hs.train(data, "is_fraud", features, "transactionID")
    hs.save_model(trained.model, spec, spark, f"{folder}/fitted")
    return data, trained.model, folder


def _scored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All observations as scored by the fitted and by the loaded model, written and read back."""
    data, model, folder = _trained(spark, sf)
    loaded, _ = hs.load_model(spark, f"{folder}/fitted")
    for name, m in (("scored", loaded), ("by_fitted", model)):
        write_table(hs.score(m, data, probability="probability"), f"{folder}/{name}")
    return hs.scan(spark, f"{folder}/scored"), hs.scan(spark, f"{folder}/by_fitted")


def rf_score(spark, sf):
    """What holds of the scores of every observation, whatever the trees are."""
    scored, fitted = _scored(spark, sf)
    p, label = F.col("probability"), F.col("predict_is_fraud")
    other = fitted.select("transactionID", p.alias("p"), label.alias("l"))
    return scored.join(other, "transactionID").select(
        "transactionID",
        label.isin(0, 1).alias("is_class"),
        (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        (F.get(p, label) == F.array_max(p)).alias("is_larger"),
        ((F.col("p") == p) & (F.col("l") == label)).alias("as_fitted"),
    )


def rf_learns(spark, sf):
    """A forest on a label that the features tell, and one on shuffled labels: what both have learned.

    The accuracy on rows held out is compared with the share of the larger class, on stored scores.
    """
    events = _table(spark, sf, "events").select(
        "event_id", "value", F.pmod("user_id", F.lit(7)).alias("noise"), (F.col("value") > 60).alias("told"),
        (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 7, 2), 16, 10).cast("int") % 2 == 0).alias("untold"),
    )
    out = []
    for label in ("told", "untold"):
        trained = hs.train(events.select("event_id", "value", "noise", label), label, ["value", "noise"], "event_id")
        folder = shared_folder(spark)
        write_table(trained.test, folder)
        y, p = F.col(label).cast("int"), F.col("predict_is_fraud")
        out.append(hs.scan(spark, folder).agg(
            F.lit(label).alias("label"), F.count("*").alias("held_out"), F.greatest(F.count_if(y == 1), F.count_if(y == 0)).alias("larger"),
            F.count_if(y == p).alias("right"),
        ))
    both = out[0].unionByName(out[1])
    return both.select("label", "held_out", "larger", (F.col("right") > F.col("larger") + 0.9 * (F.col("held_out") - F.col("larger"))).alias("has_learned"))


def rf_metrics(spark, sf):
    """Metrics of stored scores against counts of the stored rows."""
    scored, _ = _scored(spark, sf)
    y, p = F.col("is_fraud").cast("int"), F.col("predict_is_fraud")
    counted = scored.agg(F.count_if((p == 1) & (y == 1)).alias("a"), F.count_if(p == 1).alias("b"), F.count_if(y == p).alias("c"), F.count("*").alias("d"))
    found = hs.evaluate(scored, "is_fraud", "predict_is_fraud").withColumn("_", F.lit(1)).join(counted.withColumn("_", F.lit(1)), "_")
    share = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    return found.select(
        "n", (F.col("precision") == share).alias("precision_right"), (F.col("accuracy") == F.col("c") / F.col("d")).alias("accuracy_right")
    )


def quality_gate(spark, sf):
    """Which of some thresholds the metrics of a table pass."""
    metrics = hs.evaluate(_table(spark, sf, "labels"), "quality", "toxic")
    passed = []
    for bound in (0.0, 0.25, 0.5, 0.75, 1.0):
        try:
            hs.check_quality(metrics, {"accuracy": bound})
            passed.append((bound, True))
        except ValueError:
            passed.append((bound, False))
    gates = spark.createDataFrame(passed, "bound double, passed boolean")
    return gates.withColumn("_", F.lit(1)).join(metrics.select(F.round("accuracy", 9).alias("accuracy"), F.lit(1).alias("_")), "_").drop("_")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_filter_project": scan_filter_project,
    "scan_head": scan_head,
    "scan_path_column": scan_path_column,
    "load_recipe": load_recipe,
    "to_bool": to_bool,
    "epoch_seconds": epoch_seconds,
    "sample_by_key": sample_by_key,
    "sample_rows": sample_rows,
    "time_coverage": time_coverage,
    "rolling_3d": _rolling(ROLLING_3D),
    "rolling_7d": _rolling(ROLLING_7D),
    "rolling_all": _rolling(ROLLING),
    "rolling_some_crowded": _rolling(ROLLING, SOME_CROWDED),
    "rolling_all_crowded": _rolling(ROLLING, ALL_CROWDED),
    "rolling_transformer": rolling_transformer,
    "rolling_orders_30d": rolling_orders_30d,
    "rolling_orders_30d_crowded": rolling_orders_30d_crowded,
    "pit_basic": _pit_events(),
    "pit_basic_hot": _pit_events(ALL_CROWDED),
    "pit_lookback": _pit_events(lookback=timedelta(hours=6)),
    "pit_delay": _pit_events(lookback=timedelta(hours=6), delay=timedelta(minutes=20)),
    "pit_two_sets": _pit_two_sets(),
    "pit_two_sets_hot": _pit_two_sets(SOME_CROWDED),
    "pit_composite_key": pit_composite_key,
    "pit_ties": _pit_ties(),
    "pit_ties_hot": _pit_ties(hs.SkewPolicy(hot_rows=1)),
    "pit_two_keys": pit_two_keys,
    "backfill_window": backfill_window,
    "incremental_equals_full": incremental_equals_full,
    "read_through": read_through,
    "passthrough_set": passthrough_set,
    "training_matrix": training_matrix,
    "inference_dataset": inference_dataset,
    "split_by_key": split_by_key,
    "confusion": confusion,
    "classification_metrics": classification_metrics,
    "quality_gate": quality_gate,
    "rf_score": rf_score,
    "rf_metrics": rf_metrics,
    "rolling_odd_frames": rolling_odd_frames,
    "sample_of_content": sample_of_content,
    "pit_hot_entity": pit_hot_entity,
    "timeless_set": timeless_set,
    "timeless_duplicates": timeless_duplicates,
    "saved_set": saved_set,
    "rf_learns": rf_learns,
}
