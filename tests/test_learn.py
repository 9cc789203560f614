import re
from datetime import timedelta

import pytest
from helpers import at, plan, rows, table
from pyspark.sql import Observation
from pyspark.sql import functions as F

import hindsight as hs
from hindsight.plans.learn import inputs, split_at_random, training_matrix
from hindsight.spec.model import Column


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "y int, p int")


def test_metrics(spark):
    df = predictions(spark, [(1, 1)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 4 + [(None, 1), (1, None)])
    m = hs.evaluate(df, "y", "p").first()
    assert (m.n, m.tp, m.fp, m.fn) == (10, 3, 1, 2)
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.75, 0.6, 6 / 9, 0.7)
    assert {(r.label, r.prediction): r.n for r in hs.confusion(df, "y", "p").collect()} == {
        (1, 1): 3, (0, 1): 1, (1, 0): 2, (0, 0): 4,
    }


@pytest.mark.parametrize("pairs", [[(1, 0), (0, 0)], [(0, 0)], []])
def test_zero_denominators(spark, pairs):
    m = hs.evaluate(predictions(spark, pairs), "y", "p").first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_quality_gate(spark):
    metrics = hs.evaluate(predictions(spark, [(1, 1), (0, 1)]), "y", "p")
    assert hs.check_quality(metrics, {"recall": 1.0})["recall"] == 1.0
    with pytest.raises(ValueError, match="precision"):
        hs.check_quality(metrics, {"precision": 0.6, "recall": 0.9})


def labelled(spark):
    return spark.range(600).select(
        F.col("id").alias("tid"),
        (F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("b"),
        (F.col("id") % 10 > 6).alias("is_fraud"),
    )


def test_split_is_stable_and_complete(spark):
    df = labelled(spark)
    first = [rows(part.select("tid")) for part in hs.split(df, "tid")]
    second = [rows(part.select("tid")) for part in hs.split(df.repartition(5), "tid")]
    assert first == second
    assert sorted(first[0] + first[1]) == [(i,) for i in range(600)]
    assert 0.25 < len(first[1]) / 600 < 0.41
    keyless = df.withColumn("tid", F.lit(None).cast("long"))
    assert [part.count() for part in hs.split(keyless, "tid")] == [600, 0]
    assert sum(part.count() for part in split_at_random(df)) == 600


def test_training_matrix(spark):
    df = labelled(spark)
    assert inputs(df, ["tid", "is_fraud"]) == ["a", "b"]
    matrix = training_matrix(df, ["a", "b"], "is_fraud")
    assert dict(matrix.dtypes)["is_fraud"] == "int"
    assert matrix.where("b IS NULL OR is_fraud IS NULL").count() == 0
    with pytest.raises(ValueError, match="unknown columns"):
        inputs(df, ["nope"])


def test_train_score_save_and_load(spark, tmp_path):
    df = labelled(spark)
    trained = hs.train(df, "is_fraud", ["a", "b"], "tid")
    assert hs.check_quality(trained.metrics, {"precision": 0.95, "recall": 0.95})
    again = hs.train(df, "is_fraud", ["a", "b"], "tid")
    assert rows(trained.test.select("tid", "predict_is_fraud")) == rows(again.test.select("tid", "predict_is_fraud"))

    spec = hs.RetrievalSpec((hs.FeatureRef("a", "s", "1"), hs.FeatureRef("b", "s", "1")))
    hs.save_model(trained.model, spec, spark, str(tmp_path / "m"))
    model, found = hs.load_model(spark, str(tmp_path / "m"))
    assert found == spec
    # Column order must not matter: inputs are taken by name.
    unlabelled = df.select("b", "tid", "a")
    scored = hs.score(model, unlabelled, probability="probability", drop=["tid"])
    assert scored.columns == ["b", "a", "predict_is_fraud", "probability"]
    first = scored.first()
    assert len(first.probability) == 2 and abs(sum(first.probability) - 1) < 1e-9
    assert scored.where("b IS NULL").count() == 0
    kept = hs.score(model, unlabelled).join(hs.score(trained.model, df), "tid")
    assert kept.count() == 600


def sources(spark, tmp_path):
    tx, acc = str(tmp_path / "tx"), str(tmp_path / "acc")
    table(spark, "accountID string, timestamp timestamp, transactionID string, transactionAmount double", [
        ("a", at(days=-1), "t1", 10.0), ("a", at(minutes=-10), "t2", 20.0), ("b", at(days=-70), "t3", 40.0),
    ]).write.parquet(tx)
    table(spark, "accountID string, timestamp timestamp, accountAge double", [
        ("a", at(days=-300), 1.0), ("b", at(days=-366), 2.0),
    ]).write.parquet(acc)
    from datetime import timedelta

    transactions = hs.FeatureSet(
        "transactions", "1", hs.Source(tx, "timestamp", timedelta(minutes=20)), (Column("accountID", "string"),),
        hs.RollingTransformer(["accountID"], "timestamp", [
            hs.Rolling("sum_3d", "sum", "transactionAmount", timedelta(days=3)),
        ]),
        source_lookback=timedelta(days=60), join_lookback=timedelta(days=60),
    )
    return transactions, hs.FeatureSet("accounts", "1", hs.Source(acc, "timestamp"), (Column("accountID", "string"),))


def test_retrieval_for_training_and_for_a_model(spark, tmp_path):
    sets = sources(spark, tmp_path)
    refs = [sets[0].feature("sum_3d"), sets[1].feature("accountAge")]
    spine = table(spark, "transactionID string, accountID string, timestamp timestamp, is_fraud boolean", [
        ("o1", "a", at(), True), ("o2", "b", at(), False), ("o3", "c", at(), False),
    ])
    wanted = [("o1", "a", at(), True, 10.0, 1.0), ("o2", "b", at(), False, None, None), ("o3", "c", at(), False, None, None)]
    training = hs.get_offline_features(spark, refs, sets, spine, "timestamp")
    assert rows(training) == wanted

    text = plan(training)
    frames = [m.start() for m in re.finditer(r"RangeFrame, -259200", text)]
    assert frames and "LeftSemi" in text[frames[-1]:], "the key filter must lie below the window"
    unfiltered = hs.get_offline_features(spark, refs, sets, spine, "timestamp", policy=hs.SkewPolicy(broadcast_bytes=0))
    assert "LeftSemi" not in plan(unfiltered) and rows(unfiltered) == wanted
    assert rows(hs.get_offline_features(spark, refs, sets, spine, "timestamp", policy=None)) == wanted

    store = hs.OfflineStore(spark, str(tmp_path / "store"))
    hs.backfill(sets[0], at(days=-2), at(), store)
    assert rows(hs.get_offline_features(spark, refs, sets, spine, "timestamp", store)) == wanted

    spec = hs.RetrievalSpec(tuple(refs))
    hs.write_dataset(training, spec, str(tmp_path / "out"))
    data, found = hs.read_dataset(spark, str(tmp_path / "out"))
    assert found == spec and rows(data) == wanted

    scoring = hs.retrieve_for_model(spark, str(tmp_path / "out"), sets, spine.drop("is_fraud"), "timestamp")
    assert rows(scoring) == [r[:3] + r[4:] for r in wanted]

    none = hs.get_offline_features(spark, refs, sets, spine.limit(0), "timestamp")
    assert rows(none) == [] and none.columns == training.columns
    with pytest.raises(ValueError, match="unknown feature set"):
        hs.get_offline_features(spark, [hs.FeatureRef("x", "nope", "1")], sets, spine, "timestamp")
    with pytest.raises(ValueError, match="unknown columns"):
        hs.get_offline_features(spark, [hs.FeatureRef("x", "accounts", "1")], sets, spine, "timestamp")


def test_prefixes(spark, tmp_path):
    sets = sources(spark, tmp_path)
    spine = table(spark, "accountID string, timestamp timestamp, accountAge double", [("a", at(), 7.0)])
    with pytest.raises(ValueError, match="prefix"):
        hs.get_offline_features(spark, [sets[1].feature("accountAge")], sets, spine, "timestamp")
    found = hs.get_offline_features(
        spark, [sets[1].feature("accountAge")], sets, spine, "timestamp", prefixes={"accounts": "acc_"}
    )
    assert found.columns[-1] == "acc_accountAge" and rows(found) == [("a", at(), 7.0, 1.0)]


def test_a_fit_reads_its_rows_from_one_file(spark, tmp_path):
    """The rows given are computed once, however often the fit goes over them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = spark.range(300).selectExpr("id AS k", "id % 10 AS x", "id % 10 > 4 AS y").mapInArrow(count, "k long, x long, y boolean")
    trained = hs.train(data, "y", ["x"], "k", folder=str(tmp_path / "rows"))
    assert trained.metrics.first().accuracy == 1.0
    assert seen.value == 300


def test_a_fitted_model_scores_in_a_session_that_observed(spark):
    """What a session has observed cannot be sent to tasks, and the summary of a fit holds its session."""
    seen = Observation()
    assert spark.range(5).observe(seen, F.count("*").alias("n")).count() == 5 and seen.get == {"n": 5}
    data = spark.range(300).selectExpr("id AS k", "id % 10 AS x", "id % 10 > 4 AS y")
    trained = hs.train(data, "y", ["x"], "k")
    assert trained.metrics.first().accuracy == 1.0
    scored = hs.score(trained.model, data, probability="p")
    assert rows(scored.select("k", "predict_is_fraud")) == sorted([(i, int(i % 10 > 4)) for i in range(300)], key=repr)
    assert scored.where("size(p) = 2 AND p[predict_is_fraud] = array_max(p)").count() == 300
    assert trained.model.stages[-1].hasSummary, "the fitted model stays as it is"


def test_models_on_rolling_features_score_as_fitted_and_as_loaded(spark, tmp_path):
    """Features, fit, save, load and scores in one session, as in `rf_score`."""
    events = spark.range(400).selectExpr("id AS k", "id % 20 AS account", "timestamp_seconds(1704844800 + 3600 * id) AS at", "double(id % 10) AS x")
    features = hs.rolling(events, ["account"], "at", [hs.Rolling("most", "sum", "x", timedelta(hours=30))], keep=["k", "x"])
    data = features.withColumn("y", F.col("x") > 4)
    trained = hs.train(data, "y", ["x", "most"], "k")
    hs.save_model(trained.model, hs.RetrievalSpec((hs.FeatureRef("most", "s", "1"),)), spark, str(tmp_path / "m"))
    loaded, _ = hs.load_model(spark, str(tmp_path / "m"))
    by_fitted, by_loaded = [rows(hs.score(m, data, probability="p").select("k", "predict_is_fraud", "p")) for m in (trained.model, loaded)]
    assert by_fitted == by_loaded and len(by_fitted) == 400
    assert [r[:2] for r in by_fitted] == sorted([(i, int(i % 10 > 4)) for i in range(400)], key=repr)
