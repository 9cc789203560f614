from datetime import datetime

import pytest
from helpers import at, rows, table
from pyspark.sql import functions as F

import hindsight as hs
from hindsight.functions.columns import fill_missing, utc_time


def test_to_bool(spark):
    df = spark.sql("SELECT explode(array('yes', 'Y', 'no', 'other', NULL)) AS v")
    loose = df.select("v", hs.to_bool("v", ["yes", "Y"], ["no", "N"]).alias("b"))
    assert {r.v: r.b for r in loose.collect()} == {"yes": True, "Y": True, "no": False, "other": None, None: None}
    strict = df.select(hs.to_bool("v", ["yes", "Y"], ["no", "N"], strict=True).alias("b"))
    with pytest.raises(Exception, match="neither list: other"):
        strict.collect()
    assert strict.sparkSession.range(2).select(
        hs.to_bool(F.col("id"), ["1"], ["0"], strict=True).alias("b")
    ).collect() == [(False,), (True,)]


def test_columns_from_paths(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(4).selectExpr("id", "2020 + id % 2 AS era", "id AS slot").write.partitionBy("era", "slot").parquet(root)
    files = hs.scan(spark, f"{root}/*/*/*.parquet")
    found = hs.path_columns(files, "/era={year}/slot={month}")
    assert rows(found.select("id", "year", "month")) == [(i, str(2020 + i % 2), str(i)) for i in range(4)]
    assert hs.path_columns(files, "/nothing={x}").select("x").distinct().collect() == [(None,)]


def test_path_column(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d" / "data"))
    assert hs.scan(spark, f"{tmp_path}/d/data", path_column="Path").where("Path LIKE '%/d/data/%.parquet'").count() == 3
    assert hs.scan_dataset(spark, f"{tmp_path}/d").count() == 3


def test_recipe_round_trip(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 7 AS d", "IF(id % 2 = 0, '1', '0') AS flag", "2024 AS era").write.partitionBy(
        "era"
    ).parquet(root)
    recipe = (
        hs.Recipe((f"{root}/*/*.parquet",), path_column="Path")
        .then("filter", "col('d') > 3")
        .then("drop_columns", ["d"])
        .then("convert_column_types", {"flag": {"true_values": ["1"], "false_values": ["0"]}})
        .then("extract_columns_from_partition_format", "/era={year}/")
        .then("take_random_sample", {"probability": 0.9, "seed": 4242})
    )
    recipe.save(spark, str(tmp_path / "r"))
    again = hs.Recipe.open(spark, str(tmp_path / "r"))
    assert again == recipe
    loaded = again.load(spark)
    assert loaded.columns == ["id", "flag", "Path", "year"]
    got = rows(loaded.select("id", "flag", "year"))
    assert got and set(got) <= {(i, i % 2 == 0, "2024") for i in range(100) if i % 7 > 3}
    assert rows(recipe.load(spark)) == rows(loaded)
    with pytest.raises(ValueError, match="unknown step"):
        recipe.then("explode", "x")


def test_path_columns_after_a_projection(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(6).selectExpr("id", "id * 2 AS v", "id % 2 AS era").write.partitionBy("era").parquet(root)
    recipe = hs.Recipe((f"{root}/*/*.parquet",)).then("keep_columns", ["id"]).then("extract_columns_from_partition_format", "/era={e}/")
    assert rows(recipe.load(spark)) == [(i, str(i % 2)) for i in range(6)]


def test_small_probabilities_of_keys(spark):
    n = hs.sample_by_key(spark.range(2_000_000), "id", 0.00004).count()
    assert 30 < n < 140 and hs.sample_by_key(spark.range(1000), "id", 1.0).count() == 1000


def test_epoch_seconds_are_floored(spark):
    df = table(spark, "t timestamp", [(datetime(1970, 1, 1, 0, 0, 1, 900_000),), (datetime(1969, 12, 31, 23, 59, 59, 900_000),)])
    assert sorted(r[0] for r in df.select(hs.epoch_seconds("t")).collect()) == [-1, 1]


def test_times():
    assert utc_time("2021-11-02 03:30:05") == datetime(2021, 11, 2, 3, 30, 5)
    assert utc_time("2021-11-02T05:30:05+02:00") == datetime(2021, 11, 2, 3, 30, 5)
    with pytest.raises(ValueError):
        utc_time("tomorrow")


def test_missing_values(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS a, CAST(NULL AS INT) AS b, CAST(NULL AS BOOLEAN) AS c, true AS d, 'x' AS s")
    assert rows(fill_missing(df, ["a", "b", "c", "d"])) == [(0.0, 0, 0, 1, "x")]
    with pytest.raises(ValueError, match="not numeric"):
        fill_missing(df, ["s"])


def test_projection_and_samples(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    with pytest.raises(ValueError, match="unknown columns"):
        hs.pick(df, "id", "w")
    with pytest.raises(ValueError, match="unknown columns"):
        hs.drop_columns(df, ["w"])
    assert hs.drop_columns(df, ["v"]).columns == ["id"]
    by_key = hs.sample_by_key(df, "id", 0.2)
    assert rows(by_key) == rows(hs.sample_by_key(df.repartition(7), "id", 0.2))
    assert 120 < by_key.count() < 280
    assert rows(hs.sample_rows(df, 0.1, 4242)) == rows(hs.sample_rows(df, 0.1, 4242))
    assert rows(hs.preview(df, 2, ["id"])) == [(0, 0), (1, 2)]
    assert hs.filter_rows(df, "col('v') > 10 and col(\"id\") < 8").count() == 2


def test_time_coverage(spark):
    df = table(spark, "t timestamp", [(at(),), (None,), (at(days=2),)])
    assert rows(hs.time_coverage(df, "t")) == [(at(), at(days=2))]


def test_sample_by_content_depends_on_the_rows_alone(spark, monkeypatch):
    from hindsight.functions import columns

    monkeypatch.setattr(columns, "COPIES", 16)
    data = [("a", None, 1.5)] * 400 + [("a", "", 1.5)] * 100 + [(f"k{i}", "x", float(i)) for i in range(500)] + [(None, None, None)] * 30
    whole = spark.createDataFrame(data, "a string, b string, c double")
    found = sorted(map(tuple, hs.sample_by_content(whole.repartition(1), 0.3, 7).collect()), key=repr)
    assert found == sorted(map(tuple, hs.sample_by_content(whole.repartition(9, "c"), 0.3, 7).collect()), key=repr)
    assert found != sorted(map(tuple, hs.sample_by_content(whole, 0.3, 8).collect()), key=repr)
    assert 250 < len(found) < 370 and 80 < found.count(("a", None, 1.5)) < 160
    assert hs.sample_by_content(whole, 1.0, 7).count() == len(data) and hs.sample_by_content(whole, 0.0, 7).count() == 0
