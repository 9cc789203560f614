import json
from datetime import timedelta

import pytest
from pyspark.ml import Transformer
from pyspark.sql import types as T

import hindsight as hs
from hindsight.spec.types import type_name

CONFIG = {
    "entities": [
        {"name": "station", "version": "7", "index_columns": [{"name": "stationID", "type": "STRING"}], "tags": {"a": "b"}}
    ],
    "feature_sets": [
        {
            "name": "readings", "version": "7", "entities": ["station:7"],
            "data_source_path": "/lake/readings/*.parquet", "timestamp_column_name": "timestamp",
            "source_delay": {"days": 1, "hours": 2, "minutes": 5},
            "transformer_class_name": "doubles.Doubles",
            "index_columns": [{"name": "stationID", "type": "STRING"}],
            "source_lookback": {"days": 11, "hours": 0, "minutes": 0},
            "temporal_join_lookback": {"days": 4, "hours": 18, "minutes": 0},
            "offline": {"active": True, "schedule": {"interval": 2, "frequency": "Day", "start_time": "2021-11-02 03:30:00"}},
        },
        {
            "name": "stations", "version": "7", "data_source_path": "/lake/stations", "timestamp_column_name": "timestamp",
            "index_columns": [{"name": "stationID", "type": "string"}],
        },
    ],
}
CODE = """
from pyspark.ml import Transformer

class Doubles(Transformer):
    def _transform(self, df):
        return df.selectExpr("stationID", "timestamp", "level * 2 AS twice")
"""
SPEC = """
feature_transformation_code:
  path: ./code
  transformer_class: doubles.Doubles
features:
- name: twice
  type: double
index_columns:
- name: stationID
  type: string
source:
  path: /lake/readings/*.parquet
  source_delay: {days: 0, hours: 6, minutes: 45}
  timestamp_column:
    name: timestamp
  type: parquet
source_lookback: {days: 21, hours: 0, minutes: 0}
temporal_join_lookback: {days: 21, hours: 0, minutes: 0}
"""


def test_config(tmp_path, spark):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG))
    entities, (readings, stations) = hs.load_config(path, {"doubles.Doubles": lambda df: df})
    assert entities[0].index_columns[0].spark == T.StructField("stationID", T.StringType())
    assert readings.source.delay == timedelta(days=1, hours=2, minutes=5)
    assert readings.source_lookback == timedelta(days=11)
    assert readings.join_lookback == timedelta(days=4, hours=18)
    assert readings.schedule["interval"] == 2
    assert stations.transformer is None
    assert (stations.source.delay, stations.source_lookback, stations.join_lookback) == (
        timedelta(0), timedelta(days=365), timedelta(days=365),
    )


def test_feature_sets_have_the_keys_of_their_entities(tmp_path):
    wrong = json.loads(json.dumps(CONFIG))
    wrong["feature_sets"][0]["index_columns"][0]["type"] = "LONG"
    (tmp_path / "config.json").write_text(json.dumps(wrong))
    with pytest.raises(ValueError, match="lacks index columns"):
        hs.load_config(tmp_path / "config.json", {"doubles.Doubles": lambda df: df})


def test_feature_set_file_with_its_code(tmp_path, spark):
    pytest.importorskip("yaml")
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "doubles.py").write_text(CODE)
    (tmp_path / "spec.yaml").write_text(SPEC)
    fs = hs.load_feature_set(tmp_path / "spec.yaml", "readings", "3")
    assert isinstance(fs.transformer, Transformer)
    df = spark.sql("SELECT 'a' AS stationID, TIMESTAMP '2024-01-01' AS timestamp, 5.0D AS level")
    assert fs.conform(fs.transform(df)).select("twice").first().twice == 10.0
    assert fs.feature("twice") == hs.FeatureRef("twice", "readings", "3")
    with pytest.raises(ValueError, match="no feature"):
        fs.feature("third")


def test_type_names():
    assert hs.spark_type("STRING") == hs.spark_type("string") == T.StringType()
    assert [hs.spark_type(n) for n in ("Integer", "BOOLEAN", "datetime", "double", "FLOAT", "long", "binary")] == [
        T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType(), T.FloatType(), T.LongType(), T.BinaryType(),
    ]
    with pytest.raises(ValueError, match="decimal"):
        hs.spark_type("decimal")
    with pytest.raises(ValueError):
        type_name(T.ArrayType(T.LongType()))
    assert type_name(T.TimestampNTZType()) == "datetime"


def test_retrieval_spec_survives_a_round_trip(spark, tmp_path):
    spec = hs.RetrievalSpec((hs.FeatureRef("a", "stations", "4"), hs.FeatureRef("b", "set:of", "1")))
    spec.save(spark, str(tmp_path / "model"))
    assert hs.RetrievalSpec.load(spark, str(tmp_path / "model")) == spec


def test_retrieval_spec_from_a_plain_yaml_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "feature_retrieval_spec.yaml").write_text(
        "feature_stores:\n- features:\n  - feature_name: altitude\n    feature_set: stations:9\n  location: here\nserialization_version: 2\n"
    )
    assert hs.RetrievalSpec.load(spark, str(tmp_path)).features == (hs.FeatureRef("altitude", "stations", "9"),)


def test_a_saved_feature_set_is_read_again(spark, tmp_path):
    from hindsight.spec.model import Column

    def twice(df):
        return df

    fs = hs.FeatureSet(
        "readings", "2", hs.Source("/lake/*.parquet", "timestamp", timedelta(hours=30, minutes=5)), (Column("k", "string"), Column("n", "long")),
        twice, (Column("a", "double"), Column("b", "datetime")), timedelta(days=21), timedelta(days=3, hours=2),
    )
    path = hs.save_feature_set(spark, fs, str(tmp_path / "spec"))
    assert hs.load_feature_set(path, "readings", "2", {f"{twice.__module__}.twice": twice}) == fs
    timeless = hs.FeatureSet("s", "1", hs.Source("/lake/s"), (Column("k", "string"),), features=(Column("a", "double"),))
    path = hs.save_feature_set(spark, timeless, str(tmp_path / "spec"))  # replaces the file
    assert hs.load_feature_set(path, "s", "1") == timeless
    with pytest.raises(ValueError, match="not declared"):
        hs.save_feature_set(spark, hs.FeatureSet("s", "1", hs.Source("/x"), ()), str(tmp_path))
    with pytest.raises(ValueError, match="whole minutes"):
        hs.save_feature_set(spark, hs.FeatureSet("s", "1", hs.Source("/x", "t", timedelta(seconds=1)), (), features=fs.features), str(tmp_path))
    with pytest.raises(ValueError, match="renamed"):
        hs.save_feature_set(spark, hs.FeatureSet("s", "1", hs.Source("/x", rename={"a": "b"}), (), features=fs.features), str(tmp_path))


def test_specs_and_recipes_are_single_files(spark, tmp_path):
    hs.RetrievalSpec((hs.FeatureRef("a", "s", "1"),)).save(spark, str(tmp_path))
    hs.Recipe(("/lake",)).then("drop_columns", ["x"]).save(spark, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir() if p.is_file()} == {"feature_retrieval_spec.yaml", "MLTable"}
    assert hs.Recipe.open(spark, str(tmp_path)).steps == (("drop_columns", ["x"]),)
