"""Entities, feature sets and retrieval specs as plain objects, read from plain files."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from pathlib import Path
from typing import Any

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hindsight.sources.files import read_file, replace_file
from hindsight.spec.types import spark_type, type_name

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None

# The look-back where none is declared, the names of a packed retrieval spec and of
# a feature set's own spec.
DEFAULT_LOOKBACK = timedelta(days=365)
SPEC_FILE = "feature_retrieval_spec.yaml"
SET_FILE = "FeatureSetSpec.yaml"


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    @property
    def spark(self) -> T.StructField:
        return T.StructField(self.name, spark_type(self.type))


@dataclass(frozen=True)
class Entity:
    """Named list of index columns by which feature sets are joined."""

    name: str
    version: str
    index_columns: tuple[Column, ...]
    description: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    """Parquet files, with an event-time column or for all times; `rename` maps file to feature-set names."""

    path: str
    timestamp_column: str | None = None
    delay: timedelta = timedelta(0)
    rename: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureSet:
    """Source, optional transformer, index columns and look-backs, named and versioned.

    `transformer` is a pyspark.ml Transformer or a function from DataFrame to DataFrame;
    without one the source columns are the features.  `features` empty: inferred.
    """

    name: str
    version: str
    source: Source
    index_columns: tuple[Column, ...]
    transformer: Transformer | Callable[[DataFrame], DataFrame] | None = None
    features: tuple[Column, ...] = ()
    source_lookback: timedelta = DEFAULT_LOOKBACK
    join_lookback: timedelta = DEFAULT_LOOKBACK
    entities: tuple[str, ...] = ()
    description: str = ""
    stage: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)
    schedule: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        for column in (*self.index_columns, *self.features):
            spark_type(column.type)
        longest = getattr(self.transformer, "longest", None)
        if longest is not None and self.source_lookback < longest:
            raise ValueError(f"{self.name}: source look-back {self.source_lookback} is shorter than the frame {longest}")

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.index_columns]

    @property
    def ts(self) -> str | None:
        """The time column, None if the rows hold at any time."""
        name = self.source.timestamp_column
        return self.source.rename.get(name, name)

    @property
    def _fixed(self) -> list[str]:
        return [*self.keys, *([] if self.ts is None else [self.ts])]

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the transformer (U1) or pass the source columns through."""
        if self.transformer is None:
            return df
        if isinstance(self.transformer, Transformer):
            return self.transformer.transform(df)
        return df.transform(self.transformer)

    def infer(self, schema: T.StructType) -> tuple[Column, ...]:
        """Features of an output schema: every column but keys and time (M5)."""
        return tuple(Column(f.name, type_name(f.dataType)) for f in schema if f.name not in self._fixed)

    def frozen(self, schema: T.StructType) -> FeatureSet:
        """The same feature set with its features fixed to those of an output schema."""
        return replace(self, features=self.infer(schema))

    def conform(self, df: DataFrame) -> DataFrame:
        """Project to keys, time and declared features; raise before any job if the output
        lacks one or has another type (M6)."""
        declared = self.features or self.infer(df.schema)
        problems = []
        for name in self._fixed:
            if name not in df.columns:
                problems.append(f"missing column {name!r}")
        types = {f.name: f.dataType for f in df.schema}
        for column in (*self.index_columns, *declared):
            if column.name not in types:
                problems.append(f"missing column {column.name!r}")
            elif type_name(types[column.name]) != column.type.lower():
                problems.append(f"{column.name!r} is {types[column.name].simpleString()}, declared {column.type}")
        if self.ts in types and not isinstance(types[self.ts], (T.TimestampType, T.TimestampNTZType)):
            problems.append(f"time column {self.ts!r} is {types[self.ts].simpleString()}")
        if problems:
            raise ValueError(f"feature set {self.name}:{self.version}: " + "; ".join(dict.fromkeys(problems)))
        return df.select(*self._fixed, *[c.name for c in declared])

    def feature(self, name: str) -> FeatureRef:
        """Refer to one feature (P13); unknown names raise when the features are declared."""
        if self.features and name not in [c.name for c in self.features]:
            raise ValueError(f"feature set {self.name}:{self.version} has no feature {name!r}")
        return FeatureRef(name, self.name, self.version)


@dataclass(frozen=True)
class FeatureRef:
    feature: str
    feature_set: str
    version: str


@dataclass(frozen=True)
class RetrievalSpec:
    """Portable list of features of a model."""

    features: tuple[FeatureRef, ...]

    def text(self) -> str:
        entries = [{"feature_name": f.feature, "feature_set": f"{f.feature_set}:{f.version}"} for f in self.features]
        return dump_text({"feature_stores": [{"features": entries}], "serialization_version": 2})

    @classmethod
    def parse(cls, text: str) -> RetrievalSpec:
        refs = []
        for store in parse_text(text)["feature_stores"]:
            for entry in store["features"]:
                name, _, version = entry["feature_set"].rpartition(":")
                refs.append(FeatureRef(entry["feature_name"], name, version))
        return cls(tuple(refs))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RetrievalSpec:
        """Read the spec file lying in a dataset or model folder."""
        return cls.parse(read_file(spark, f"{folder}/{SPEC_FILE}"))

    def save(self, spark: SparkSession, folder: str) -> None:
        replace_file(spark, f"{folder}/{SPEC_FILE}", self.text())


def parse_text(text: str) -> dict:
    if yaml is not None:
        return yaml.safe_load(text)
    return json.loads(text)


def dump_text(value: dict) -> str:
    """JSON is YAML too, so files can be read with and without a YAML library."""
    return json.dumps(value, indent=2)


def offset(value: Mapping[str, int] | None, default: timedelta) -> timedelta:
    """A duration given as days, hours and minutes."""
    if not value:
        return default
    return timedelta(**{unit: int(value.get(unit, 0)) for unit in ("days", "hours", "minutes")})


def _columns(values: Sequence[Mapping[str, str]]) -> tuple[Column, ...]:
    return tuple(Column(v["name"], v["type"]) for v in values)


def load_transformer(folder: str | Path, name: str) -> Transformer:
    """An instance of `module.Class` from a folder of Python files."""
    module_name, _, class_name = name.rpartition(".")
    spec = importlib.util.spec_from_file_location(module_name, Path(folder) / f"{module_name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, class_name)()


def load_config(path: str | Path, transformers: Mapping[str, Any] | None = None) -> tuple[list[Entity], list[FeatureSet]]:
    """Entities and feature sets of a store configuration file.

    `transformers` maps transformer class names to instances or functions; other names
    are loaded from the configured code folder.  A feature set must have the index columns
    of its entities, as far as they are in the file.
    """
    config = parse_text(Path(path).read_text())
    entities = [
        Entity(e["name"], str(e["version"]), _columns(e["index_columns"]), e.get("description", ""), e.get("tags", {}))
        for e in config.get("entities", [])
    ]
    feature_sets = [_from_config(c, transformers or {}) for c in config.get("feature_sets", [])]
    known = {(e.name, e.version): e for e in entities}
    for fs in feature_sets:
        for reference in fs.entities:
            entity = known.get(tuple(reference.split(":")[-2:]))
            declared = {(c.name, c.spark.dataType) for c in fs.index_columns}
            if entity and not {(c.name, c.spark.dataType) for c in entity.index_columns} <= declared:
                raise ValueError(f"feature set {fs.name} lacks index columns of its entity {reference}")
    return entities, feature_sets


def _from_config(c: Mapping[str, Any], transformers: Mapping[str, Any]) -> FeatureSet:
    transformer = None
    if name := c.get("transformer_class_name"):
        transformer = transformers.get(name) or load_transformer(c["transformation_code_path"], name)
    return FeatureSet(
        name=c["name"],
        version=str(c["version"]),
        source=Source(
            c["data_source_path"], c.get("timestamp_column_name"), offset(c.get("source_delay"), timedelta(0))
        ),
        index_columns=_columns(c["index_columns"]),
        transformer=transformer,
        source_lookback=offset(c.get("source_lookback"), DEFAULT_LOOKBACK),
        join_lookback=offset(c.get("temporal_join_lookback"), DEFAULT_LOOKBACK),
        entities=tuple(c.get("entities", ())),
        description=c.get("description", ""),
        stage=c.get("stage", ""),
        tags=c.get("tags", {}),
        schedule=(c.get("offline") or {}).get("schedule") or {},
    )


def _parts_of(value: timedelta) -> dict[str, int]:
    """A duration as days, hours and minutes; it must be whole minutes."""
    minutes, rest = divmod(value, timedelta(minutes=1))
    if rest:
        raise ValueError(f"a spec file has durations in whole minutes, not {value}")
    return {"days": minutes // 1440, "hours": minutes // 60 % 24, "minutes": minutes % 60}


def save_feature_set(spark: SparkSession, fs: FeatureSet, folder: str, code: str = "./code") -> str:
    """Write the spec file of a feature set, from which `load_feature_set` makes it again; its path.

    The features must be declared (`FeatureSet.frozen`).  Name and version are not part of the
    file.  A transformer is named by its class; its code is expected in the folder `code`.
    """
    if not fs.features:
        raise ValueError(f"{fs.name}: the features are not declared")
    if fs.source.rename:
        raise ValueError(f"{fs.name}: a spec file has no place for renamed columns")
    source: dict[str, Any] = {"path": fs.source.path, "source_delay": _parts_of(fs.source.delay), "type": "parquet"}
    if fs.source.timestamp_column is not None:
        source["timestamp_column"] = {"name": fs.source.timestamp_column}
    content: dict[str, Any] = {
        "features": [{"name": c.name, "type": c.type} for c in fs.features],
        "index_columns": [{"name": c.name, "type": c.type} for c in fs.index_columns],
        "source": source,
        "source_lookback": _parts_of(fs.source_lookback),
        "temporal_join_lookback": _parts_of(fs.join_lookback),
    }
    if fs.transformer is not None:
        kind = type(fs.transformer) if isinstance(fs.transformer, Transformer) else fs.transformer
        content["feature_transformation_code"] = {"path": code, "transformer_class": f"{kind.__module__}.{kind.__name__}"}
    path = f"{folder}/{SET_FILE}"
    replace_file(spark, path, dump_text(content))
    return path


def load_feature_set(
    path: str | Path, name: str, version: str, transformers: Mapping[str, Any] | None = None
) -> FeatureSet:
    """A feature set from an exported spec file; its code folder lies beside the file."""
    c = parse_text(Path(path).read_text())
    transformer = None
    if code := c.get("feature_transformation_code"):
        class_name = code["transformer_class"]
        transformer = (transformers or {}).get(class_name) or load_transformer(
            Path(path).parent / code["path"], class_name
        )
    source = c["source"]
    return FeatureSet(
        name=name,
        version=str(version),
        source=Source(
            source["path"],
            (source.get("timestamp_column") or {}).get("name"),
            offset(source.get("source_delay"), timedelta(0)),
        ),
        index_columns=_columns(c["index_columns"]),
        transformer=transformer,
        features=_columns(c.get("features", [])),
        source_lookback=offset(c.get("source_lookback"), DEFAULT_LOOKBACK),
        join_lookback=offset(c.get("temporal_join_lookback"), DEFAULT_LOOKBACK),
    )
