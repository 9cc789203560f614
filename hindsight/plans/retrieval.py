"""Training and scoring datasets: features of several sets on an observation table
(J4, J7, S2, S8)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from hindsight.operators.pointintime import FeatureView, observed_entities, point_in_time, profile_spine
from hindsight.operators.skew import SkewPolicy
from hindsight.plans.materialize import outline, read_features
from hindsight.sources.scan import scan_dataset, write_table
from hindsight.sources.store import OfflineStore, from_micros
from hindsight.spec.model import FeatureRef, FeatureSet, RetrievalSpec


def get_offline_features(
    spark: SparkSession,
    features: Sequence[FeatureRef],
    feature_sets: Iterable[FeatureSet],
    observations: DataFrame,
    timestamp_column: str,
    store: OfflineStore | None = None,
    policy: SkewPolicy | None = SkewPolicy(),
    shift_by_delay: bool = True,
    prefixes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Observations with the requested features, in the requested order, point-in-time.

    Look-back and delay come from each feature set.  Only feature rows that some
    observation can still see are read, from the store where they are materialised.
    `prefixes` maps feature-set names to a prefix for their output columns.
    """
    prefixes = prefixes or {}
    known = {(s.name, s.version): s for s in feature_sets}
    wanted: dict[tuple[str, str], list[str]] = {}
    for ref in features:
        if (ref.feature_set, ref.version) not in known:
            raise ValueError(f"unknown feature set {ref.feature_set}:{ref.version}")
        wanted.setdefault((ref.feature_set, ref.version), []).append(ref.feature)

    # without a policy no job runs while this is planned, and all feature rows are read
    profile = profile_spine(observations, timestamp_column, [tuple(known[key].keys) for key in wanted]) if policy else None
    views = []
    for key, names in wanted.items():
        fs = known[key]
        start = end = None
        if fs.ts is not None and profile is not None and profile.first is not None:
            delay = fs.source.delay if shift_by_delay else timedelta(0)
            start = (from_micros(profile.first) - fs.join_lookback - delay).replace(microsecond=0)
            end = (from_micros(profile.last) - delay).replace(microsecond=0) + timedelta(seconds=1)
        entities = None
        if policy:
            entities = observed_entities(observations, timestamp_column, fs.keys, profile, policy)
        rows = read_features(spark, fs, store, start, end, entities)
        views.append(FeatureView(
            rows, fs.keys, fs.ts, names, fs.join_lookback, fs.source.delay, prefixes.get(fs.name, ""), fs.name,
            outline(spark, fs, store, start, end, entities) if policy else None,
        ))
    joined = point_in_time(observations, timestamp_column, views, policy, shift_by_delay, profile)
    return joined.select(*observations.columns, *[prefixes.get(r.feature_set, "") + r.feature for r in features])


def write_dataset(df: DataFrame, spec: RetrievalSpec, folder: str) -> None:
    """Write retrieved rows into `data/` with the retrieval spec beside them."""
    write_table(df, f"{folder}/data")
    spec.save(df.sparkSession, folder)


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, RetrievalSpec]:
    return scan_dataset(spark, folder), RetrievalSpec.load(spark, folder)


def retrieve_for_model(
    spark: SparkSession,
    model_folder: str,
    feature_sets: Iterable[FeatureSet],
    observations: DataFrame,
    timestamp_column: str,
    **options,
) -> DataFrame:
    """Features for scoring: the list comes from the spec packed with the model."""
    spec = RetrievalSpec.load(spark, model_folder)
    return get_offline_features(spark, spec.features, feature_sets, observations, timestamp_column, **options)
