"""Time-aware feature engineering on Spark DataFrames."""

from hindsight.functions.columns import (
    drop_columns,
    epoch_seconds,
    filter_rows,
    path_columns,
    pick,
    preview,
    sample_by_content,
    sample_by_key,
    sample_rows,
    to_bool,
)
from hindsight.operators.metrics import check_quality, confusion, evaluate, time_coverage
from hindsight.operators.pointintime import FeatureView, point_in_time
from hindsight.operators.rolling import Rolling, RollingTransformer, rolling
from hindsight.operators.skew import SkewPolicy
from hindsight.plans.learn import load_model, save_model, score, split, train
from hindsight.plans.materialize import (
    backfill,
    backfill_whole,
    compute_features,
    materialize_next,
    next_window,
    read_features,
)
from hindsight.plans.retrieval import (
    get_offline_features,
    read_dataset,
    retrieve_for_model,
    write_dataset,
)
from hindsight.sources.recipe import Recipe
from hindsight.sources.scan import scan, scan_dataset
from hindsight.sources.store import OfflineStore
from hindsight.spec.model import (
    Column,
    Entity,
    FeatureRef,
    FeatureSet,
    RetrievalSpec,
    Source,
    load_config,
    load_feature_set,
    save_feature_set,
)
from hindsight.spec.types import spark_type

__all__ = [
    "Column", "Entity", "FeatureRef", "FeatureSet", "FeatureView", "OfflineStore",
    "Recipe", "RetrievalSpec", "Rolling", "RollingTransformer", "SkewPolicy", "Source",
    "backfill", "backfill_whole", "check_quality", "compute_features", "confusion", "drop_columns",
    "epoch_seconds", "evaluate", "filter_rows", "get_offline_features", "load_config",
    "load_feature_set", "load_model", "materialize_next", "next_window", "path_columns",
    "pick", "point_in_time", "preview", "read_dataset", "read_features",
    "retrieve_for_model", "rolling", "sample_by_content", "sample_by_key", "sample_rows", "save_feature_set",
    "save_model", "scan",
    "scan_dataset", "score", "spark_type", "split", "time_coverage", "to_bool", "train",
    "write_dataset",
]
