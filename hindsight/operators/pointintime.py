"""Point-in-time join: each observation gets, per feature set, the latest feature row of
its entity that was visible at the observation's own time (J1-J6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindsight.functions.columns import require_columns
from hindsight.session import require_utc
from hindsight.operators.skew import SkewPolicy, key_hash

ROW_BYTES = 16
#: Ranges for each shuffle partition, so that those that meet in one task add up evenly; sampled
#: rows for each range; ranges at most, which bounds what the driver gets to a million rows.
RANGES_PER_TASK = 16
RANGE_ROWS = 16
MOST_RANGES = 1 << 16


@dataclass(frozen=True)
class FeatureView:
    """The rows of one feature set, ready to be joined.

    Without a time column (`ts` None) rows hold at any time; of several rows of an entity the
    greatest by its feature values, in the order of the view, wins as a whole.
    With one, a row is visible from `ts + delay` on, and counts as missing once it is older than
    `lookback` (None: never).  `prefix` is put before the feature names in the output.
    `outline` may hold keys and time of about the same rows where that is cheaper than
    `df`, such as the source of computed features; only the profile reads it.
    """

    df: DataFrame = field(repr=False)
    keys: Sequence[str]
    ts: str | None
    features: Sequence[str]
    lookback: timedelta | None = None
    delay: timedelta = timedelta(0)
    prefix: str = ""
    name: str = ""
    outline: DataFrame | None = field(default=None, repr=False)

    @property
    def outputs(self) -> list[str]:
        return [self.prefix + f for f in self.features]


def point_in_time(
    spine: DataFrame,
    ts: str,
    views: Sequence[FeatureView],
    policy: SkewPolicy | None = SkewPolicy(),
    shift_by_delay: bool = True,
    profile: SpineProfile | None = None,
) -> DataFrame:
    """The spine's rows and columns, then the features of every view in order.

    Each observation is kept once; without a visible feature row, with a NULL key or with
    a NULL time its features are NULL.  Views on the same key columns share one shuffle
    and one window; `policy=None` skips the jobs that look at the spine and for hot
    entities.  `profile`: that of the spine, if the views were narrowed to its entities.
    """
    if not views:
        raise ValueError("no feature views given")
    require_utc(spine.sparkSession)
    _check(spine, ts, views)
    groups: dict[tuple[str, ...], list[FeatureView]] = {}
    for view in views:
        if view.ts is not None:
            groups.setdefault(tuple(view.keys), []).append(view)
    narrow = policy is not None and profile is None
    if narrow and groups:
        profile = profile_spine(spine, ts, list(groups))
    joined = spine
    for keys, members in groups.items():
        wanted = observed_entities(spine, ts, keys, profile, policy) if narrow else None
        joined = _join_group(joined, ts, list(keys), members, policy, shift_by_delay, wanted)
    for view in views:
        if view.ts is None:
            joined = _join_timeless(joined, view)
    return joined.select(*spine.columns, *[o for v in views for o in v.outputs])


def _check(spine: DataFrame, ts: str, views: Sequence[FeatureView]) -> None:
    require_columns(spine, [ts])
    taken = set(spine.columns)
    for view in views:
        require_columns(view.df, [*view.keys, *([] if view.ts is None else [view.ts]), *view.features])
        require_columns(spine, view.keys)
        for key in view.keys:
            ours, theirs = spine.schema[key].dataType, view.df.schema[key].dataType
            if ours != theirs:
                raise ValueError(f"key {key!r} is {ours.simpleString()} in the spine, {theirs.simpleString()} in {view.name!r}")
        for name in view.outputs:
            if name in taken:
                raise ValueError(f"column {name!r} would occur twice; give the view a prefix")
            taken.add(name)


def _join_timeless(spine: DataFrame, view: FeatureView) -> DataFrame:
    """Join by the keys alone; a row per entity at most, so that no observation is multiplied.

    Rows are reduced to the winner on the map side.  Observations with a NULL key match nothing.
    """
    shown = F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(view.features)])
    names = [f"__k{i}" for i in range(len(view.keys))]
    given = view.df.where(_complete(None, view.keys)).groupBy(*[F.col(k).alias(n) for k, n in zip(view.keys, names)])
    best = given.agg(F.max(shown).alias("__shown"))
    same = F.lit(True)
    for k, n in zip(view.keys, names):
        same = same & (F.col(k) == F.col(n))
    outputs = [F.col(f"__shown.v{i}").alias(o) for i, o in enumerate(view.outputs)]
    return spine.join(best, same, "left").select(*spine.columns, *outputs)


def _complete(ts: str | None, keys: Sequence[str]) -> Column:
    condition = F.lit(True) if ts is None else F.col(ts).isNotNull()
    for k in keys:
        condition = condition & F.col(k).isNotNull()
    return condition


@dataclass(frozen=True)
class SpineProfile:
    """What one pass over the observations tells: first and last time in microseconds, and
    per tuple of key columns the rows that cannot match and a bound on the size of the
    distinct keys, up to the few percent of the distinct count's own error."""

    first: int | None
    last: int | None
    unmatchable: dict[tuple[str, ...], int]
    key_bytes: dict[tuple[str, ...], int]


def profile_spine(spine: DataFrame, ts: str, groups: Sequence[tuple[str, ...]]) -> SpineProfile:
    time = F.unix_micros(F.col(ts).cast("timestamp"))

    def longest(key: str) -> Column:
        measured = isinstance(spine.schema[key].dataType, (T.StringType, T.BinaryType))
        return F.coalesce(F.max(F.octet_length(key)), F.lit(0)) if measured else F.lit(8)

    row = spine.agg(
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        *[F.count_if(~_complete(ts, keys)).alias(f"n{i}") for i, keys in enumerate(groups)],
        *[
            (F.approx_count_distinct(key_hash(keys)) * sum((longest(k) for k in keys), F.lit(ROW_BYTES))).alias(f"b{i}")
            for i, keys in enumerate(groups)
        ],
    ).first()
    return SpineProfile(
        row["first"], row["last"],
        {keys: row[f"n{i}"] for i, keys in enumerate(groups)},
        {keys: row[f"b{i}"] for i, keys in enumerate(groups)},
    )


def observed_entities(
    spine: DataFrame, ts: str, keys: Sequence[str], profile: SpineProfile, policy: SkewPolicy
) -> DataFrame | None:
    """The spine's keys to be broadcast, or None if they are too large for that."""
    if profile.key_bytes[tuple(keys)] > policy.broadcast_bytes:
        return None
    return F.broadcast(spine.where(_complete(ts, keys)).select(*keys).distinct())


def _join_group(spine, ts, keys, views, policy, shift_by_delay, wanted) -> DataFrame:
    """All views with the same keys: one union, one running window, one shuffle.

    The observation travels as a struct, so nothing is joined back and duplicates stay.
    Observations that cannot match skip the shuffle altogether.
    `wanted` holds the keys of the spine, if they are few: other feature rows are left out
    before the shuffle.
    """
    complete = _complete(ts, keys)
    names = [f"_k{i}" for i in range(len(keys))]
    sets = [f"_f{i}" for i in range(len(views))]

    def placed(df: DataFrame, time: Column, side: int, **carried: Column) -> DataFrame:
        return df.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names)],
            time.alias("_t"),
            F.lit(side).alias("_side"),
            *[value.alias(column) for column, value in carried.items()],
        )

    obs = placed(
        spine.where(complete), F.col(ts).cast("timestamp"), 1, _obs=F.struct(*[F.col(c) for c in spine.columns])
    )
    features = outline = None
    for view, column in zip(views, sets):
        visible = F.col(view.ts).cast("timestamp")
        if shift_by_delay and view.delay:
            visible = visible + F.lit(view.delay)
        shown = F.struct(visible.alias("at"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(view.features)])
        rows, lines = view.df, view.df if view.outline is None else view.outline
        if wanted is not None:
            rows, lines = (df.join(wanted, keys, "left_semi") for df in (rows, lines))
        rows, lines = (df.where(_complete(view.ts, keys)) for df in (rows, lines))
        rows, lines = placed(rows, visible, 0, **{column: shown}), placed(lines, visible, 0)
        features = rows if features is None else features.unionByName(rows, allowMissingColumns=True)
        outline = lines if outline is None else outline.unionByName(lines)

    routed = _route(obs, features, outline, names, sets, policy) if policy else None
    if routed is None:
        matched = _last_visible(obs.unionByName(features, allowMissingColumns=True), names, sets)
        matched = matched.select("_obs", *sets)
    else:
        matched = routed

    def feature(view: FeatureView, column: str, i: int, output: str) -> Column:
        value = F.col(f"{column}.v{i}")
        if view.lookback is not None:
            value = F.when(F.col(f"_obs.`{ts}`").cast("timestamp") <= F.col(f"{column}.at") + F.lit(view.lookback), value)
        return value.alias(output)

    outputs = [(v, c, i, o) for v, c in zip(views, sets) for i, o in enumerate(v.outputs)]
    result = matched.select(*[F.col(f"_obs.`{c}`").alias(c) for c in spine.columns], *[feature(*o) for o in outputs])
    types = {f.name: f.dataType for f in result.schema}
    unmatchable = spine.where(~complete).select(
        *spine.columns, *[F.lit(None).cast(types[o]).alias(o) for _, _, _, o in outputs]
    )
    return result.unionByName(unmatchable)


def _last_visible(rows: DataFrame, group: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """Observations with the last row of every set at or before them.

    Features sort before observations of the same time; among features of the same time
    the one with the greatest feature values, in the order of the view, comes last and
    wins as a whole.
    """
    running = (
        Window.partitionBy(*group)
        .orderBy("_t", "_side", *sets)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    others = [c for c in rows.columns if c not in sets]
    return rows.select(*others, *[F.last(s, ignorenulls=True).over(running).alias(s) for s in sets]).where("_side = 1")


def _route(obs, features, outline, names, sets, policy: SkewPolicy) -> DataFrame | None:
    """The join with crowded entities cut into ranges of time, or None if there are none.

    The cuts are those of a range partitioning of all rows by entity and time (`_cuts`).  A
    range begins with one carried row: the last row of each set in the entity's earlier ranges,
    by a running maximum over one row per range.  At an instant with rows enough for several
    ranges, feature rows are reduced to the one that wins, and observations stay where they
    are: one stand-in is joined for all of them, and its answer broadcast.
    """
    place = {"_h": key_hash(names), "_u": F.unix_micros("_t")}
    obs, features, outline = (df.withColumns(place) for df in (obs, features, outline))
    every = obs.select("_h", "_u", "_side").unionByName(outline.select("_h", "_u", "_side"))
    cuts, crowded = _cuts(every, policy)
    if not cuts:
        return None
    spark = obs.sparkSession

    def listed(side: int) -> DataFrame:
        at = [(h, u) for h, u, s in crowded if s == side]
        return F.broadcast(_small(spark, {"_h": [h for h, _ in at], "_u": [u for _, u in at]}))

    held = None
    if any(side == 0 for _, _, side in crowded):
        # Rows of one set at one instant: only the greatest can win.
        many = features.join(listed(0), ["_h", "_u"], "left_semi")
        best = many.groupBy("_h", "_u", *names, "_t", "_side").agg(*[F.max(s).alias(s) for s in sets])
        features = features.join(listed(0), ["_h", "_u"], "left_anti").unionByName(best)
    if any(side == 1 for _, _, side in crowded):
        held = obs.join(listed(1), ["_h", "_u"], "left_semi")
        stand_in = held.select(*names, "_t", "_side", "_h", "_u").distinct()
        obs = obs.join(listed(1), ["_h", "_u"], "left_anti").unionByName(stand_in, allowMissingColumns=True)

    # One pass for all entities; those that are not cut lie in a single range.
    bounds = F.broadcast(_small(spark, {"_h": list(cuts), "_cuts": list(cuts.values())}))

    def ranged(df: DataFrame) -> DataFrame:
        at = F.col("_u") * 2 + F.col("_side")
        return df.join(bounds, "_h", "left").withColumn("_range", _count_up_to("_cuts", at)).withColumn("_is_cut", F.col("_cuts").isNotNull()).drop("_cuts")

    obs, features = ranged(obs), ranged(features)
    group = [*names, "_range"]
    tops = features.where("_is_cut").groupBy(*group).agg(*[F.max(s).alias(s) for s in sets])
    wanted = obs.where("_is_cut").select(*group).distinct()
    earlier = Window.partitionBy(*names).orderBy("_range", "_want").rowsBetween(Window.unboundedPreceding, -1)
    # In a range the question sorts before the range's own last row, so it sees earlier ones only.
    carried = (
        tops.withColumn("_want", F.lit(1))
        .unionByName(wanted.withColumn("_want", F.lit(0)), allowMissingColumns=True)
        .select(*group, "_want", *[F.last(s, ignorenulls=True).over(earlier).alias(s) for s in sets])
        .where("_want = 0")
        # no time sorts before every time
        .select(*group, F.lit(None).cast("timestamp").alias("_t"), F.lit(-1).alias("_side"), *sets)
    )
    rows = obs.unionByName(features, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    found = _last_visible(rows, group, sets)
    if held is None:
        return found.select("_obs", *sets)
    answers = found.where("_obs IS NULL").select(
        *[F.col(n).alias(f"_a{n}") for n in names], F.col("_t").alias("_a_t"), *sets
    )
    same = F.col("_t") == F.col("_a_t")
    for n in names:
        same = same & (F.col(n) == F.col(f"_a{n}"))
    # One answer per crowded instant, of which there are fewer than ranges.
    given = held.join(F.broadcast(answers), same, "left").select("_obs", *sets)
    found = found.where("_obs IS NOT NULL").select("_obs", *sets)
    return found.unionByName(given)


def _small(spark, columns: dict[str, list]) -> DataFrame:
    """A table of longs, or of arrays of longs, held in the plan."""
    kinds = [pa.list_(pa.int64()) if values and isinstance(values[0], list) else pa.int64() for values in columns.values()]
    return spark.createDataFrame(pa.table([pa.array(v, k) for v, k in zip(columns.values(), kinds)], names=list(columns)))


def _cuts(every: DataFrame, policy: SkewPolicy) -> tuple[dict[int, list[int]], list[tuple[int, int, int]]]:
    """Where a range partitioning of rows (_h, _u, _side) cuts through entities.

    As for a global sort, the bounds of equal ranges come from a sample of the rows, RANGE_ROWS
    for each range on average.  There are RANGES_PER_TASK ranges for each shuffle partition,
    or as many as keep a range below `hot_rows` rows, and at most MOST_RANGES.  Only bounds in
    entities that have two or more matter: an entity with fewer has less than two ranges of
    rows and lies in one task.  Returns the cuts by entity, as 2 * time + side, and the
    instants on which two or more bounds fall.
    """
    spark = every.sparkSession
    total = every.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(RANGES_PER_TASK * tasks, -(-total // policy.hot_rows)))
    share = min(1.0, RANGE_ROWS * ranges / max(total, 1))
    chosen = every if share == 1 else every.sample(share, seed=20240229)
    sample = chosen.select("_h", (F.col("_u") * 2 + F.col("_side")).alias("x")).toArrow()
    places = np.stack([sample.column(c).to_numpy() for c in ("_h", "x")], axis=1)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    bounds = places[np.unique(np.arange(1, ranges) * len(places) // ranges)] if len(places) else places
    by_entity: dict[int, list[int]] = {}
    for h, x in bounds.tolist():
        by_entity.setdefault(h, []).append(x)
    several = {h: xs for h, xs in by_entity.items() if len(xs) > 1}
    crowded = [(h, x >> 1, x & 1) for h, xs in several.items() for x, n in Counter(xs).items() if n > 1]
    return {h: sorted(set(xs)) for h, xs in several.items()}, crowded


def _count_up_to(sorted_longs: str, value: Column) -> Column:
    """How many entries of a sorted array are at most `value`, by halving; 0 for no array."""
    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        up = (low < high) & (F.get(sorted_longs, middle) <= value)
        return F.struct(
            F.when(up, middle + 1).otherwise(low).alias("low"), F.when(up | (low >= high), high).otherwise(middle).alias("high")
        )

    size = F.size(sorted_longs)
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    # an array of n entries is empty after log2(n) + 1 halves
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.when(F.col(sorted_longs).isNull(), 0).otherwise(F.aggregate(steps, start, halve)["low"])
