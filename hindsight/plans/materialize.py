"""Computing feature sets for time windows and storing them.

Windows are half-open, [start, end), and start and end on whole seconds: rolling frames
take rows of the same second together, and a window must not cut through them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions.columns import time_literal, utc_time
from hindsight.operators.rolling import EntityWise, RollingTransformer, coarser_sums
from hindsight.sources.ledger import EPOCH, Segment, joined
from hindsight.sources.scan import EVERYTHING, Span, read_source, within
from hindsight.sources.store import OfflineStore, cut_to
from hindsight.spec.model import FeatureSet

Time = str | datetime


def _bound(value: Time | None) -> datetime | None:
    if value is None:
        return None
    moment = utc_time(value)
    if moment.microsecond:
        raise ValueError(f"window bound {moment} is not on a whole second")
    return moment


def compute_features(
    spark: SparkSession,
    fs: FeatureSet,
    spans: Sequence[Span] = (EVERYTHING,),
    untimed: bool = False,
    entities: DataFrame | None = None,
) -> DataFrame:
    """The feature rows of some time spans, straight from the source.

    The source is read from `source_lookback` before each span on (M2), so that frames
    are complete at its left edge, or from where its frames begin if the transformer
    declares that (`EntityWise`); the spans are cut out afterwards (P14).  `entities`: a
    table of keys outside of which no rows are wanted; a transformer that declares to work
    entity by entity, as rolling aggregates do, then sees only their source rows.
    """
    if fs.ts is None:
        if any(span != EVERYTHING for span in spans):
            raise ValueError(f"{fs.name}: its rows have no time")
        source, wise = read_source(spark, fs.source), fs.transformer is None
        features = fs.conform(fs.transform(_only(source, fs, entities) if wise else source))
        return features if wise else _only(features, fs, entities)
    own = fs.transformer if isinstance(fs.transformer, EntityWise) else None
    back = fs.source_lookback if own is None else min(fs.source_lookback, own.longest)
    widened = [(None if a is None else a - back, b) for a, b in spans]
    source = read_source(spark, fs.source, widened, untimed)
    if entities is not None and (fs.transformer is None or own is not None and set(fs.keys) <= set(own.keys)):
        source, entities = _only(source, fs, entities), None
    features = _only(fs.conform(fs.transform(source)), fs, entities)
    if EVERYTHING in spans:
        return features
    return features.where(within(features, fs.ts, spans, untimed))


def _only(df: DataFrame, fs: FeatureSet, entities: DataFrame | None) -> DataFrame:
    return df if entities is None else df.join(entities, fs.keys, "left_semi")


def backfill(fs: FeatureSet, start: Time, end: Time, store: OfflineStore, keep_state: bool = False) -> str:
    """Compute and store the window [start, end) (M1). Repeating it replaces its rows.

    `keep_state`: of rolling aggregates, store the window's partial sums as well, and read those
    of earlier windows instead of their source rows (`resumed`).
    """
    a, b = _bound(start), _bound(end)
    if a >= b:
        raise ValueError(f"empty window {a} to {b}")
    if keep_state and isinstance(fs.transformer, RollingTransformer):
        features, state = resumed(fs, a, b, store)
        return store.write(fs, features, a, b, state)
    return store.write(fs, compute_features(store.spark, fs, [(a, b)]), a, b)


def backfill_whole(fs: FeatureSet, store: OfflineStore) -> str:
    """Compute and store a feature set without time (M1), in place of what was stored before."""
    return store.write_whole(fs, compute_features(store.spark, fs))


#: Seconds of the tiles in which the sums of earlier windows are kept, and the table that has them.
STATE_TILE = 3600
SUMS = "sums"


def resumed(fs: FeatureSet, start: datetime, end: datetime, store: OfflineStore) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Features of a window by the sums that earlier windows have kept, and its own sums (M3).

    From the source come the window's rows, and those of stretches within the longest frame
    for which no sums are kept.  For the rest, tiles of an hour, and single seconds where a
    frame can begin or where a stretch ends within a tile.  Frames are sums of the same
    numbers as with all source rows, so results are the same in every bit as far as those of
    `rolling` are; rows that arrive in the source after their window was computed are seen
    neither by it nor by later windows.
    """
    spark, own = store.spark, fs.transformer
    back = (start - own.longest, start)
    snapshot = store.snapshot(fs)
    kept = [s for s in cut_to(store.segments(fs, snapshot), [back]) if s.state]
    missing = gaps(joined((s.start, s.end) for s in kept), back)
    source = read_source(spark, fs.source, [*missing, (start, end)])
    fine, coarse = _by_grain(kept, [(start - a.duration, end - a.duration) for a in own.aggs])
    before = None
    for grain, segments in ((1, fine), (STATE_TILE, coarse)):
        rows = store.read_table(fs, SUMS, "__at", snapshot, back, segments)
        if rows is not None:
            rows = rows.where(F.col("__grain") == grain).drop("__grain")
            before = rows if before is None else before.unionByName(rows)
    mine = within(source, fs.ts, [(start, end)])
    features = fs.conform(own.resume(source, mine, before))
    seconds = own.sums(source.where(mine))
    tiles = coarser_sums(seconds, own.keys, STATE_TILE, time_literal(start))
    both = seconds.withColumn("__grain", F.lit(1)).unionByName(tiles.withColumn("__grain", F.lit(STATE_TILE)))
    return features, {SUMS: both}


def _by_grain(segments: Sequence[Segment], begins: Sequence[Span]) -> tuple[list[Segment], list[Segment]]:
    """Parts of stretches to be read by seconds, and parts of whole tiles.

    By seconds: tiles in which a frame can begin, those of `begins`, and tiles of which a
    stretch has a part only.
    """
    tile = timedelta(seconds=STATE_TILE)
    down = lambda t: t - (t - EPOCH) % tile
    up = lambda t: down(t + tile - timedelta(microseconds=1))
    cut = joined((down(a), up(b)) for a, b in begins)
    fine, coarse = [], []
    for s in segments:
        inner = (up(s.start), down(s.end))
        whole = gaps(cut, inner) if inner[0] < inner[1] else []
        coarse += cut_to([s], whole)
        fine += cut_to([s], gaps(whole, (s.start, s.end)))
    return fine, coarse


# The frequency names of a schedule.
FREQUENCIES = {
    "minute": timedelta(minutes=1),
    "hour": timedelta(hours=1),
    "day": timedelta(days=1),
    "week": timedelta(weeks=1),
}


def interval_of(fs: FeatureSet) -> timedelta:
    """The interval of the feature set's own schedule."""
    if not fs.schedule:
        raise ValueError(f"{fs.name}: no interval given and no schedule declared")
    return fs.schedule["interval"] * FREQUENCIES[fs.schedule["frequency"].lower()]


def next_window(
    fs: FeatureSet, store: OfflineStore, now: Time, interval: timedelta | None = None, first: Time | None = None
) -> tuple[datetime, datetime] | None:
    """The stretch a recurring run has to add (M3), or None if nothing is due.

    It starts where the stored windows end, or at `first`, and ends a whole number of
    intervals later, not after `now - delay`: later source rows may still be on their way.
    Interval and first time come from the feature set's schedule unless given.
    """
    interval = interval or interval_of(fs)
    covered = store.covered(fs)
    start = covered[-1][1] if covered else _bound(first or fs.schedule.get("start_time"))
    if start is None:
        raise ValueError(f"{fs.name}: nothing is stored and no first time is given")
    due = (utc_time(now) - fs.source.delay - start) // interval
    return (start, start + due * interval) if due > 0 else None


def materialize_next(
    fs: FeatureSet, store: OfflineStore, now: Time, interval: timedelta | None = None, first: Time | None = None
) -> tuple[datetime, datetime] | None:
    """Run the next due window (M3) and return it; rolling sums go on where the last run left them."""
    window = next_window(fs, store, now, interval, first)
    if window is not None:
        backfill(fs, *window, store, keep_state=True)
    return window


def gaps(covered: Sequence[tuple[datetime, datetime]], span: Span) -> list[Span]:
    """The parts of a span that lie in none of the sorted, disjoint stretches."""
    low, high = span
    missing: list[Span] = []
    for start, end in covered:
        if high is not None and start >= high:
            break
        if low is not None and end <= low:
            continue
        if low is None or low < start:
            missing.append((low, start))
        low = end
    if high is None or low is None or low < high:
        missing.append((low, high))
    return missing


def read_features(
    spark: SparkSession,
    fs: FeatureSet,
    store: OfflineStore | None = None,
    start: Time | None = None,
    end: Time | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """The feature rows of a time span, or all of them (S4, M4), if given of some entities.

    Materialised stretches come from the store, the rest is computed from the source.
    Rows without a time belong to no window; they come with an unlimited read.
    """
    if fs.ts is None:
        whole = store.read_whole(fs) if store else None
        return compute_features(spark, fs, entities=entities) if whole is None else _only(fs.conform(whole), fs, entities)
    span = (_bound(start), _bound(end))
    snapshot = store.snapshot(fs) if store else None
    stored = store.read(fs, span, snapshot) if snapshot else None
    missing = gaps(snapshot.covered if snapshot else [], span)
    untimed = span == EVERYTHING
    parts = [] if stored is None else [_only(fs.conform(stored), fs, entities)]
    if missing or untimed or not parts:
        parts.append(compute_features(spark, fs, missing, untimed, entities))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def outline(
    spark: SparkSession,
    fs: FeatureSet,
    store: OfflineStore | None = None,
    start: Time | None = None,
    end: Time | None = None,
    entities: DataFrame | None = None,
) -> DataFrame | None:
    """Keys and time of about the rows of `read_features`, without computing any feature.

    Where the features are not stored, the rows of the source stand for them; None if the
    source lacks the keys in their declared type, because the transformer makes them.
    """
    if fs.ts is None:
        return None
    span = (_bound(start), _bound(end))
    snapshot = store.snapshot(fs) if store else None
    missing = gaps(snapshot.covered if snapshot else [], span)
    source = read_source(spark, fs.source, missing)
    types = {f.name: f.dataType for f in source.schema}
    if fs.ts not in types or any(types.get(c.name) != c.spark.dataType for c in fs.index_columns):
        return None
    rows = source.select(*fs.keys, fs.ts)
    stored = store.read(fs, span, snapshot) if snapshot else None
    return _only(rows if stored is None else rows.unionByName(stored.select(*fs.keys, fs.ts)), fs, entities)
