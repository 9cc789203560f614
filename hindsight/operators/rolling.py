"""Rolling aggregates per entity over a look-back that ends at each row.

The frame of a row holds the rows of its key whose time, in whole seconds, lies between
`duration` before the row's second and that second, both ends included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from hindsight.functions.columns import epoch_seconds
from hindsight.operators.skew import SkewPolicy, heavy_groups, inline, is_in, key_hash

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg}
#: Seconds of a tile at most, which bounds what a task holds of a key; tiles that a frame is
#: summed from directly, before tiles of tiles take over.
LONGEST_TILE = 21_600
REACH = 64
#: Places that a task puts frames together for, on average; it holds some rows for each.
TASK_PLACES = 1 << 17
#: Times as many rows as a crowded stretch has.
VERY_DENSE = 10


@dataclass(frozen=True)
class Rolling:
    """One output column: `func(column)` over the last `duration`."""

    name: str
    func: str
    column: str
    duration: timedelta

    def __post_init__(self):
        if self.func not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.func!r}, expected one of {sorted(FUNCTIONS)}")
        if self.duration <= timedelta(0) or self.duration.microseconds:
            raise ValueError(f"{self.name}: the duration must be a positive number of whole seconds")

    @property
    def seconds(self) -> int:
        return int(self.duration.total_seconds())


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    aggs: Sequence[Rolling],
    keep: Sequence[str] = (),
    policy: SkewPolicy | None = SkewPolicy(),
    wanted: Column | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: keys, time, `keep`, then the aggregates in order.

    Keys with few rows per frame take one shuffle, one sort and one window.  Keys with
    many are reduced to one row per second first and their frames put together from
    tiles (`_tiled`), so that no task re-reads or holds a long frame.  `policy=None`
    skips the profile and uses the plain form for every key.

    `wanted`: which rows get a result; the others are only seen by them.  `before`: sums of
    rows that are not in `df` any more (`partial_sums`), seen like the rows themselves.
    """
    if not aggs:
        raise ValueError("no aggregates given")
    columns = list(dict.fromkeys([*keys, ts, *keep, *[a.column for a in aggs]]))
    names = [*dict.fromkeys([*keys, ts, *keep]), *[a.name for a in aggs]]
    if len(set(names)) < len(names) or any(n.startswith("__") for n in [*columns, *names]):
        raise ValueError(f"output names must differ and not start with two underscores: {names}")
    own = [] if wanted is None and before is None else [(F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("__own")]
    base = df.select(*columns, epoch_seconds(ts).alias("__sec"), *own)
    if before is not None:
        before = before.withColumn("__sec", epoch_seconds("__at")).drop("__at")
    plain = _plain(base, keys, ts, aggs, keep, before)
    if policy is None:
        return plain

    places = base.select(*keys, "__sec") if before is None else base.select(*keys, "__sec").unionByName(before.select(*keys, "__sec"))
    longest, all_rows = max(a.seconds for a in aggs), Observation()
    counted = _dense_keys(places.observe(all_rows, F.count(F.lit(1)).alias("n")), keys, longest, policy)
    densest = counted.orderBy(F.desc("n"), "h").limit(policy.max_groups + 1).collect()
    if not densest:
        return plain
    dense = _dense_keys(places, keys, longest, policy)
    tasks = _tasks(base.sparkSession, all_rows.get["n"])
    if len(densest) > policy.max_groups and densest[-1].n > VERY_DENSE * policy.dense_rows:
        # so many so crowded keys that the others are better off in tiles, too
        return _tiled(base, keys, ts, aggs, keep, policy, before, tasks)
    listed = [r.h for r in densest]

    def marked(rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("__h", key_hash(keys))
        if len(listed) <= policy.max_groups:
            return hashed.withColumn("__dense", is_in("__h", listed)).drop("__h")
        # too many for a list in the plan: they meet their rows by a join
        many = dense.select(F.col("h").alias("__h"), F.lit(True).alias("__dense"))
        return hashed.join(many, "__h", "left").withColumn("__dense", F.coalesce("__dense", F.lit(False))).drop("__h")

    base, before = marked(base), None if before is None else marked(before)
    part = lambda which: [None if d is None else d.where(which).drop("__dense") for d in (base, before)]
    some, seen = part("NOT __dense")
    ordinary = _plain(some, keys, ts, aggs, keep, seen)
    some, seen = part("__dense")
    return ordinary.unionByName(_tiled(some, keys, ts, aggs, keep, policy, seen, tasks))


def partial_sums(df: DataFrame, keys: Sequence[str], ts: str, aggs: Sequence[Rolling]) -> DataFrame:
    """What frames need of rows: keys, `__at` (a whole second), and the sums of `_parts`."""
    parts = _parts(df.schema, aggs)
    sums = [F.sum(c).alias(name) for some in parts.values() for name, c in some.items()]
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, F.timestamp_seconds(epoch_seconds(ts)).alias("__at")).agg(*sums)


def coarser_sums(sums: DataFrame, keys: Sequence[str], seconds: int, begin: Column) -> DataFrame:
    """`partial_sums` over tiles of so many seconds; a tile is placed at its start, or at `begin` if that is later."""
    tile = F.timestamp_seconds(F.expr(f"unix_seconds(__at) - pmod(unix_seconds(__at), {seconds})"))
    names = [c for c in sums.columns if c not in (*keys, "__at")]
    return sums.groupBy(*keys, F.greatest(tile, begin).alias("__at")).agg(*[F.sum(c).alias(c) for c in names])


def _parts(schema, aggs) -> dict[str, dict[str, Column]]:
    """For each aggregated column, what is summed up: its values, or exact parts of them.

    A floating number is cut into a whole number of millionths, as two longs, and what is
    left.  Sums of the longs do not depend on the order, so neither do those of numbers below
    2**31 with up to six decimals; others depend on it by the rounding of what is left.
    """
    out: dict[str, dict[str, Column]] = {}
    for i, column in enumerate(dict.fromkeys(a.column for a in aggs)):
        c = F.col(column)
        parts = {f"__n{i}": F.when(c.isNotNull(), 1)}
        if any(a.column == column and a.func != "count" for a in aggs):
            if schema[column].dataType.typeName() in ("double", "float"):
                x = c.cast("double")
                fits = F.abs(x) < float(1 << 31)
                millionths = F.when(fits, F.round(x * 1e6).cast("long")).otherwise(F.lit(0).cast("long"))
                high = F.floor(millionths / float(1 << 26)).cast("long")
                parts[f"__h{i}"] = F.when(c.isNotNull(), high)
                parts[f"__l{i}"] = F.when(c.isNotNull(), millionths - high * (1 << 26))
                parts[f"__s{i}"] = x - millionths / 1e6
            else:
                parts[f"__s{i}"] = c
        out[column] = parts
    return out


def _result(a: Rolling, i: int, exact: bool, total, dtype) -> Column:
    """The aggregate from the totals of its column's parts."""
    n = total(f"__n{i}")
    if a.func == "count":
        return F.coalesce(n, F.lit(0)).cast(dtype).alias(a.name)
    value = total(f"__s{i}")
    if exact:
        value = (total(f"__h{i}") * float(1 << 26) + total(f"__l{i}")) / 1e6 + value
    return F.when(n > 0, value if a.func == "sum" else value / n).cast(dtype).alias(a.name)


def _types(base, aggs) -> dict:
    """The types that Spark gives these aggregates."""
    return {f.name: f.dataType for f in base.select(*[FUNCTIONS[a.func](a.column).alias(a.name) for a in aggs]).schema}


def _plain(base, keys, ts, aggs, keep, before=None) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("__sec")
    parts, types = _parts(base.schema, aggs), _types(base, aggs)
    cut = base.withColumns({name: c for some in parts.values() for name, c in some.items()})
    if before is not None:
        cut = cut.unionByName(before, allowMissingColumns=True)
    needed = {}
    for a in aggs:
        for p in parts[a.column]:
            if a.func != "count" or p.startswith("__n"):
                needed[a.seconds, p] = F.sum(p).over(ordered.rangeBetween(-a.seconds, 0)).alias(f"__t{a.seconds}{p}")
    kept = list(dict.fromkeys([*keys, ts, *keep]))
    # each part of a frame is summed once, whichever aggregates need it
    own = ["__own"] if "__own" in base.columns else []
    summed = cut.select(*kept, *own, *needed.values())
    summed = summed.where("__own") if own else summed

    def result(a: Rolling) -> Column:
        i = list(parts).index(a.column)
        return _result(a, i, f"__h{i}" in parts[a.column], lambda p: F.col(f"__t{a.seconds}{p}"), types[a.name])

    return summed.select(*kept, *map(result, aggs))


def _dense_keys(base, keys, longest: int, policy: SkewPolicy) -> DataFrame:
    """Hashes of the keys of which a stretch of one frame length is crowded, and the rows of the most crowded one."""
    stretch = base.select(
        key_hash(keys).alias("h"), F.expr(f"(__sec - pmod(__sec, {longest})) div {longest}").alias("b")
    )
    return stretch.groupBy("h", "b").count().where(F.col("count") > policy.dense_rows).groupBy("h").agg(F.max("count").alias("n"))


def _tasks(spark, places: int) -> int:
    """How many tasks so many places are dealt over, so that none holds more the more there are; 0 if a round of tasks will do."""
    tasks = -(-places // TASK_PLACES)
    return tasks if tasks > spark.sparkContext.defaultParallelism else 0


def _tile_groups(durations: Sequence[int]) -> list[tuple[int, list[int]]]:
    """(tile, durations) of the frames that share tiles, shortest first.

    A tile is no longer than the shortest frame of its group nor than LONGEST_TILE, and but
    for the longest tiles no frame has more than REACH of them.
    """
    groups: list[tuple[int, list[int]]] = []
    for d in sorted(set(durations)):
        if groups and (groups[-1][0] == LONGEST_TILE or d <= REACH * groups[-1][0]):
            groups[-1][1].append(d)
        else:
            groups.append((min(d, LONGEST_TILE), [d]))
    return groups


def _widest(kind: DataType) -> DataType:
    """The type of a sum of sums."""
    return DecimalType(38, kind.scale) if isinstance(kind, DecimalType) else kind


def _sum_of(columns: Sequence[str]) -> Column:
    added = F.coalesce(F.col(columns[0]), F.lit(0))
    for c in columns[1:]:
        added = added + F.coalesce(F.col(c), F.lit(0))
    return added


def _framed(places: DataFrame, keys: Sequence[str], names: Sequence[str], durations: Sequence[int], tasks: int = 0) -> DataFrame:
    """`places` with the sums `__t<d><name>` over the places from `__pos` - d to `__pos`, for each d.

    places: one row per key and whole-numbered place, `names` are the columns to sum up.  A
    place without a number sees only itself.  Time is cut into tiles.  For a place s in tile
    b, a frame of length d is in three parts: from the start of the tile to s; what a copy,
    moved ahead by d, has in tile b from s on; and what lies between, which is the same for
    all places of the tile: whole tiles, and the end of the tile before them where tiles do
    not divide d.  What lies between is found on one row per tile; if that takes many tiles,
    by the same method, with tiles of tiles.  Nothing is subtracted.  `tasks`: how many the
    rows of a level are dealt over, 0 for as many as Spark takes.
    """
    out = places
    for tile, lengths in _tile_groups(durations):
        out = _framed_by(out, places, keys, names, tile, lengths, tasks)
    return out


def _framed_by(asked: DataFrame, places: DataFrame, keys, names, tile: int, durations: Sequence[int], tasks: int) -> DataFrame:
    carried = [c for c in asked.columns if c not in (*keys, "__pos")]
    in_tile = lambda place: F.expr(f"({place} - pmod({place}, {tile})) div {tile}")
    whole = {d: d // tile - 1 for d in durations if d >= 2 * tile}
    ends = {d: d % tile for d in durations if d % tile}

    # Sums of tiles and of their last places.  Places without a number have none; they are told
    # apart after the sums, since a filter would be pushed below the aggregation and keep Spark
    # from reusing its shuffle.
    tiles = (
        places.withColumn("__tile", in_tile("__pos"))
        .groupBy(*keys, "__tile")
        .agg(
            *[F.sum(p).alias(p) for p in names],
            *[F.sum(F.when(F.expr(f"pmod(__pos, {tile})") >= tile - r, F.col(p))).alias(f"__e{d}{p}") for d, r in ends.items() for p in names],
        )
    )
    per_tile = Window.partitionBy(*keys).orderBy("__tile")
    numbered = F.col("__tile").isNotNull()
    near = {d: n for d, n in whole.items() if n <= REACH}
    between = tiles.select(
        *keys, "__tile",
        *[F.when(numbered, F.sum(p).over(per_tile.rangeBetween(-n, -1))).alias(f"__w{d}{p}") for d, n in near.items() for p in names],
        *[
            F.when(numbered, F.sum(f"__e{d}{p}").over(per_tile.rangeBetween(-(d // tile), -(d // tile)))).alias(f"__e{d}{p}")
            for d in ends for p in names
        ],
    )
    middle = [(between, {d: [x for x, some in (("__w", near), ("__e", ends)) if d in some] for d in durations})]
    if far := {d: n for d, n in whole.items() if n > REACH}:
        # the n tiles before tile b are the frame of length n - 1 that ends at b - 1
        moved = tiles.select(*keys, (F.col("__tile") + 1).alias("__pos"), F.lit(None).cast("int").alias("__ask"), *names)
        here = tiles.select(*keys, F.col("__tile").alias("__pos"), F.lit(1).alias("__ask"))
        both = moved.unionByName(here, allowMissingColumns=True).where("__pos IS NOT NULL")
        ranked = both.groupBy(*keys, "__pos").agg(F.max("__ask").alias("__ask"), *[F.sum(p).alias(p) for p in names])
        higher = _framed(ranked, keys, names, sorted({n - 1 for n in far.values()}), tasks).where("__ask = 1")
        higher = higher.select(*keys, F.col("__pos").alias("__tile"), *[F.col(f"__t{n - 1}{p}").alias(f"__w{d}{p}") for d, n in far.items() for p in names])
        middle.append((higher, {d: ["__w"] for d in far}))

    # All parts are rows of the same few columns, told apart by `__kind`: 0 for a place itself, i
    # for what the frame of the i-th length has.  What lies between stands behind the tile's end.
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(d).alias("shift")) for i, d in enumerate(durations, 1)]))
    rows = asked.select(*keys, in_tile("__pos").alias("__tile"), "__pos", F.lit(0).alias("__kind"), *carried)
    # what is NULL in all columns adds nothing
    adds = F.coalesce(*[F.col(p).cast("string") for p in names]).isNotNull()
    copies = places.where(F.col("__pos").isNotNull() & adds).select(*keys, "__pos", *names, ahead.alias("__m"))
    copies = copies.select(*keys, F.expr("__pos + __m.shift").alias("__pos"), F.col("__m.kind").alias("__kind"), *names)
    rows = rows.unionByName(copies.withColumn("__tile", in_tile("__pos")), allowMissingColumns=True)
    kinds = {p: _widest(places.schema[p].dataType) for p in names}
    for part, pieces in middle:
        sums = [
            F.struct(F.lit(i).alias("kind"), *[_sum_of([f"{x}{d}{p}" for x in pieces[d]]).cast(kinds[p]).alias(p) for p in names])
            for i, d in enumerate(durations, 1) if pieces.get(d)
        ]
        if not sums:
            continue
        some = F.coalesce(*[F.col(f"{x}{d}{p}").cast("string") for d, found in pieces.items() for x in found for p in names])
        behind = part.where(some.isNotNull()).select(*keys, "__tile", F.explode(F.array(*sums)).alias("__m"))
        behind = behind.select(*keys, "__tile", ((F.col("__tile") + 1) * tile).alias("__pos"), F.col("__m.kind").alias("__kind"), *[F.col(f"__m.{p}").alias(p) for p in names])
        rows = rows.unionByName(behind, allowMissingColumns=True)
    if tasks:
        rows = rows.repartition(tasks, *keys, "__tile")

    within = Window.partitionBy(*keys, "__tile")
    upward = within.orderBy("__pos").rangeBetween(Window.unboundedPreceding, 0)
    downward = within.orderBy(F.desc("__pos")).rangeBetween(Window.unboundedPreceding, 0)
    lasts = [f"__last{p}" for p in names]
    upwards = rows.select(
        *keys, "__tile", "__pos", "__kind", *dict.fromkeys([*carried, *names]),
        *[F.sum(F.when(F.col("__kind") == 0, F.col(p))).over(upward).alias(last) for p, last in zip(names, lasts, strict=True)],
        F.max(F.col("__kind") == 0).over(upward).alias("__seen"),
    )
    # copies behind which no place of their tile stands are in no frame
    found = upwards.where("__seen").select(
        *keys, "__pos", "__kind", *carried, *lasts,
        *[F.sum(F.when(F.col("__kind") == i, F.col(p))).over(downward).alias(f"__first{d}{p}") for i, d in enumerate(durations, 1) for p in names],
    ).where("__kind = 0")
    total = lambda d, p: _sum_of([f"__first{d}{p}", f"__last{p}"]).alias(f"__t{d}{p}")
    return found.select(*keys, "__pos", *carried, *[total(d, p) for d in durations for p in names])


def _tiled(base, keys, ts, aggs, keep, policy: SkewPolicy, before=None, tasks: int = 0) -> DataFrame:
    """The same aggregates in linear work, whatever number of rows a key has.

    Rows are combined per (key, second) on the map side, frames put together from tiles
    (`_framed`).  What is summed are the same parts as in the plain form (`_parts`).
    """
    parts = _parts(base.schema, aggs)
    cut = base.select(*keys, "__sec", *[c.alias(name) for some in parts.values() for name, c in some.items()])
    partials = cut.columns[len(keys) + 1 :]
    if before is not None:
        cut = cut.unionByName(before)
    seconds = cut.groupBy(*keys, F.col("__sec").alias("__pos")).agg(*[F.sum(name).alias(name) for name in partials])
    framed = _framed(seconds, keys, partials, [a.seconds for a in aggs], tasks)
    types = _types(base, aggs)

    def result(a: Rolling) -> Column:
        i = list(parts).index(a.column)
        return _result(a, i, f"__h{i}" in parts[a.column], lambda p: F.col(f"__t{a.seconds}{p}"), types[a.name])

    results = framed.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__pos").alias("__at"), *map(result, aggs))
    if "__own" in base.columns:
        base = base.where("__own")
    return _attach(base, results, keys, [*dict.fromkeys([*keys, ts, *keep])], [a.name for a in aggs], policy)


def _attach(base, results, keys, columns, names, policy: SkewPolicy) -> DataFrame:
    """Give every row the result of its (key, second).

    Seconds that hold more rows than one task should take are few (rows / hot_rows), so
    their results are broadcast and their rows stay where they are; the rest is shuffled.
    """
    base = base.select(*columns, "__sec")
    where = F.col("__sec").eqNullSafe(F.col("__at"))
    for k in keys:
        where = where & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    hashed = base.withColumn("__h", key_hash(keys))
    crowded = heavy_groups(hashed, ["__h", "__sec"], policy.hot_rows, policy)
    if not crowded:
        return base.join(results, where, "left").select(*columns, *names)

    listed = F.broadcast(inline(base.sparkSession, ["__lh", "__ls"], [(r["__h"], r["__sec"]) for r in crowded]))

    def among(df: DataFrame, sec: str, how: str) -> DataFrame:
        matched = (F.col("__h") == F.col("__lh")) & F.col(sec).eqNullSafe(F.col("__ls"))
        return df.join(listed, matched, how)

    hashed_results = results.withColumn("__h", key_hash([f"__r_{k}" for k in keys]))
    few = F.broadcast(among(hashed_results, "__at", "left_semi").drop("__h"))
    hot = among(hashed, "__sec", "left_semi").join(few, where, "left")
    rest = among(hashed, "__sec", "left_anti").join(results, where, "left")
    return hot.select(*columns, *names).unionByName(rest.select(*columns, *names))


class EntityWise:
    """A declaration of transformers: each output row depends on rows of its own entity only.

    keys: the columns that name the entity.  longest: how far before an output row's time
    those rows can lie.  Feature sets then read no more of their source than that.
    """

    keys: list[str]
    longest: timedelta


class RollingTransformer(Transformer, EntityWise):
    """A feature-set transformer that is a list of rolling aggregates."""

    def __init__(self, keys, ts, aggs, keep=(), policy: SkewPolicy | None = SkewPolicy()):
        super().__init__()
        self.keys, self.ts, self.aggs, self.keep, self.policy = list(keys), ts, list(aggs), list(keep), policy

    @property
    def longest(self) -> timedelta:
        return max(a.duration for a in self.aggs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.resume(dataset)

    def resume(self, dataset: DataFrame, wanted: Column | None = None, before: DataFrame | None = None) -> DataFrame:
        """The aggregates of the wanted rows, which see the sums of earlier ones (`sums`) too."""
        return rolling(dataset, self.keys, self.ts, self.aggs, self.keep, self.policy, wanted, before)

    def sums(self, dataset: DataFrame) -> DataFrame:
        return partial_sums(dataset, self.keys, self.ts, self.aggs)
