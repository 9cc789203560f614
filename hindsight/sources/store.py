"""The offline store: feature rows computed for time windows, kept as parquet.

Layout of one feature-set version:

    <root>/<set>/<version>/data/day=<date>/run=<id>/*.parquet
    <root>/<set>/<version>/whole/run=<id>/*.parquet             of a set without a time column
    <root>/<set>/<version>/ledger, index                        see `ledger`

Every materialisation appends files of its own run and then commits its window to the ledger.
That entry is what makes the run visible, so a run that dies half-way leaves nothing to be
read, stored rows are never rewritten, and repeating a window replaces it.  `vacuum` removes
runs that no reader of a version from some number on can see.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions.columns import time_literal
from hindsight.session import require_utc
from hindsight.sources.files import delete, matching
from hindsight.sources.ledger import EPOCH, Ledger, Segment, Snapshot, from_micros
from hindsight.sources.scan import EVERYTHING, Span, within
from hindsight.spec.model import FeatureSet

__all__ = ["OfflineStore", "Segment", "Snapshot", "cut_to", "from_micros"]


#: The window under which the ledger has runs of sets without time.
WHOLE = (EPOCH, EPOCH + timedelta(days=1))


class OfflineStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def folder(self, fs: FeatureSet) -> str:
        return f"{self.root}/{fs.name}/{fs.version}"

    def ledger(self, fs: FeatureSet) -> Ledger:
        return Ledger(self.spark, self.folder(fs))

    def snapshot(self, fs: FeatureSet, version: int | None = None) -> Snapshot:
        """What is valid, as of a version (the number of a committed window) or now."""
        return self.ledger(fs).snapshot(version)

    def segments(self, fs: FeatureSet, snapshot: Snapshot | None = None) -> list[Segment]:
        """Disjoint materialised stretches in order of time; later runs win."""
        ledger = self.ledger(fs)
        return ledger.segments(snapshot or ledger.snapshot())

    def covered(self, fs: FeatureSet) -> list[tuple[datetime, datetime]]:
        """Materialised stretches, neighbours joined."""
        return self.snapshot(fs).covered

    def write(
        self, fs: FeatureSet, df: DataFrame, start: datetime, end: datetime, state: Mapping[str, DataFrame] | None = None
    ) -> str:
        """Store the rows of the window [start, end) as one run and make it visible.

        `state`: further tables of the run, with a time column `__at` in the window, by name.
        """
        require_utc(self.spark)
        run = f"r-{uuid.uuid4().hex}"
        self._append(df.where(within(df, fs.ts, [(start, end)])), fs.ts, run, f"{self.folder(fs)}/data")
        for name, rows in (state or {}).items():
            self._append(rows, "__at", run, f"{self.folder(fs)}/{name}")
        self._commit(fs, run, start, end, state is not None)
        return run

    def write_whole(self, fs: FeatureSet, df: DataFrame) -> str:
        """Store the rows of a feature set without time as one run, in place of those before."""
        run = f"r-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder(fs)}/whole/run={run}")
        self._commit(fs, run, *WHOLE, False)
        return run

    def read_whole(self, fs: FeatureSet, snapshot: Snapshot | None = None) -> DataFrame | None:
        """The rows of a feature set without time; None if it is not materialised."""
        found = self.segments(fs, snapshot)
        return self.spark.read.parquet(f"{self.folder(fs)}/whole/run={found[0].run}") if found else None

    def _append(self, df: DataFrame, ts: str, run: str, folder: str) -> None:
        (
            df.withColumns({"day": F.col(ts).cast("date"), "run": F.lit(run)})
            # Whole files per day however the features were partitioned; large days split.
            .hint("rebalance", F.col("day"))
            .write.mode("append")
            .partitionBy("day", "run")
            .parquet(folder)
        )

    def _commit(self, fs: FeatureSet, run: str, start: datetime, end: datetime, state: bool) -> int:
        return self.ledger(fs).commit(run, start, end, state)

    def read(self, fs: FeatureSet, span: Span = EVERYTHING, snapshot: Snapshot | None = None) -> DataFrame | None:
        """Valid stored rows of a time span; None if none of it is materialised.

        `snapshot`: that of the feature set, if it has been looked up already, or an older one.
        """
        require_utc(self.spark)
        snapshot = snapshot or self.snapshot(fs)
        return self.read_table(fs, "data", fs.ts, snapshot, span)

    def read_table(
        self, fs: FeatureSet, table: str, ts: str, snapshot: Snapshot, span: Span, segments: Sequence[Segment] | None = None
    ) -> DataFrame | None:
        """Rows of one table of the runs that are valid in a span, or in some segments of it."""
        low, high = span
        stretches = snapshot.covered if segments is None else [(s.start, s.end) for s in segments]
        wanted = cut_to([Segment(a, b, "") for a, b in stretches], [span])
        if not wanted:
            return None
        try:
            rows = self.spark.read.parquet(f"{self.folder(fs)}/{table}")
        except AnalysisException as error:
            # Only windows without any row have been materialised so far.
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        first, last = wanted[0].start, wanted[-1].end
        days = F.col("day").between(F.lit(first.date()), F.lit(last.date()))
        rows = rows.where(days & within(rows, ts, [(first, last)]))
        recent = cut_to(snapshot.recent if segments is None else segments, [span])
        parts = []
        if segments is None and (index := self.ledger(fs).stretches(snapshot)) is not None:
            after = [(s.start, s.end) for s in snapshot.recent]
            index = index.where(days & (F.col("start") < time_literal(last)) & (F.col("end") > time_literal(first)))
            old = rows.where(~within(rows, ts, after)) if after else rows
            parts.append(_valid(old, F.broadcast(index.select("day", "run", F.col("start").alias("__start"), F.col("end").alias("__end"))), ["day", "run"], ts))
        if recent:
            listed = ", ".join(f"('{s.run}', TIMESTAMP '{s.start.isoformat(sep=' ')}+00:00', TIMESTAMP '{s.end.isoformat(sep=' ')}+00:00')" for s in recent)
            stretch = self.spark.sql(f"SELECT * FROM VALUES {listed} AS t(run, __start, __end)")
            mine = rows.where(F.col("run").isin(sorted({s.run for s in recent})))
            parts.append(_valid(mine, F.broadcast(stretch), ["run"], ts) if len(recent) > 1 else mine.where(within(rows, ts, [(recent[0].start, recent[0].end)])))
        if not parts:
            return None
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return found.drop("day", "run")

    def vacuum(self, fs: FeatureSet, keep_from: int, orphans_after: timedelta | None = None) -> list[str]:
        """Delete the files of runs that no version from `keep_from` on shows; returns the runs.

        A reader that has looked up version `keep_from` or a later one goes on undisturbed, and
        runs that are being written are left alone.  Older versions can no longer be read.
        `orphans_after`: files of runs that were never committed go too, once they are so old.
        """
        ledger, now = self.ledger(fs), time.time()
        visible = {s.run for s in ledger.segments(ledger.snapshot(keep_from))}
        entries = ledger.entries()
        committed = {e.run for e in entries}
        needed = visible | {e.run for e in entries if e.seq > keep_from}
        found = [f for part in ("*/day=*/run=*", "whole/run=*") for f in matching(self.spark, f"{self.folder(fs)}/{part}")]
        # a run that was committed meanwhile is neither known as committed nor old
        ledger.forget(keep_from, committed - needed)
        gone: set[str] = set()
        for path, changed in found:
            run = path.rpartition("run=")[2]
            old = orphans_after is not None and now - changed / 1000 > orphans_after.total_seconds()
            if run not in needed and (run in committed or old):
                delete(self.spark, path)
                gone.add(run)
        return sorted(gone)


def cut_to(segments: Sequence[Segment], spans: Sequence[Span]) -> list[Segment]:
    """The parts of segments that lie in one of some disjoint spans."""
    out = []
    for s in segments:
        for low, high in spans:
            start = s.start if low is None else max(s.start, low)
            end = s.end if high is None else min(s.end, high)
            if start < end:
                out.append(Segment(start, end, s.run, s.state))
    return out


def _valid(rows: DataFrame, stretches: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows in a stretch of their run; the stretches of a run do not overlap."""
    named = stretches.withColumnsRenamed({k: f"__{k}" for k in keys})
    inside = (F.col(ts) >= F.col("__start")) & (F.col(ts) < F.col("__end"))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"__{k}"))
    return rows.join(named, inside, "left_semi")
