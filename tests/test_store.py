"""The ledger of the store: commits, index, old versions, removal; single files."""

import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from helpers import at, plan, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

import hindsight as hs
from hindsight.sources import files
from hindsight.sources import ledger as module
from hindsight.sources.ledger import Entry, Ledger, Segment, joined, spliced
from hindsight.spec.model import Column

DAY = timedelta(days=1)


def feature_set(path):
    return hs.FeatureSet("f", "1", hs.Source(path, "t"), (Column("k", "long"),))


@pytest.fixture
def source(spark, tmp_path):
    """Each row says which version of the source it is of."""
    def write(version):
        path = str(tmp_path / f"source{version}")
        table(spark, "k long, t timestamp, v long", [(i % 3, at(hours=6 * i), version) for i in range(40)]).write.parquet(path)
        return feature_set(path)

    return write


@pytest.fixture
def store(spark, tmp_path):
    return hs.OfflineStore(spark, str(tmp_path / "store"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=25))
def test_later_windows_win(windows):
    runs = [(datetime(2024, 1, 1 + a), datetime(2024, 1, 1 + a) + timedelta(hours=12 * n), f"r{i}") for i, (a, n) in enumerate(windows)]
    pieces = spliced([], [Entry(a, b, r, False, i) for i, (a, b, r) in enumerate(runs)])
    assert all(p.start < p.end for p in pieces) and all(p.end <= q.start for p, q in zip(pieces, pieces[1:]))
    for half in range(100):
        moment = datetime(2024, 1, 1) + timedelta(hours=12 * half)
        last = next((r for a, b, r in reversed(runs) if a <= moment < b), None)
        assert [p.run for p in pieces if p.start <= moment < p.end] == ([last] if last else [])
    covered = joined((p.start, p.end) for p in pieces)
    assert all(p[1] < q[0] for p, q in zip(covered, covered[1:]))


def test_writers_with_one_base_both_land(spark, tmp_path, monkeypatch):
    """All see the same entries before any commits; the order is the same for everyone."""
    ledger = Ledger(spark, str(tmp_path))
    ledger.commit("r0", at(), at(days=1))
    seen = ledger._numbers()
    monkeypatch.setattr(Ledger, "_numbers", lambda self: seen)
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: ledger.commit(f"r{i}", at(), at(days=i)), range(1, 9)))
    monkeypatch.undo()
    assert sorted(numbers) == list(range(2, 10))
    by_number = {n: f"r{i}" for i, n in enumerate(numbers, 1)}
    assert [e.run for e in ledger.entries()] == ["r0", *[by_number[n] for n in sorted(numbers)]]
    assert ledger.segments(ledger.snapshot()) == spliced([], ledger.entries())


def test_index_gives_the_same_rows_in_plans_of_one_size(spark, store, source, monkeypatch):
    monkeypatch.setattr(module, "INDEX_EVERY", 4)
    sizes, reads = [], []
    known = {}
    for i in range(1, 11):
        fs = source(i)
        start = at(days=(i * 3) % 8)
        hs.backfill(fs, start, start + timedelta(hours=30), store)
        for r in range(40):
            if start <= at(hours=6 * r) < start + timedelta(hours=30):
                known[r] = (r % 3, at(hours=6 * r), i)
        assert rows(store.read(fs)) == sorted(known.values(), key=repr)
        part = store.read(fs, (at(days=2), at(days=3)))
        assert ([] if part is None else rows(part)) == sorted((v for r, v in known.items() if 8 <= r < 12), key=repr)
        sizes.append(len(re.sub(r"[0-9a-f]{32}|\d+", "", plan(store.read(fs)))))  # without names and numbers
        counted = []
        with monkeypatch.context() as patch:
            patch.setattr(module, "read_file", lambda spark, path: counted.append(path) or files.read_file(spark, path))
            store.snapshot(fs)
        reads.append(len(counted))
    assert max(reads) <= 4 and reads[3] == reads[7] == 1
    # as many entries after the index: plans of one size, but for how times are written
    assert abs(sizes[4] - sizes[8]) < 0.02 * sizes[4] and abs(sizes[5] - sizes[9]) < 0.02 * sizes[5]
    text = plan(store.read(fs))
    assert "dynamicpruning" in text, "files of other days and runs are not opened"


def test_two_thousand_windows(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path))
    monkeypatch.setattr(module, "INDEX_EVERY", 10**9)
    for i in range(2000):
        if i == 1990:
            monkeypatch.setattr(module, "INDEX_EVERY", 1990)
            ledger.compact()
            monkeypatch.setattr(module, "INDEX_EVERY", 10**9)
        ledger.commit(f"r{i}", at(hours=3 * i), at(hours=3 * i + 3))
    counted = []
    monkeypatch.setattr(module, "read_file", lambda spark, path: counted.append(path) or files.read_file(spark, path))
    snapshot = ledger.snapshot()
    assert len(counted) == 11 and snapshot.covered == [(at(), at(hours=6000))]
    assert ledger.segments(snapshot) == [Segment(at(hours=3 * i), at(hours=3 * i + 3), f"r{i}") for i in range(2000)]
    assert ledger.stretches(snapshot).count() == 1990


def test_old_versions_and_removal(spark, store, source, monkeypatch):
    monkeypatch.setattr(module, "INDEX_EVERY", 3)
    first, second = source(1), source(2)
    hs.backfill(first, at(), at(days=4), store)              # 1
    hs.backfill(second, at(days=1), at(days=2), store)       # 2
    hs.backfill(second, at(days=1), at(days=2), store)       # 3, replaces 2
    hs.backfill(second, at(), at(days=4), store)             # 4, replaces all
    versions = {v: rows(store.read(first, snapshot=store.snapshot(first, v))) for v in (1, 2, 3, 4)}
    assert {r[2] for r in versions[1]} == {1} and {r[2] for r in versions[2]} == {1, 2} and {r[2] for r in versions[4]} == {2}
    with pytest.raises(ValueError, match="no version 5"):
        store.snapshot(first, 5)

    in_flight = store.read(first, snapshot=store.snapshot(first, 3))
    assert len(store.vacuum(first, keep_from=3)) == 1  # the second run
    assert rows(in_flight) == versions[3]
    for v in (3, 4):
        assert rows(store.read(first, snapshot=store.snapshot(first, v))) == versions[v]
    with pytest.raises(ValueError, match="was removed"):
        store.snapshot(first, 2)
    assert store.vacuum(first, keep_from=3) == []
    assert len(store.vacuum(first, keep_from=4)) == 2
    assert rows(store.read(first)) == versions[4]
    hs.backfill(first, at(), at(days=1), store)
    assert {r[2] for r in rows(store.read(first))} == {1, 2}


def test_removal_of_runs_that_were_never_committed(spark, store, source, monkeypatch):
    fs = source(1)
    hs.backfill(fs, at(), at(days=1), store)
    wanted = rows(store.read(fs))
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda *_: None)
        hs.backfill(fs, at(), at(days=2), store)
    assert store.vacuum(fs, 1) == [] == store.vacuum(fs, 1, orphans_after=timedelta(hours=1))
    assert len(store.vacuum(fs, 1, orphans_after=timedelta(0))) == 1
    assert rows(store.read(fs)) == wanted


@pytest.mark.parametrize("local", [True, False])
def test_single_files(spark, tmp_path, monkeypatch, local):
    """By Python on a local disk, by Hadoop's interfaces elsewhere."""
    if not local:
        place = files._Place.__init__
        monkeypatch.setattr(files._Place, "__init__", lambda self, *a: place(self, *a) or setattr(self, "local", None) or self._open(spark))
    path = f"{tmp_path}/folder/a.json"
    assert files.names_in(spark, f"{tmp_path}/folder") == []
    assert files.create_file(spark, path, "né") and not files.create_file(spark, path, "two")
    assert files.read_file(spark, path) == "né"
    files.replace_file(spark, path, "three\nlines\n")
    files.replace_file(spark, f"{tmp_path}/folder/b", "")
    assert files.read_file(spark, path) == "three\nlines\n" and files.read_file(spark, f"{tmp_path}/folder/b") == ""
    assert files.names_in(spark, f"{tmp_path}/folder") == ["a.json", "b"]
    assert [p.rpartition("/")[2] for p, _ in files.matching(spark, f"{tmp_path}/*/*.json")] == ["a.json"]
    files.delete(spark, path)
    assert files.names_in(spark, f"{tmp_path}/folder") == ["b"]
