"""The table that follows its files: what is cleaned, what is read, what a failure leaves."""

from __future__ import annotations

import os
import random

import pytest
from conftest import tuples

from airq.sources import snapshots, tables
from airq.sources.readings import clean_readings
from inspect_plans import final_plan

HEADER = "date,state,area,number_of_monitoring_stations,prominent_pollutants,aqi_value,air_quality_status"


def write(folder, name, rows):
    path = folder / name
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    # Times of files count to the millisecond; tests may rewrite faster.
    write.clock += 5
    os.utime(path, (write.clock, write.clock))


write.clock = 1_700_000_000


def lines(rng, n, tag):
    return [f"{rng.randint(1, 28)}-{rng.randint(1, 12)}-{rng.randint(2021, 2024)},State {rng.randint(0, 5)},{tag},1,PM10,{rng.randint(0, 500)},Good"
            for _ in range(n)]


class Spy:
    """Cleans, and notes which files it was given."""

    def __init__(self):
        self.files = []

    def __call__(self, spark, paths):
        self.files.append(sorted(os.path.basename(p) for p in paths))
        return clean_readings(spark, paths)


def same_as_a_full_clean(spark, table, folder):
    got = snapshots.load_snapshot(spark, table)
    want = clean_readings(spark, str(folder))
    assert got.schema == want.schema
    assert sorted(tuples(got), key=str) == sorted(tuples(want), key=str)
    return got


def test_only_new_and_replaced_files_are_cleaned(spark, tmp_path):
    rng, folder, table, spy = random.Random(1), tmp_path / "in put%20", str(tmp_path / "table"), Spy()
    folder.mkdir()
    for name in ("a.csv", "b ü.csv", "c.csv"):
        write(folder, name, lines(rng, 40, name))
    assert snapshots.refresh(spark, table, [str(folder)], spy) == 1
    first = same_as_a_full_clean(spark, table, folder)
    assert snapshots.refresh(spark, table, [str(folder)], spy) == 1 and len(spy.files) == 1

    old = sorted(tuples(first), key=str)
    write(folder, "d.csv", lines(rng, 30, "d"))
    write(folder, "b ü.csv", lines(rng, 20, "b2"))
    os.remove(folder / "c.csv")
    states = {os.path.basename(r.path or "c.csv"): r.state for r in snapshots.changes(spark, table, [str(folder)]).collect()}
    assert states == {"a.csv": "same", "b ü.csv": "replaced", "c.csv": "removed", "d.csv": "new"}
    assert snapshots.refresh(spark, table, [str(folder)], spy) == 2
    assert spy.files == [["a.csv", "b ü.csv", "c.csv"], ["b ü.csv", "d.csv"]]
    same_as_a_full_clean(spark, table, folder)
    # Readers of the old snapshot are not disturbed.
    assert sorted(tuples(first), key=str) == old == sorted(tuples(snapshots.load_snapshot(spark, table, 1)), key=str)
    live = snapshots.manifest(spark, table).filter("live")
    assert live.count() == 3 and live.select("source").distinct().count() == 3


def test_batches_are_put_together_when_many_rows_are_dead(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_BATCHES", 3)
    rng, table, spy = random.Random(2), str(tmp_path / "table"), Spy()
    folder = tmp_path / "input"
    folder.mkdir()
    for step in range(7):
        for name in rng.sample("abcdef", 2):
            write(folder, name, lines(rng, 10, f"{name}{step}"))
        if step % 3 == 2:
            os.remove(folder / sorted(os.listdir(folder))[0])
        snapshots.refresh(spark, table, [str(folder)], spy)
        same_as_a_full_clean(spark, table, folder)
        assert snapshots.manifest(spark, table).select("batch").distinct().count() <= 3
    assert all(len(files) <= 2 for files in spy.files)


def test_a_failed_or_slower_refresh_changes_nothing(spark, tmp_path):
    rng, folder, table = random.Random(3), tmp_path / "input", str(tmp_path / "table")
    folder.mkdir()
    write(folder, "a", lines(rng, 10, "a"))
    snapshots.refresh(spark, table, [str(folder)])
    write(folder, "b", lines(rng, 10, "b"))

    def broken(spark, paths):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        snapshots.refresh(spark, table, [str(folder)], broken)
    assert snapshots.load_snapshot(spark, table).count() == 10

    def slow(spark, paths):  # another refresh gets in between
        snapshots.refresh(spark, table, [str(folder)])
        return clean_readings(spark, paths)

    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.refresh(spark, table, [str(folder)], slow)
    assert snapshots._newest(spark, table)[0] == 2
    same_as_a_full_clean(spark, table, folder)
    # A version that is still being written does not count yet.
    (tmp_path / "table/versions/00000003").write_text("")
    assert snapshots._newest(spark, table)[0] == 2


def test_tables_without_files(spark, tmp_path):
    folder, table = tmp_path / "input", str(tmp_path / "table")
    folder.mkdir()
    with pytest.raises(ValueError, match="no input files"):
        snapshots.refresh(spark, table, [str(folder)])
    with pytest.raises(ValueError, match="no version"):
        snapshots.load_snapshot(spark, table)
    write(folder, "a", lines(random.Random(4), 10, "a"))
    snapshots.refresh(spark, table, [str(folder)])
    os.remove(folder / "a")
    assert snapshots.refresh(spark, table, [str(folder), str(tmp_path / "absent")]) == 2
    assert tuples(snapshots.load_snapshot(spark, table)) == []


def test_a_batch_without_dead_files_is_read_plainly(spark, tmp_path):
    folder, table = tmp_path / "input", str(tmp_path / "table")
    folder.mkdir()
    for name in "abc":
        write(folder, name, lines(random.Random(5), 30, name))
    snapshots.refresh(spark, table, [str(folder)])
    plan = "\n".join(final_plan(snapshots.load_snapshot(spark, table).filter("year = 2022").select("aqi_value")))
    assert snapshots.SOURCE not in plan and "PartitionFilters: [isnotnull(year" in plan
    write(folder, "a", lines(random.Random(6), 30, "a"))
    snapshots.refresh(spark, table, [str(folder)])
    scans = [line for line in final_plan(snapshots.load_snapshot(spark, table)) if line.startswith("FileScan")]
    assert len(scans) == 2 and "UDF" not in "".join(scans)


def test_the_second_delivery_reads_only_what_it_brought(spark, tmp_path, monkeypatch):
    seen, plain = [], tables.refresh

    def spy(spark, table, paths):
        return plain(spark, table, paths, lambda s, files: (seen.append({f.split("/")[-2] for f in files}), clean_readings(s, files))[1])

    monkeypatch.setattr(tables, "refresh", spy)
    assert tables.deliver(spark, "/root/testdata/sf0.001", str(tmp_path)) == [1, 2]
    # The withdrawn folder has a new file without records.
    assert seen == [{f"delivery={i}" for i in found} for found in ((0, 1, 3, 9), (1, 2, 9))]
