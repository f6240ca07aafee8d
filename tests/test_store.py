"""The stored table: where it goes, how it is laid out, when it is written."""

from __future__ import annotations

import os
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import tuples

from airq.plans import registry
from airq.sources import store, tables

SF = "/root/testdata/sf0.001"


def session(folder, master, checkpoints=None, default="file:///"):
    settings = {} if folder is None else {"spark.checkpoint.dir": folder}
    hadoop = SimpleNamespace(get={"fs.defaultFS": default}.get)
    return SimpleNamespace(
        conf=SimpleNamespace(get=settings.get),
        sparkContext=SimpleNamespace(
            master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoints,
            _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop)),
    )


@pytest.mark.parametrize("master", ["yarn", "local[8]"])
def test_where_the_folder_comes_from(master):
    assert store.work_folder(session("hdfs:///shared/", master)) == "hdfs:///shared"
    assert store.work_folder(session(None, master, "hdfs:///checkpoints")) == "hdfs:///checkpoints"
    assert store.work_folder(session("s3a://b", master), "s3a://mine/") == "s3a://mine"
    assert store.work_folder(session(None, master)) is None
    assert store.new_folder(session(None, master), "x") is None
    assert store.new_folder(session("s3a://b/c", master), "x").startswith("s3a://b/c/airq-app-1-")


def test_a_folder_of_each_machine_is_refused_on_a_cluster():
    assert store.work_folder(session("/shared", "local[8]")) == "/shared"
    assert store.work_folder(session("/shared", "yarn", default="hdfs://name")) == "/shared"
    with pytest.raises(ValueError, match="local to each machine"):
        store.work_folder(session("/tmp/checkpoints", "spark://host:7077"))


def test_a_plain_path_that_all_machines_share_serves_a_cluster(spark, tmp_path):
    def cluster(read, folder):
        made = session(str(folder), "spark://host:7077")
        made.sparkContext.defaultParallelism, made.range, made.read = 2, spark.range, read
        return made

    class Lossy:
        """Reads as on a cluster where one machine's files are out of reach."""

        schema = staticmethod(lambda ddl: Lossy)
        parquet = staticmethod(lambda path: spark.read.parquet(path).filter("id > 1"))

    assert store.work_folder(cluster(spark.read, tmp_path / "a")) == str(tmp_path / "a")
    with pytest.raises(ValueError, match="local to each machine"):
        store.work_folder(cluster(Lossy, tmp_path / "b"))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local-cluster[3,2,3000]"])
def test_a_plain_path_serves_executors_on_one_machine(master):
    assert store.work_folder(session("/tmp/checkpoints", master)) == "/tmp/checkpoints"
    assert store.work_folder(session(None, master, "/tmp/checkpoints/")) == "/tmp/checkpoints"
    assert store.new_folder(session("/tmp/checkpoints", master), "x").startswith("/tmp/checkpoints/airq-app-1-")


def test_without_a_shared_folder_nothing_is_written(spark, monkeypatch):
    monkeypatch.setattr(store, "work_folder", lambda spark, folder=None: None)
    with pytest.warns(UserWarning, match="spark.checkpoint.dir"):
        assert store.stored(spark, "nothing", lambda: spark.range(3)).count() == 3


def test_written_once_and_anew_when_the_input_changes(spark, tmp_path):
    calls = []
    source = tmp_path / "input"
    source.mkdir()
    (source / "a").write_text("1")

    def build():
        calls.append(1)
        return tables.cleaned_readings(spark, SF)

    first, second = (store.stored(spark, "once", build, [str(source)]) for _ in range(2))
    assert len(calls) == 1 and first is second
    other = spark.newSession()
    third = store.stored(other, "once", build, [str(source)])
    assert len(calls) == 1 and third.sparkSession is other
    assert third.count() == first.count()
    want = tables.cleaned_readings(spark, SF)
    assert first.schema == want.schema
    assert sorted(tuples(first), key=str) == sorted(tuples(want), key=str)
    (source / "a").write_text("12")
    assert store.stored(spark, "once", build, [str(source)]) is not None and len(calls) == 1
    changed = store.stored(spark, "once", build, [str(source)], refresh=True)
    assert changed is not first and len(calls) == 2
    assert store.stored(spark, "once", build, [str(source)], refresh=True) is changed and len(calls) == 2


def test_later_queries_of_a_session_touch_no_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text("1")
    first = store.stored(spark, "quiet", lambda: tables.cleaned_readings(spark, SF), [str(tmp_path)])
    monkeypatch.setattr(store, "input_files", None)
    monkeypatch.setattr(store, "write_readings", None)
    assert store.stored(spark, "quiet", None, [str(tmp_path)]) is first


def test_a_copy_that_lost_files_is_written_anew(spark):
    def build():
        return tables.cleaned_readings(spark, SF)

    want = sorted(tuples(build()), key=str)
    copies = [store.stored(spark, "cleared", build)]
    for lost in (lambda path: [path], lambda path: [next(Path(path).rglob("part-*.parquet"))]):
        for gone in lost(store.stored_path(spark, "cleared").removeprefix("file://")):
            delete(spark, gone)
        copies.append(store.stored(spark, "cleared", build))
        assert copies[-1] is not copies[-2] and sorted(tuples(copies[-1]), key=str) == want
        assert store.stored(spark, "cleared", build) is copies[-1]


def delete(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    assert place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def test_queries_run_again_after_the_work_folder_was_cleared(spark, monkeypatch):
    for module, name in ((store, "_kept"), (tables, "_csv"), (registry, "_sums"), (registry, "_bitmaps"), (registry, "_clustered")):
        monkeypatch.setattr(module, name, {})
    base = Path(store.work_folder(spark).removeprefix("file://"))
    names = ["annual_summary", "clustered_slice", "footer_profile", "site_counts", "summary_rollup", "read_readings"]
    before = set(base.glob("airq-*"))
    want = {name: sorted(tuples(registry.queries()[name](spark, SF)), key=str) for name in names}
    for copy in set(base.glob("airq-*")) - before:
        delete(spark, copy)
    assert {name: sorted(tuples(registry.queries()[name](spark, SF)), key=str) for name in names} == want


def test_one_csv_copy_per_application(spark, tmp_path):
    for _ in range(2):
        tables.readings_through_csv(spark, SF, str(tmp_path))
    assert len([n for n in os.listdir(tmp_path) if n.startswith("airq-")]) <= 1


def test_files_follow_the_data_and_not_the_tasks(spark, tmp_path):
    path = str(tmp_path / "readings")
    many = tables.cleaned_readings(spark, SF).repartition(40)
    store.write_readings(many, path)
    years = [n for n in os.listdir(path) if n.startswith("year=")]
    files = [n for y in years for n in os.listdir(f"{path}/{y}") if n.endswith(".parquet")]
    assert len(files) <= 2 * len(years)


def test_one_folder_per_year_rows_sorted_by_state(spark, tmp_path):
    path = str(tmp_path / "readings")
    want = tables.cleaned_readings(spark, SF)
    store.write_readings(want, path)
    folders = {name for name in os.listdir(path) if name.startswith("year=")}
    assert "year=__HIVE_DEFAULT_PARTITION__" in folders and "year=1996" in folders
    for folder in folders:
        for name in os.listdir(f"{path}/{folder}"):
            if name.endswith(".parquet"):
                states = [r[0] for r in tuples(spark.read.parquet(f"{path}/{folder}/{name}").select("state"))]
                assert states == sorted(states)
    assert store.load_readings(spark, path, want.schema).columns == want.columns
