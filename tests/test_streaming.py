"""Incremental state: stream equals batch, restart, replay, late data."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fixtures import FIRST, MASTER, SECOND, T0, poll, write_array
from stationflow.operators import status
from stationflow.sources import readers, sinks
from stationflow.streaming.commits import CommitLog
from stationflow.streaming.state import StateStore, refresh_state, start_state_refresh


def _master(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "master"), "stations_m.json", MASTER)
    return readers.read_master_json(spark, os.path.join(tmp_dir, "master"))


def _run(spark, land, master, root, **kw):
    src = readers.stream_status_json(spark, land, max_files_per_trigger=1, **kw)
    q = start_state_refresh(src, master, os.path.join(root, "state"), os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination()
    assert q.exception() is None
    return StateStore(spark, os.path.join(root, "state"))


def _snap(df):
    cols = ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE", "LAST_REPORTED", "STATION_NAME"]
    return sorted(tuple(r) for r in df.select(cols).collect())


def test_stream_equals_batch_and_restart(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    files = [
        [poll(1, 5, 10, T0), poll(2, 1, 10, T0)],
        [poll(1, 6, 9, T0 + 60), poll(3, 2, 2, T0 + 60)],
        [poll(2, 3, 8, T0 + 120), poll(1, 7, 8, T0 + 120)],
    ]
    for i, objs in enumerate(files[:2]):
        write_array(land, f"stations_{i}.json", objs, mtime=1_700_000_000 + i)
    m = _master(spark, tmp_dir)
    root = os.path.join(tmp_dir, "run")
    store = _run(spark, land, m, root)
    assert store.latest_version() == 1  # one micro-batch per file

    # restart on the same checkpoint: only the new file is taken
    write_array(land, "stations_2.json", files[2], mtime=1_700_000_010)
    store = _run(spark, land, m, root)
    assert store.latest_version() == 2

    batch = status.current_state(readers.read_status_json(spark, land), m)
    assert _snap(store.read()) == _snap(batch)


def _two(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "a"), "stations_a.json", FIRST)
    write_array(os.path.join(tmp_dir, "b"), "stations_b.json", SECOND)
    return [readers.read_status_json(spark, os.path.join(tmp_dir, x)) for x in "ab"]


def test_replay_changes_nothing(spark, tmp_dir):
    m = _master(spark, tmp_dir)
    a, b = _two(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    assert refresh_state(a, 0, store, m) == "Processed 6 rows"
    assert refresh_state(b, 1, store, m) == "Processed 2 rows"
    once, files = _snap(store.read()), store.commits()
    assert refresh_state(b, 1, store, m) == "Processed 2 rows"  # replay after a crash
    assert _snap(store.read()) == once and store.commits() == files
    assert {r.STATION_ID for r in store.read().collect()} == {1, 2, 3, 4}  # NULL / bad ids dropped
    assert len(store.read().columns) == 19


def test_a_failed_attempt_leaves_the_state_as_it_is(spark, tmp_dir):
    m = _master(spark, tmp_dir)
    a, b = _two(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    refresh_state(a, 0, store, m)
    before = _snap(store.read())
    with pytest.raises(Exception):
        refresh_state(b.withColumn("NUM_BIKES_AVAILABLE", F.raise_error(F.lit("lost")).cast("long")), 1, store, m)
    assert _snap(store.read()) == before and store.latest_version() == 0
    refresh_state(b, 1, store, m)
    assert store.latest_version() == 1 and store.read().count() == 4


def test_a_new_query_goes_on_behind_the_old_one(spark, tmp_dir):
    m = _master(spark, tmp_dir)
    a, b = _two(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    for i in range(3):
        refresh_state(a, i, store, m, query="old")
    refresh_state(b, 0, store, m, query="new")  # a reset checkpoint numbers from 0 again
    assert store.latest_version() == 3
    assert {r.STATION_ID for r in store.read().collect()} == {1, 2, 3, 4}


def test_old_versions_and_attempts_go(spark, tmp_dir):
    m = _master(spark, tmp_dir)
    a, _ = _two(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"), keep=2)
    for i in range(5):
        refresh_state(a, i, store, m)
    assert [c.sequence for c in store.commits()] == [3, 4] and len(store.log._names("data")) == 2
    assert store.read(version=3).count() == 3
    with pytest.raises(Exception):
        store.read(version=0)


@pytest.mark.parametrize("left", ["", "{", '{"query": "b'])
def test_a_torn_commit_is_passed_over(spark, tmp_dir, left):
    m = _master(spark, tmp_dir)
    a, b = _two(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    refresh_state(a, 0, store, m)
    before = _snap(store.read())
    with open(os.path.join(tmp_dir, "state", "_commits", "000000000001"), "w") as f:
        f.write(left)
    assert _snap(store.read()) == before and store.latest_version() == 0
    assert refresh_state(b, 1, store, m) == "Processed 2 rows"
    assert store.latest_version() == 2 and {r.STATION_ID for r in store.read().collect()} == {1, 2, 3, 4}


def test_of_two_writers_of_a_version_the_second_fails(spark, tmp_dir):
    log = CommitLog(spark, os.path.join(tmp_dir, "log"))
    log.write(spark.range(1), rows=1)
    with pytest.raises(Exception):
        log.publish(0, {"path": "elsewhere"})
    assert [e["rows"] for _, e in log.entries()] == [1]
    assert [n for n in os.listdir(os.path.join(tmp_dir, "log", "_commits")) if not n.endswith(".crc")] == ["000000000000"]
    with pytest.raises(ValueError, match="exclusive"):
        _Foreign(spark, "s3a://bucket/x")


class _Foreign(CommitLog):
    """A log on a file system that isn't there to be asked."""

    def _path(self, name):
        return None, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")


def test_master_is_read_anew_and_reduced(spark, tmp_dir):
    a, b = _two(spark, tmp_dir)
    folder = os.path.join(tmp_dir, "masters")
    write_array(folder, "stations_1.json", MASTER)
    read = lambda: readers.read_master_json(spark, folder)
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    refresh_state(a, 0, store, read)
    write_array(folder, "stations_2.json", [{"station_id": 4, "name": "new", "capacity": 14}, dict(MASTER[0], name="renamed")])
    refresh_state(b, 1, store, read)
    rows = {r.STATION_ID: r for r in store.read().collect()}
    assert len(rows) == store.read().count() == 4
    assert (rows[4].STATION_NAME, str(rows[4].OCCUPATION_RATIO), rows[1].STATION_NAME) == ("new", "0.5000", "renamed")


def test_a_bad_row_fails_no_batch(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "a"), "stations_a.json", [poll(1, 5, 10, 10**17), poll(2, 10**12, 1, T0), poll(3, 1, 1, T0)])
    m = spark.createDataFrame([(2, "s", None, None, 1), (3, "t", None, None, 0)], "STATION_ID long, STATION_NAME string, LAT decimal(12,7), LON decimal(12,7), CAPACITY long")
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    refresh_state(readers.read_status_json(spark, os.path.join(tmp_dir, "a")), 0, store, m)
    rows = {r.STATION_ID: r for r in store.read().collect()}
    assert rows[1].LAST_REPORTED_TST is None and rows[2].OCCUPATION_RATIO is None and rows[3].OCCUPATION_RATIO is None


def test_late_data_orders(spark, tmp_dir):
    m = _master(spark, tmp_dir)
    write_array(os.path.join(tmp_dir, "a"), "stations_a.json", FIRST)
    write_array(os.path.join(tmp_dir, "b"), "stations_b.json", SECOND)
    a = readers.read_status_json(spark, os.path.join(tmp_dir, "a"))
    b = readers.read_status_json(spark, os.path.join(tmp_dir, "b"))
    arrival = StateStore(spark, os.path.join(tmp_dir, "arrival"))
    event = StateStore(spark, os.path.join(tmp_dir, "event"))
    for i, batch in enumerate((a, b)):
        refresh_state(batch, i, arrival, m, order="arrival")
        refresh_state(batch, i, event, m, order="event_time")
    one_arrival = [r for r in arrival.read().collect() if r.STATION_ID == 1][0]
    one_event = [r for r in event.read().collect() if r.STATION_ID == 1][0]
    assert one_arrival.LAST_REPORTED == T0 - 600  # the later file wins although older
    assert one_event.LAST_REPORTED == T0 + 60  # the newer report is kept
    assert arrival.read(version=0).count() == 3 and arrival.read().count() == 4


def _files(folder):
    return sorted(f for _, _, names in os.walk(folder) for f in names if f.endswith(".json"))


def test_clean_source_archive(spark, tmp_dir):
    land, archive, name = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "archive"), "spark.sql.streaming.fileSource.cleaner.numThreads"
    m = _master(spark, tmp_dir)
    run = lambda: _run(spark, land, m, os.path.join(tmp_dir, "run"), clean_source="archive", archive_dir=archive)
    spark.conf.set(name, "0")  # files move before the next batch begins
    try:
        for i in range(3):
            write_array(land, f"stations_{i}.json", [poll(1, 5 + i, 10, T0 + 60 * i)], mtime=1_700_000_000 + i)
        store = run()
        # A batch's files are archived once the next one has been planned: all but the last one's.
        assert _files(archive) == ["stations_0.json", "stations_1.json"] and _files(land) == ["stations_2.json"]
        write_array(land, "stations_3.json", [poll(1, 9, 9, T0 + 600)], mtime=1_700_000_010)
        write_array(land, "other.json", [poll(1, 9, 9, T0 + 600)])  # not the stream's
        store = run()
        assert _files(archive) == ["stations_0.json", "stations_1.json", "stations_2.json"] and _files(land) == ["other.json", "stations_3.json"]
        assert [r.NUM_BIKES_AVAILABLE for r in store.read().collect()] == [9]
        # Nothing is lost on the way: archive and landing zone hold every poll once.
        kept = [readers.read_status_json(spark, p).count() for p in (os.path.join(archive, land.lstrip("/")), land)]
        assert kept == [3, 1]
    finally:
        spark.conf.unset(name)


def test_a_timer_runs_when_there_are_files_and_only_then(spark, tmp_dir):
    land, root = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "run")
    os.makedirs(land)
    m = _master(spark, tmp_dir)
    q = start_state_refresh(readers.stream_status_json(spark, land), m, f"{root}/state", f"{root}/ckpt", processing_time="500 milliseconds")
    store = StateStore(spark, f"{root}/state")

    def wait(version):
        until = time.time() + 60
        while store.latest_version() != version and time.time() < until:
            time.sleep(0.2)
        return store.latest_version()

    try:
        time.sleep(2)
        assert store.latest_version() is None  # C8: no files, no refresh
        for i in range(2):
            write_array(tmp_dir, f"made_{i}.json", [poll(1, 5 + i, 10, T0 + i)])
            os.rename(os.path.join(tmp_dir, f"made_{i}.json"), os.path.join(land, f"stations_{i}.json"))
            assert wait(i) == i
            time.sleep(2)
            assert store.latest_version() == i
    finally:
        q.stop()
    assert [r.NUM_BIKES_AVAILABLE for r in store.read().collect()] == [6]


def test_same_report_time_later_file_wins(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    write_array(land, "stations_20240101_100000.json", [poll(1, 5, 10, T0)], mtime=1_700_000_000)
    write_array(land, "stations_20240101_100500.json", [poll(1, 8, 7, T0)], mtime=1_700_000_001)
    m = _master(spark, tmp_dir)
    src = readers.stream_status_json(spark, land)  # both files in one micro-batch
    root = os.path.join(tmp_dir, "run")
    q = start_state_refresh(src, m, os.path.join(root, "state"), os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination()
    row = StateStore(spark, os.path.join(root, "state")).read().collect()[0]
    assert row.NUM_BIKES_AVAILABLE == 8 and len(row) == 19


def _polls(spark, ids, at, bikes):
    rows = [(i, bikes, 3, at + i % 2) for i in ids]
    return spark.createDataFrame(rows, "STATION_ID long, NUM_BIKES_AVAILABLE long, NUM_DOCKS_AVAILABLE long, LAST_REPORTED long")


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_a_small_batch_does_not_rewrite_a_large_state(spark, tmp_dir, order):
    m = _master(spark, tmp_dir)
    store = StateStore(spark, os.path.join(tmp_dir, "state"), keep=2)
    want = {}
    batches = [(range(1000), T0, 1)] + [(range(7 * i, 7 * i + 5), T0 + (100 if i % 3 else -100), 10 + i) for i in range(9)] + [([], T0, 0), ([None, 8], T0 + 500, 40)]
    for n, (ids, at, bikes) in enumerate(batches):
        refresh_state(_polls(spark, [i for i in ids if i is not None], at, bikes), n, store, m, order_by=("LAST_REPORTED",), order=order)
        for i in ids:
            if i is not None and (order == "arrival" or i not in want or at + i % 2 >= want[i][0]):
                want[i] = (at + i % 2, bikes)
        if n > 1:  # the next batch is taken to be as large as the last one
            assert spark.read.parquet(f"{tmp_dir}/state/{store.latest().path}").count() <= 100  # it had written all 1,000 stations
    got = {r.STATION_ID: (r.LAST_REPORTED, r.NUM_BIKES_AVAILABLE) for r in store.read().collect()}
    assert got == want and store.read().count() == 1000 and len(store.read().columns) == 19
    assert store.read(version=len(batches) - 2).where("NUM_BIKES_AVAILABLE = 40").isEmpty()
    assert len(store.log._names("data")) <= 8  # parts that no kept version holds are gone
    # Another rule folds what was written by the old one.
    refresh_state(_polls(spark, [1], T0 - 900, 77), 99, store, m, order_by=("LAST_REPORTED",), order="event_time" if order == "arrival" else "arrival")
    now = {r.STATION_ID: (r.LAST_REPORTED, r.NUM_BIKES_AVAILABLE) for r in store.read().collect()}
    assert now == want | ({} if order == "arrival" else {1: (T0 - 899, 77)}) and store.latest().older == []


def test_a_refresh_sends_no_master_through_the_driver(spark, tmp_dir, monkeypatch):
    plans, write = [], StateStore.write
    monkeypatch.setattr(StateStore, "write", lambda self, df, *a, **kw: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, *a, **kw))[1])
    store = StateStore(spark, os.path.join(tmp_dir, "state"))
    for n in range(2):
        refresh_state(_polls(spark, range(20), T0, n), n, store, _master(spark, tmp_dir), order_by=("LAST_REPORTED",))
    assert len(plans) == 2 and all("Broadcast" not in p and "SortMergeJoin" in p for p in plans)


def test_a_snapshot_of_many_polls_is_few_files(spark, tmp_dir):
    # Batches are so many files, so files of a few thousand polls make a batch of every few thousand polls.
    sinks.write_snapshot_json(spark.range(120_000).coalesce(1).selectExpr("id as station_id"), tmp_dir, "20240101_100000")
    files = [f for _, _, names in os.walk(tmp_dir) for f in names if f.startswith("part-")]
    assert len(files) == 3 and readers.read_status_json(spark, tmp_dir).select("STATION_ID").distinct().count() == 120_000
