"""Two hops over a staging table, load history, a stateful latest table, start from now, observed counts."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from fixtures import FIRST, MASTER, SECOND, T0, poll, write_array
from stationflow.operators import status
from stationflow.sources import loads, readers
from stationflow.streaming import staging
from stationflow.streaming.latest import LatestTable, start_latest
from stationflow.streaming.state import StateStore, start_state_refresh

FILES = [
    [poll(1, 5, 10, T0), poll(2, 1, 10, T0), poll(None, 1, 1, T0)],
    [poll(1, 6, 9, T0 + 60), poll(3, 2, 2, T0 + 60), poll(2, -1, 4, T0 - 60)],
    [poll(2, 3, 8, T0 + 120), poll(1, 7, 8, T0 + 120), poll("abc", 1, 8, T0)],
]


def ended(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


@pytest.fixture()
def at(tmp_dir):
    return lambda *names: os.path.join(tmp_dir, *names)


def hop1(spark, at):
    feed = readers.stream_status_json(spark, at("landing"), max_files_per_trigger=1)
    return ended(staging.start_staging(staging.counted(feed), at("staging"), at("hop1"), available_now=True))


def hop2(spark, at, master):
    rows = staging.stream_staging(spark, at("staging"), 1)
    ended(start_state_refresh(rows, master, at("state"), at("hop2"), available_now=True, order="event_time"))
    return StateStore(spark, at("state"))


def snap(df):
    return sorted(tuple(r) for r in df.select("STATION_ID", "NUM_BIKES_AVAILABLE", "LAST_REPORTED").collect())


def master(spark, at):
    write_array(at("master"), "stations_m.json", MASTER)
    return readers.read_master_json(spark, at("master"))


def test_a_crash_between_the_hops_loses_and_repeats_nothing(spark, at):
    m = master(spark, at)
    for i in (0, 1):
        write_array(at("landing"), f"stations_{i}.json", FILES[i], mtime=1_700_000_000 + i)
    q = hop1(spark, at)
    assert staging.observed(q) == {"processed": 6, "rejected": 1, "invalid": 1}
    # The first hop breaks after it has written the files of its last batch, before it lists them.
    os.remove(at("staging", "_spark_metadata", "1"))
    for name in ("1", ".1.crc"):
        if os.path.exists(at("hop1", "commits", name)):
            os.remove(at("hop1", "commits", name))
    if os.path.exists(at("staging", "_spark_metadata", ".1.crc")):
        os.remove(at("staging", "_spark_metadata", ".1.crc"))
    assert snap(hop2(spark, at, m).read()) == [(1, 5, T0), (2, 1, T0)]  # what is listed, not what lies there
    write_array(at("landing"), "stations_2.json", FILES[2], mtime=1_700_000_010)
    hop1(spark, at)
    assert spark.read.parquet(at("staging")).count() == 9  # the broken batch's files are there twice, its rows once
    store = hop2(spark, at, m)
    whole = status.current_state(readers.read_status_json(spark, at("landing")), m)
    assert snap(store.read()) == snap(whole) == [(1, 7, T0 + 120), (2, 3, T0 + 120), (3, 2, T0 + 60)]
    versions = store.latest_version()
    assert snap(hop2(spark, at, m).read()) == snap(whole) and store.latest_version() == versions


def test_the_second_hop_may_start_first(spark, at):
    m = master(spark, at)
    assert hop2(spark, at, m).read() is None
    write_array(at("landing"), "stations_0.json", FILES[0])
    hop1(spark, at)
    assert len(snap(hop2(spark, at, m).read())) == 2


def test_start_from_now(spark, at):
    m = master(spark, at)
    for i in (0, 1):
        write_array(at("landing"), f"stations_{i}.json", FILES[i], mtime=1_700_000_000 + i)

    def run(start="now"):
        src = readers.stream_status_json(spark, at("landing"), max_files_per_trigger=1)
        ended(start_state_refresh(src, m, at("state"), at("ckpt"), available_now=True, start=start))
        return StateStore(spark, at("state"))

    assert run().read() is None
    write_array(at("landing"), "stations_2.json", FILES[2], mtime=1_700_000_010)
    assert snap(run().read()) == [(1, 7, T0 + 120), (2, 3, T0 + 120)]
    write_array(at("landing"), "stations_3.json", [poll(9, 1, 1, T0)], mtime=1_700_000_020)
    assert len(snap(run().read())) == 3  # the position is kept, not set anew
    with pytest.raises(ValueError):
        run("later")


def test_a_broken_start_from_now_is_finished(spark, at):
    m = master(spark, at)
    write_array(at("landing"), "stations_0.json", FILES[0], mtime=1_700_000_000)
    src = lambda: readers.stream_status_json(spark, at("landing"))
    staging.mark_present(src(), at("ckpt"))
    for name in ("0", ".0.crc"):  # it broke before the empty batch was committed
        if os.path.exists(at("ckpt", "commits", name)):
            os.remove(at("ckpt", "commits", name))
    ended(start_state_refresh(src(), m, at("state"), at("ckpt"), available_now=True, start="now"))
    assert StateStore(spark, at("state")).read() is None


def test_load_history(spark, at):
    table = loads.LoadedTable(spark, at("table"))
    assert table.rows().count() == 0 and table.history().count() == 0
    write_array(at("landing"), "stations_1.json", FIRST, mtime=1_700_000_000)
    write_array(at("landing"), "stations_0.json", [], mtime=1_700_000_000)  # a file without rows is loaded too
    assert table.load(at("landing")) == 2 and table.rows().count() == 6
    assert table.load(at("landing")) == 0 and table.rows().count() == 6
    write_array(at("landing"), "stations_2.json", SECOND, mtime=1_700_000_005)
    write_array(at("landing"), "stations_1.json", FIRST[:2], mtime=1_700_000_009)
    status_of = {os.path.basename(r.FILE_PATH): r.STATUS for r in table.pending(at("landing")).collect()}
    assert status_of == {"stations_0.json": "loaded", "stations_1.json": "changed", "stations_2.json": "new"}
    with pytest.raises(ValueError, match="stations_1"):
        table.load(at("landing"), changed="error")
    assert table.load(at("landing"), changed="skip") == 1 and table.rows().count() == 8
    assert table.load(at("landing")) == 1 and table.rows().count() == 10
    got = sorted((r.LOAD_ID, os.path.basename(r.FILE_PATH), r.STATUS, r.N_ROWS) for r in table.history().collect())
    assert got == [(0, "stations_0.json", "new", 0), (0, "stations_1.json", "new", 6), (1, "stations_2.json", "new", 2), (2, "stations_1.json", "changed", 2)]
    assert table.rows().where("LOAD_ID = 2").select("SOURCE_FILE").distinct().count() == 1


def test_a_broken_load_leaves_nothing(spark, at, monkeypatch):
    table = loads.LoadedTable(spark, at("table"))
    write_array(at("landing"), "stations_1.json", FIRST)
    monkeypatch.setattr(table.log, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.load(at("landing"))
    monkeypatch.undo()
    assert table.rows().count() == 0 and table.history().count() == 0
    assert table.load(at("landing")) == 1 and table.rows().count() == 6


def test_history_is_folded(spark, at, monkeypatch):
    monkeypatch.setattr(loads, "FOLD", 2)
    table = loads.LoadedTable(spark, at("table"))
    for i in range(5):
        write_array(at("landing"), f"stations_{i}.json", [poll(i, 1, 1, T0)], mtime=1_700_000_000 + i)
        assert table.load(at("landing")) == 1
    assert table.history().count() == table.rows().count() == 5 and table.load(at("landing")) == 0


def test_latest_table_over_batches_and_a_restart(spark, at):
    rows = [(i % 50, (i * 37) % 1000, i) for i in range(2000)] + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "STATION_ID long, LAST_REPORTED long, V long")
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at("in"))
    for part in (0, 1):
        df.where(F.coalesce(F.col("V") % 2, F.lit(0)) == part).repartition(3).write.mode("append").parquet(at("in"))
        ended(start_latest(source(), at("latest"), at("ckpt"), ("LAST_REPORTED", "V"), available_now=True))
    table = LatestTable(spark, at("latest"))
    best = {}
    for s, t, v in rows:
        if s is not None:
            best[s] = max(best.get(s, (-1, -1)), (t, v))
    found = lambda: {r.STATION_ID: (r.LAST_REPORTED, r.V) for r in table.read().collect()}
    assert found() == best and len(table.log.entries()) == 6
    # A batch that comes again changes nothing, nor does folding, and the fold stands for what came before.
    first = table.log.entries()[0][1]
    table.append(df, first["query"], first["batch"])
    table.fold()
    assert found() == best and len(table._parts()) == 1
    shutil.rmtree(at("latest", table.log.entries()[0][1]["path"]))
    assert found() == best


def test_an_unchanged_station_stays_in_the_operator(spark, at):
    schema = "STATION_ID long, LAST_REPORTED long"
    for part in ([(i, 100) for i in range(30)], [(3, 200), (4, 50)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at("in"))
        ended(start_latest(spark.readStream.schema(schema).parquet(at("in")), at("latest"), at("ckpt"), available_now=True))
    table = LatestTable(spark, at("latest"))
    assert [table.log.frame(e).count() for _, e in table.log.entries()] == [30, 2]
    assert {r.STATION_ID: r.LAST_REPORTED for r in table.read().where("STATION_ID in (3, 4, 5)").collect()} == {3: 200, 4: 100, 5: 100}
