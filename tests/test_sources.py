"""Feed readers and sinks on hand-made files."""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import FIRST, MASTER, SECOND, T0, poll, write_array
from stationflow.operators import docks, status
from stationflow.sources import readers, sinks


def test_status_reader_types_and_rejects(spark, tmp_dir):
    write_array(tmp_dir, "stations_20240101_100000.json", FIRST)
    write_array(tmp_dir, "other.json", SECOND)  # not matched by stations*
    df = readers.read_status_json(spark, tmp_dir)
    assert [f.name for f in df.schema.fields][:3] == ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_BIKES_AVAILABLE_MECHANICAL"]
    rows = df.collect()
    assert len(rows) == 6
    ids = sorted([r.STATION_ID for r in rows], key=lambda x: (x is None, x))
    assert ids == [1, 1, 2, 3, None, None]
    r = [x for x in rows if x.STATION_ID == 1 and x.LAST_REPORTED == T0][0]
    assert (r.NUM_BIKES_AVAILABLE_MECHANICAL, r.NUM_BIKES_AVAILABLE_EBIKE, r.IS_CHARGING_STATION, r.TRAFFIC) == (4, 1, True, None)
    assert status.rejected_status(df).count() == 2
    latest = {x.STATION_ID: x for x in status.latest_per_station(df).collect()}
    assert latest[1].NUM_BIKES_AVAILABLE == 6 and set(latest) == {1, 2, 3}


def test_master_reader(spark, tmp_dir):
    write_array(tmp_dir, "stations_master.json", MASTER)
    m = {r.STATION_ID: r for r in readers.read_master_json(spark, tmp_dir).collect()}
    one = m[1]
    assert one.LAT == Decimal("48.1234568") and one.LON == Decimal("11.7654321")
    assert one.ALTITUDE == Decimal("17.00") and one.NEARBY_DISTANCE == Decimal("2.00")
    assert json.loads(one.RENTAL_URIS) == {"android": "https://a", "ios": "https://i"}
    assert one._RIDE_CODE_SUPPORT is False and m[2].CAPACITY == 0 and m[3].CAPACITY is None


def test_state_edges(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "s"), "stations_1.json", FIRST)
    write_array(os.path.join(tmp_dir, "m"), "stations_m.json", MASTER)
    st = readers.read_status_json(spark, os.path.join(tmp_dir, "s"))
    m = readers.read_master_json(spark, os.path.join(tmp_dir, "m"))
    state = {r.STATION_ID: r for r in status.current_state(st, m).collect()}
    assert str(state[1].OCCUPATION_RATIO) == "0.2000"  # 6 / 30
    assert state[2].OCCUPATION_RATIO is None  # capacity 0
    assert state[3].OCCUPATION_RATIO is None  # capacity missing
    assert str(state[1].LAST_REPORTED_TST) == "2024-01-01 10:01:00"
    b = {r.STATION_ID: r.BROKEN_DOCKS for r in docks.broken_docks(m, status.current_state(st, m)).collect()}
    assert b == {1: 15}  # 30 - (6 + 9); station 9 has no status and drops out


def test_envelope(spark, tmp_dir):
    path = os.path.join(tmp_dir, "payload.json")
    with open(path, "w") as f:
        json.dump({"data": {"stations": FIRST[:3]}}, f, indent=2)
    rows = readers.read_envelope(spark, tmp_dir).collect()
    assert sorted((r.STATION_ID, r.LAST_REPORTED) for r in rows) == [(1, T0), (1, T0 + 60), (2, T0)]


def test_snapshot_json_staging_roundtrip(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "in"), "stations_a.json", FIRST)
    st = readers.read_status_json(spark, os.path.join(tmp_dir, "in"))
    base = os.path.join(tmp_dir, "landing")
    p = sinks.write_snapshot_json(sinks.to_feed_shape(st), base, "20240101_100000")
    assert os.path.basename(p) == "stations_20240101_100000"
    for name in os.listdir(p):
        if name.endswith(".txt"):
            with open(os.path.join(p, name)) as f:
                assert isinstance(json.load(f), list)
    back = readers.read_status_json(spark, base)
    cols = ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_BIKES_AVAILABLE_MECHANICAL", "NUM_DOCKS_AVAILABLE", "LAST_REPORTED", "TRAFFIC"]
    assert sorted(map(tuple, back.select(cols).collect()), key=str) == sorted(map(tuple, st.select(cols).collect()), key=str)
    staging = os.path.join(tmp_dir, "staging")
    sinks.append_staging(back, staging)
    sinks.append_staging(back, staging)
    assert readers.read_table(spark, staging).count() == 12


def test_a_large_snapshot_is_cut_into_whole_arrays(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(sinks, "SNAPSHOT_OBJECTS", 7)
    for n in (0, 1, 7, 14, 20):
        p = sinks.write_snapshot_json(spark.range(n).coalesce(1).selectExpr("id as station_id"), os.path.join(tmp_dir, str(n)), "20240101_100000")
        sizes = [len(json.load(open(os.path.join(p, f)))) for f in sorted(os.listdir(p)) if f.endswith(".txt") and os.path.getsize(os.path.join(p, f))]
        assert sum(sizes) == n and all(x <= 7 for x in sizes)
        if n:
            assert sorted(r.STATION_ID for r in readers.read_status_json(spark, os.path.join(tmp_dir, str(n))).collect()) == list(range(n))


def test_csv_roundtrip_keeps_quotes_and_utf8(spark, tmp_dir):
    rows = [(11, "Old Mill Road, 7", "Old Mill Road, 7", Decimal("48.1234567"), Decimal("11.7654321"), 23),
            (12, "Quay 3 | Café Ö", "Quay 3 | Café Ö", Decimal("48.2000001"), Decimal("11.5000002"), 5)]
    from stationflow.schemas import BROKEN_DOCKS

    df = spark.createDataFrame(rows, BROKEN_DOCKS)
    out = os.path.join(tmp_dir, "csv")
    sinks.write_csv(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert "STATION_ID,STATION_NAME,ADDRESS,LAT,LON,BROKEN_DOCKS" in text
    assert '"Old Mill Road, 7"' in text and "48.1234567" in text
    back = readers.read_broken_docks_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_file_inventory_and_bounded_collect(spark, tmp_dir):
    write_array(tmp_dir, "stations_1.json", FIRST)
    write_array(tmp_dir, "stations_2.json", SECOND)
    inv = readers.file_inventory(spark, os.path.join(tmp_dir, "stations*"), "json", multiLine="true")
    got = sorted((r.FILE_NAME, r.N_ROWS) for r in inv.collect())
    assert got == [("stations_1.json", 6), ("stations_2.json", 2)]
    assert all(r.FILE_SIZE > 0 for r in inv.collect())
    rows = readers.read_status_json(spark, tmp_dir)
    assert len(sinks.collect_result(rows, 8)) == 8
    with pytest.raises(ValueError):
        sinks.collect_result(rows, 7)


def test_inventory_lists_files_without_rows(spark, tmp_dir):
    write_array(tmp_dir, "stations_1.json", FIRST)
    write_array(tmp_dir, "stations_2.json", [])
    got = sorted((r.FILE_NAME, r.N_ROWS) for r in readers.file_inventory(spark, tmp_dir, "json", multiLine="true").collect())
    assert got == [("stations_1.json", 6), ("stations_2.json", 0)]


def test_rejects_are_counted_by_column(spark, tmp_dir):
    write_array(tmp_dir, "stations_1.json", FIRST + [poll(7, 1, 1, "late", num_bikes_available="many"), poll(8, 1, 1, T0, num_bikes_available_types={"mechanical": "x", "ebike": 1})])
    with open(os.path.join(tmp_dir, "stations_2.json"), "w") as f:
        f.write('[{"station_id": 1, "num_bi')  # cut off
    r = readers.reject_counts(spark, tmp_dir).first()
    assert (r.ROWS, r.CORRUPT, r.STATION_ID, r.NUM_BIKES_AVAILABLE, r.LAST_REPORTED, r.NUM_BIKES_AVAILABLE_MECHANICAL, r.STATUS) == (8, 1, 1, 1, 1, 1, 0)
    assert readers.read_status_json(spark, tmp_dir).count() == 8
    write_array(os.path.join(tmp_dir, "m"), "stations_m.json", MASTER + [{"station_id": 12, "lat": "north"}])
    assert readers.reject_counts(spark, os.path.join(tmp_dir, "m"), master=True).first().LAT == 1


def test_materialise(spark, tmp_dir):
    df = spark.range(5).select(F.col("id").alias("X"))
    out = sinks.materialise(df, os.path.join(tmp_dir, "t"))
    assert sorted(r.X for r in out.collect()) == [0, 1, 2, 3, 4]
    out2 = sinks.materialise(df.where("X > 2"), os.path.join(tmp_dir, "t"))  # replace
    assert sorted(r.X for r in out2.collect()) == [3, 4]
