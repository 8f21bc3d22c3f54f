"""Catalog tables, SQL functions, VARIANT feeds and the upkeep of the pair table."""

import json
import os
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import FIRST, MASTER, T0, poll, write_array
from stationflow.functions import columns as C
from stationflow.operators import docks, geo, status
from stationflow.plans.catalog import create_tables, replace_table
from stationflow.plans.sql_functions import register_functions
from stationflow.plans.views import register_views
from stationflow.schemas import MASTER as MASTER_SCHEMA
from stationflow.schemas import STAGING, STATE
from stationflow.sources import readers, sinks


@pytest.fixture()
def tables(spark, tmp_dir):
    write_array(os.path.join(tmp_dir, "s"), "stations_1.json", FIRST)
    write_array(os.path.join(tmp_dir, "m"), "stations_m.json", MASTER)
    m = status.latest_per_station(readers.read_master_json(spark, os.path.join(tmp_dir, "m"), with_source_file=False), ("TST_REC",))
    return m, status.current_state(readers.read_status_json(spark, os.path.join(tmp_dir, "s")), m)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_tables_keep_types_and_join_without_a_shuffle(spark, tables, tmp_dir):
    schema = f"t{uuid.uuid4().hex[:8]}"
    names = create_tables(spark, schema, os.path.join(tmp_dir, "wh"), buckets=4)
    assert names == [f"{schema}.staging", f"{schema}.stations", f"{schema}.current_state"]
    create_tables(spark, schema, os.path.join(tmp_dir, "wh"), buckets=4)  # there already
    for name, fields in zip(names, (STAGING, MASTER_SCHEMA, STATE), strict=True):
        assert [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in fields]
    m, state = tables
    before = sorted(map(str, docks.broken_docks(m, state).collect()))
    stored = replace_table(m, names[1])
    current = replace_table(state, names[2])
    assert sorted(map(str, docks.broken_docks(stored, current).collect())) == before
    assert current.where("STATION_ID = 1").first().OCCUPATION_RATIO == Decimal("0.2000")
    assert sorted(map(str, replace_table(state.limit(2), names[2]).collect())) != [] and spark.table(names[2]).count() == 2
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (docks.broken_docks(stored, spark.table(names[2])), status.enrich_status(spark.table(names[2]).drop("STATION_NAME", "LAT", "LON", "CAPACITY"), stored)):
            assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sql_functions_say_what_the_columns_say(spark, tables):
    m, state = tables
    p = f"t{uuid.uuid4().hex[:8]}_"
    register_views(spark, m, state, 1500.0, p)
    names = register_functions(spark, p)
    assert len(names) == 6
    ratios = [None, float("nan"), -0.5, 0.0, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0, 1.5]
    spark.createDataFrame([(r,) for r in ratios], "r double").createOrReplaceTempView(f"{p}r")
    sql = spark.sql(f"SELECT {p}occupancy_color(r) c, {p}occupancy_color(r, 0.2) w, {p}binary_entropy(r) e, {p}bike_need(10, r) n FROM {p}r")
    columns = spark.table(f"{p}r").select(
        C.occupancy_color("r").alias("c"), C.occupancy_color("r", 0.2).alias("w"), C.binary_entropy("r").alias("e"), C.bike_need(F.lit(10), "r").alias("n")
    )
    assert sorted(map(str, sql.collect())) == sorted(map(str, columns.collect()))
    with pytest.raises(Exception, match="threshold"):
        spark.sql(f"SELECT {p}occupancy_color(0.1, 0.7)").collect()
    broken = spark.sql(f"SELECT STATION_ID, BROKEN_DOCKS FROM {p}broken_docks_over()")
    assert [tuple(r) for r in broken.collect()] == [(1, 15)]
    assert spark.sql(f"SELECT * FROM {p}broken_docks_over(15)").isEmpty()
    assert "Python" not in plan(broken) and "Arrow" not in plan(sql)


GLOBE = [(i, lat, lon) for i, (lat, lon) in enumerate([(90.0, 0.0), (90.0, 77.0), (89.995, 180.0), (-90.0, 1.0), (0.0, 179.999), (0.0, -179.999), (0.0, 0.0), (0.0, 0.005), (60.0, 10.0), (60.0, 10.01)])]


@pytest.mark.parametrize("radius", [300.0, 1500.0, 400_000.0, 30_000_000.0])
def test_sql_pairs_on_the_globe(spark, radius):
    rnd = random.Random(3)
    rows = GLOBE + [(100 + i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)] + [(200, None, 1.0), (None, 1.0, 1.0)]
    p = f"t{uuid.uuid4().hex[:8]}_"
    df = spark.createDataFrame(rows, "STATION_ID long, LAT double, LON double")
    df.createOrReplaceTempView(f"{p}stations")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {p}broken_docks AS SELECT 0L AS STATION_ID, '' AS STATION_NAME, 0L AS BROKEN_DOCKS")
    register_functions(spark, p)
    got = {(r[0], r[1]) for r in spark.sql(f"SELECT * FROM {p}station_pairs_within({radius}e0)").collect()}
    assert got == {(r[0], r[1]) for r in geo.pairs_within(df, radius).collect()}


def test_pairs_are_kept_up_to_date(spark):
    rnd = random.Random(8)
    place = lambda: (round(rnd.uniform(41.3, 41.5), 5), round(rnd.uniform(2.0, 2.2), 5))
    before = [(i, *place()) for i in range(600)] + [(i, lat, lon) for i, lat, lon in [(1000 + g[0], *g[1:]) for g in GLOBE]]
    after = [r for r in before if r[0] % 50 != 7]  # gone
    after = [(i, *place()) if i % 61 == 3 and i < 1000 else (i, lat, lon) for i, lat, lon in after]  # moved
    after += [(2000 + i, *place()) for i in range(8)] + [(3000, 90.0, 5.0), (3001, 0.0, 180.0), (3002, None, 1.0), (None, 41.4, 2.1)]  # new
    after = [(i, None, None) if i == 20 else (i, lat, lon) for i, lat, lon in after]  # lost its place
    old, new = (spark.createDataFrame(x, "STATION_ID long, LAT double, LON double") for x in (before, after))
    rows = lambda df: sorted((r.SRC_STATION_ID, r.TGT_STATION_ID, round(r.DISTANCE, 6)) for r in df.collect())
    for radius in (900.0, 2000.0):
        pairs = geo.pairs_within(old, radius).cache()
        want = rows(geo.pairs_within(new, radius))
        assert rows(geo.update_pairs(pairs, old, new, radius)) == want and len(want) > 100
        assert rows(geo.update_pairs(pairs, old, old, radius)) == rows(pairs)
        assert rows(geo.update_pairs(pairs.limit(0), old.limit(0), new, radius)) == want
        assert rows(geo.update_pairs(pairs, old, new.limit(0), radius)) == []


def test_unknown_fields_survive_staging(spark, tmp_dir):
    objects = FIRST + [poll(7, 3, 4, T0, vendor={"model": "x9", "list": [1, {"deep": True}]}), dict(poll(8, 1, 1, T0), num_bikes_available="many", status=5)]
    write_array(tmp_dir, "stations_1.json", objects)
    write_array(tmp_dir, "stations_2.json", poll(9, 1, 1, T0))  # one object, no array
    with open(os.path.join(tmp_dir, "stations_3.json"), "w") as f:
        f.write('[{"station_id": 1, "num_bi')
    read = readers.read_status_variant(spark, tmp_dir)
    columns = [f.name for f in STAGING.fields if f.name != "TST_REC"]
    typed = readers.read_status_json(spark, tmp_dir).select(columns)
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, typed.collect()))
    sinks.append_staging(read, os.path.join(tmp_dir, "staging"))
    back = readers.read_table(spark, os.path.join(tmp_dir, "staging")).where("STATION_ID = 7")
    field = readers.variant_field
    row = back.select(field("RAW", "$.vendor.model"), field("RAW", "$.vendor.list[1].deep", "boolean"), field("RAW", "$.vendor.model", "int"), field("RAW", "$.none"), F.to_json("RAW")).first()
    assert tuple(row)[:4] == ("x9", True, None, None) and json.loads(row[4])["vendor"]["list"][0] == 1


def test_views_run_nothing_until_they_are_asked(spark, tables):
    m, state = tables
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "views")
    try:
        register_views(spark, m, state, 1500.0, f"t{group[:8]}_")
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
