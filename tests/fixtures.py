"""Hand-made feed files (FIXTURES.md section 2), written into a test folder."""

import json
import os

T0 = 1704103200  # 2024-01-01 10:00:00 UTC


def poll(sid, bikes, docks, last, **kw):
    obj = {
        "station_id": sid,
        "num_bikes_available": bikes,
        "num_bikes_available_types": {"mechanical": max(bikes - 1, 0), "ebike": min(bikes, 1)},
        "num_docks_available": docks,
        "last_reported": last,
        "is_charging_station": True,
        "status": "IN_SERVICE",
        "is_installed": 1,
        "is_renting": 1,
        "is_returning": 1,
        "traffic": None,
    }
    obj.update(kw)
    return obj


def write_array(folder, name, objs, mtime=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(objs, f, indent=2)
    if mtime is not None:
        os.utime(path, (mtime, mtime))
    return path


FIRST = [
    poll(1, 5, 10, T0),
    poll(1, 6, 9, T0 + 60),  # second poll of station 1 in the same file
    poll(2, 0, 20, T0),
    {k: v for k, v in poll(3, 4, 4, T0).items() if k != "traffic"},  # key missing
    poll(None, 1, 1, T0),  # NULL id
    poll("abc", 1, 1, T0),  # non-numeric id
]
SECOND = [poll(1, 2, 13, T0 - 600), poll(4, 7, 3, T0 + 30)]  # station 1: older report arrives later

MASTER = [
    {
        "station_id": 1,
        "name": "Old Mill Road, 7",
        "physical_configuration": "ELECTRICBIKESTATION",
        "lat": 48.12345678,
        "lon": "11.7654321",
        "altitude": 16.5,
        "address": "Old Mill Road, 7",
        "post_code": "10002",
        "capacity": 30,
        "is_charging_station": True,
        "nearby_distance": 2.4,
        "_ride_code_support": False,
        "rental_uris": {"android": "https://a", "ios": "https://i"},
    },
    {"station_id": 2, "name": "zero", "lat": 41.4, "lon": 2.2, "capacity": 0, "post_code": "10003"},
    {"station_id": 3, "name": "no cap", "lat": 41.41, "lon": 2.21, "post_code": "10003"},
    {"station_id": 9, "name": "no status", "lat": 41.42, "lon": 2.22, "capacity": 20, "post_code": "10004"},
]
