import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from watchframe.schema import FLAT_EVENT
from watchframe.session import get_session

START = datetime(2025, 1, 6, 9, 0, 0, tzinfo=timezone.utc)  # a Monday

DEFAULTS = {
    "entity_id": "e1",
    "entity_type": "user",
    "source_ip": "10.0.0.1",
    "geo_lat": 10.0,
    "geo_lon": 20.0,
    "geo_city": "x",
    "geo_country": "XX",
    "resource_accessed": "r1",
    "auth_method": "password",
    "auth_success": True,
    "session_duration": 60.0,
    "command_sequence": "['login']",
    "device_os": "os1",
    "device_firmware": "v1",
    "device_mac": "m1",
    "device_protocol": "HTTPS",
    "bytes_transferred": 1000,
}


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        app="tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """Log from dicts; `at` is seconds after START, missing columns take defaults, ids count up."""

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            row = dict(row)
            at = row.pop("at", i)
            full.append({"event_id": f"{i:05d}", "timestamp": START + timedelta(seconds=at), **DEFAULTS, **row})
        return spark.createDataFrame([tuple(r[c] for c in FLAT_EVENT.fieldNames()) for r in full], FLAT_EVENT)

    return build


@pytest.fixture
def split_road(spark):
    """Every key hot, tiny blocks."""
    spark.conf.set("watchframe.hotRows", "0")
    spark.conf.set("watchframe.blockRows", "7")
    yield
    spark.conf.unset("watchframe.hotRows")
    spark.conf.unset("watchframe.blockRows")


def by_event(df, *columns):
    """event_id -> row of the given columns (a bare value for one column)."""
    out = {}
    for row in df.select("event_id", *columns).collect():
        out[row[0]] = row[1] if len(columns) == 1 else tuple(row)[1:]
    return [out[k] for k in sorted(out)]
