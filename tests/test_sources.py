"""Contract checks, files, commands, labels, splits and serving tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import START, by_event
from watchframe.operators import labels, profile, quality, serving
from watchframe.schema import int_to_label, label_to_int, mitre_of, severity
from watchframe.sources import files


def test_valid_event_is_accepted(spark, make_log):
    valid, rejects = quality.validate_events(make_log([{"source_ip": "192.168.1.1", "session_duration": 120.5}]))
    assert valid.first()["source_ip"] == "192.168.1.1"
    assert rejects.count() == 0


def test_bad_address_is_rejected(make_log):
    valid, rejects = quality.validate_events(make_log([{"source_ip": "999.999.999.999"}, {}]))
    assert by_event(rejects, "reasons") == [["source_ip"]]
    assert valid.count() == 1


def test_every_check(make_log):
    rows = [
        {"entity_type": "robot", "auth_method": "x"},
        {"geo_lat": 90.0, "geo_lon": -180.0, "session_duration": 0.0, "bytes_transferred": 0},
        {"geo_lat": 90.1, "geo_lon": -180.1},
        {"session_duration": -0.1, "bytes_transferred": -1},
        {"auth_success": None, "device_os": None},
        {"command_sequence": None, "bytes_transferred": None},
        {"session_duration": float("nan")},
    ]
    checked = quality.with_reasons(make_log(rows), quality.event_checks())
    assert by_event(checked, "reasons")[:6] == [
        ["entity_type", "auth_method"],
        [],
        ["geo_lat", "geo_lon"],
        ["session_duration", "bytes_transferred"],
        ["missing auth_success", "missing device_os"],
        [],
    ]
    valid, _ = quality.validate_events(make_log(rows[5:6]))
    assert by_event(valid, "command_sequence", "bytes_transferred") == [("[]", 0)]


@pytest.mark.parametrize(
    "ip, ok",
    [("1.2.3.4", 1), ("001.02.003.255", 1), ("256.1.1.1", 0), ("1.2.3", 0), ("1.2.3.4.5", 0), ("a.b.c.d", 0), ("1.2.3.", 0),
     ("-1.2.3.4", 0), ("", 0), (None, 0), ("1.2.3.99999999999999999999", 0), ("0.0.0.0", 1), ("1.2.3.4 ", 0)],
)
def test_ipv4(spark, ip, ok):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(quality.is_ipv4(F.col("ip"))).first()[0] == bool(ok)


def test_labels_and_tags(spark):
    df = spark.createDataFrame([("insider_drift", 7), ("normal", 0), ("nope", 99)], "label string, n int")
    rows = df.select(label_to_int(F.col("label")), int_to_label(F.col("n")), mitre_of(F.col("label"))).collect()
    assert [tuple(r) for r in rows] == [
        (7, "insider_drift", "T1078 (Valid Accounts — privilege expansion)"),
        (0, "normal", ""),
        (0, "normal", ""),
    ]
    risks = spark.createDataFrame([(90.0,), (89.9,), (70.0,), (50.0,), (49.9,)], "r double")
    assert [r[0] for r in risks.select(severity(F.col("r"))).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


@pytest.mark.parametrize(
    "text, items",
    [("['a', 'b']", ["a", "b"]), ("[np.str_('a'), np.str_('b')]", ["a", "b"]), ('["a\'s", \'b\']', ["a's", "b"]),
     ("[]", []), ("", []), (None, []), ("'a'", []), ("nan", []), ("__import__('os')", []), ("['']", [""])],
)
def test_command_text(spark, text, items):
    assert spark.createDataFrame([(text,)], "t string").select(files.decode_list(F.col("t"))).first()[0] == items


def test_command_ids(spark):
    df = spark.createDataFrame([(["login", "calibrate_device", "login_failed"],)], "c array<string>")
    assert df.select(files.encode_commands(F.col("c"))).first()[0] == [1, 30, 0]


def test_dataset_roundtrip(spark, make_log, tmp_path):
    log = make_log([{"at": 0.25, "command_sequence": "['a', \"b\"]", "resource_accessed": 'x "quoted", y'}, {"geo_city": None, "at": 1}])
    files.write_dataset(files.with_commands(log).withColumn("label", F.lit("normal")), str(tmp_path / "d"))
    back = files.read_events(spark, str(tmp_path / "d/access_logs"))
    assert back.exceptAll(files.with_commands(log)).count() == 0 and back.count() == 2
    assert by_event(files.read_labels(spark, str(tmp_path / "d/hidden_labels")), "label") == ["normal", "normal"]


def test_csv_is_read_by_name_and_bad_values_become_null(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "timestamp,event_id,auth_success,bytes_transferred,command_sequence\n"
        "2025-01-01 10:00:05,e1,True,12,\"['login', 'logout']\"\n2025-01-01T10:00:06,e2,False,lots,\n"
    )
    df = files.read_events(spark, str(tmp_path / "log.csv"))
    assert by_event(df, "timestamp", "auth_success", "bytes_transferred", "command_sequence", "entity_id") == [
        (datetime(2025, 1, 1, 10, 0, 5), True, 12, ["login", "logout"], None),
        (datetime(2025, 1, 1, 10, 0, 6), False, None, [], None),
    ]


def test_json_forms(spark, tmp_path):
    (tmp_path / "n.json").write_text(
        '{"event_id":"e1","entity_id":"u1","timestamp":"2025-01-01T10:00:05Z","geo_location":{"city":"NY","country":"US","lat":40.7,"lon":-74.0},'
        '"device_fingerprint":{"os":"Windows 11","firmware_version":"1.0","mac_address":"00","protocol":"HTTPS"},"command_sequence":["a"]}\n'
    )
    row = files.read_nested_events(spark, str(tmp_path / "n.json")).first()
    assert (row.geo_lat, row.device_os, row.command_sequence, row.timestamp) == (40.7, "Windows 11", ["a"], datetime(2025, 1, 1, 10, 0, 5))


def test_profiles(spark, tmp_path):
    head = "entity_id,entity_type,home_lat,home_lon,typical_hour_mean,typical_hour_std,resource_set,session_duration_mean_log,session_duration_std_log,auth_method,device_os,device_firmware,device_mac,device_protocol,avg_daily_events,bytes_mean,bytes_std,typical_commands"
    good = "u1,user,1,2,9,2,\"['a','b','c']\",5,0.4,token,w,v,m,HTTPS,8,5000,2000,[]"
    bad = "u2,user,91,2,25,6.5,\"['a','b']\",5,0,token,w,v,m,HTTPS,0,-1,2000,[]"
    (tmp_path / "p.csv").write_text(f"{head}\n{good}\n{bad}\n")
    valid, rejects = quality.validate_profiles(files.read_profiles(spark, str(tmp_path / "p.csv")))
    assert [r.entity_id for r in valid.collect()] == ["u1"]
    assert rejects.first().reasons == [
        "home_lat", "typical_hour_mean", "typical_hour_std", "resource_set", "session_duration_std_log", "avg_daily_events", "bytes_mean",
    ]


def test_split_keeps_the_boundary_in_train(make_log):
    log = make_log([{"at": 0}, {"at": 30 * 86400}, {"at": 30 * 86400 + 1}])
    train, test = labels.temporal_split(log, 30)
    assert (by_event(train, "entity_id"), test.count()) == (["e1", "e1"], 1)


def test_unused_resources(make_log):
    log = make_log([{"entity_id": "a", "resource_accessed": "x"}, {"entity_id": "b", "resource_accessed": "q"}])
    catalog = make_log([{"resource_accessed": r} for r in "xyz"])
    got = {r.entity_id: r.unused for r in labels.unused_resources(log, catalog).collect()}
    assert got == {"a": ["y", "z"], "b": ["x", "y", "z"]}


@pytest.mark.parametrize("road", ["plain", "split"])
@pytest.mark.parametrize("n", [1, 2, 4, 29, 30, 31, 95])
def test_drift_series(request, make_log, road, n):
    if road == "split":
        request.getfixturevalue("split_road")
    sizes = [(i * 37) % 101 for i in range(n)]
    got = profile.drift_series(make_log([{"bytes_transferred": s} for s in sizes])).first()["drift_data"]
    assert len(got) == 30
    if n == 1:
        assert got == [0.01] * 30
        return
    bins = {}
    for r, s in enumerate(sizes):
        bins.setdefault(max(-(-r * 30 // (n - 1)) - 1, 0), []).append(s)
    means = [sum(b) / len(b) for _, b in sorted(bins.items())]
    lo, hi = min(means), max(means)
    points = [(m - lo) / (hi - lo) * 0.08 for m in means]
    points += [points[-1]] * (30 - len(points))
    assert got == pytest.approx(points, abs=6e-5)


def test_profile_of_unknown_and_flat_entities(spark, make_log):
    log = make_log([{"device_os": o, "bytes_transferred": 5} for o in ("b", "a", "a", "b")])
    wanted = spark.createDataFrame([("e1",), ("ghost",)], "entity_id string")
    got = {r.entity_id: r for r in profile.requested_profiles(log, wanted).collect()}
    assert got["e1"].cohort == "a"
    assert got["e1"].drift_data == [0.02] * 30
    assert got["e1"].account_age == "0.5y"
    assert (got["ghost"].cohort, got["ghost"].maturity_level, got["ghost"].behavioral_vector) == ("Unknown Cohort", "UNKNOWN", [50] * 6)
    spikes = profile.with_spike(profile.drift_series(log))
    assert spikes.first().spike is None


def test_tiles(spark, make_log):
    log = make_log([{"at": 0}, {"at": 90000}, {"at": 90001}])
    assert serving.kpi_tiles(log).first().asDict() == {"events_analyzed": 3, "active_alerts": 0, "drift_index": 0.04}
    assert serving.kpi_tiles(log, hours=24).first().events_analyzed == 2
    report = spark.createDataFrame([("support", "brute_force", 55.0), ("support", "normal", 9.0)], "metric string, class string, value double")
    assert serving.kpi_tiles(log, report).first().asDict() == {"events_analyzed": 3, "active_alerts": 5, "drift_index": 0.59}
    assert serving.kpi_tiles(log, report.where("class = 'normal'")).first().active_alerts == 14


def test_places(spark):
    df = spark.createDataFrame([(40.7, -74.0), (0.0, 0.0)], "lat double, lon double")
    near = [r.far_city for r in serving.far_places(df, 2000.0).collect()]
    assert near == ["Los Angeles", "New York"]
    # nowhere is that far away: the farthest place
    assert serving.far_places(df.limit(1), 30000.0).first().far_km > 16000


def test_timeline_and_recent(make_log):
    from watchframe.operators import rules

    log = make_log([{"device_mac": "a"}, {"device_mac": "b"}, {"entity_id": "other"}])
    line = serving.entity_timeline(rules.with_rules(log), "e1").collect()
    assert [(r.anomalous, r.rules) for r in line] == [(False, ""), (True, "device_spoofing")]
    assert line[0].timestamp == START.strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    assert [r.event_id for r in serving.recent_events(log, 2).collect()] == ["00002", "00001"]


def test_csv_lists_keep_quotes_and_backslashes(spark, make_log, tmp_path):
    items = ["grep 'a b' f", 'say "x"', "C:\\dir\\'n", "ls", ""]
    log = make_log([{}]).withColumn("command_sequence", F.array(*map(F.lit, items))).withColumn("label", F.lit("normal"))
    files.write_dataset(log, str(tmp_path / "set"))
    assert files.read_events(spark, str(tmp_path / "set/access_logs")).first()["command_sequence"] == items
