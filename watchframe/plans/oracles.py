"""DuckDB twins of the registered queries, written independently of the Spark code.

Each is a whole statement over the given tables. `_LOG` maps `events` to access-log columns; the sliding
windows here are real sliding windows and the distinct counts real distinct counts.
"""

from __future__ import annotations

from watchframe.schema import COMMANDS, LABELS, MITRE, PLACES

BF_US, STUFF_US, WEEK_US, HOUR_US, DAY_US = 259_200_000_000, 172_800_000_000, 604_800_000_000, 3_600_000_000, 86_400_000_000

_LOG = """
WITH base AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
log0 AS (SELECT event_id,
  CAST(user_id AS VARCHAR) AS entity_id,
  CASE WHEN user_id % 12 < 8 THEN 'user' WHEN user_id % 12 < 11 THEN 'edge_device' ELSE 'service_account' END AS entity_type,
  ts, epoch_us(ts) AS us,
  concat('10.0.0.', CAST(k AS VARCHAR)) AS source_ip,
  CAST(user_id % 100 AS DOUBLE) - 50 + CASE WHEN k >= 95 THEN 30 ELSE k / CAST(1000 AS DOUBLE) END AS geo_lat,
  CAST(user_id % 300 AS DOUBLE) - 150 AS geo_lon,
  concat('city', CAST(user_id % 7 + CASE WHEN k >= 95 THEN 1 ELSE 0 END AS VARCHAR)) AS geo_city,
  concat('res://', event_type, '/', CAST(k % 20 AS VARCHAR)) AS resource,
  CASE k % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'token' WHEN 2 THEN 'certificate' ELSE 'biometric' END AS auth_method,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
  value AS duration,
  ['login', concat('c', CAST(k % 7 AS VARCHAR)), concat('c', CAST(k % 3 AS VARCHAR)), event_type] AS commands,
  CASE WHEN k % 20 = 0 THEN 'Ubuntu 22.04' ELSE 'Windows 11' END AS os,
  concat('00:', CAST(user_id % 100 AS VARCHAR), ':', CAST(CASE WHEN k % 20 = 0 THEN k ELSE 1 END AS VARCHAR)) AS mac,
  CAST(round(value * 100) AS BIGINT) AS bytes,
  CASE WHEN value > 150 THEN 1 + k % 7 ELSE 0 END AS label_int,
  least(CAST(100 AS DOUBLE), value / 4 + k / CAST(2 AS DOUBLE)) AS risk,
  CASE WHEN value / 4 + k / CAST(2 AS DOUBLE) > 50 THEN 1 + (k + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 7 ELSE 0 END AS pred
FROM base),
log AS (SELECT *, concat(os, '|', mac) AS device, extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE AS hour FROM log0)
"""


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(6371 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def _names(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LABELS)) + " ELSE 'normal' END"


def _mitre(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in MITRE.items()) + " ELSE '' END"


_E = "PARTITION BY entity_id ORDER BY us"
_IP = "PARTITION BY source_ip ORDER BY us"

_RULES = f""",
prev AS (SELECT *,
  lag(us) OVER ({_E}) AS pus, lag(geo_lat) OVER ({_E}) AS plat, lag(geo_lon) OVER ({_E}) AS plon, lag(device) OVER ({_E}) AS pdev,
  sum(failed) OVER ({_E} RANGE BETWEEN {BF_US} PRECEDING AND CURRENT ROW) AS nf,
  count(*) OVER ({_IP} RANGE BETWEEN {STUFF_US} PRECEDING AND CURRENT ROW) AS ipn,
  sum(failed) OVER ({_IP} RANGE BETWEEN {STUFF_US} PRECEDING AND CURRENT ROW) AS ipf,
  count(DISTINCT entity_id) OVER ({_IP} RANGE BETWEEN {STUFF_US} PRECEDING AND CURRENT ROW) AS ipt
  FROM log),
speed AS (SELECT *, {_km('plat', 'plon', 'geo_lat', 'geo_lon')} AS km, (us - pus) / 3.6e9 AS hrs FROM prev),
ruled AS (SELECT *, km / hrs AS kmh,
  CASE WHEN nf >= 3 THEN 1 ELSE 0 END AS bf,
  CASE WHEN km / hrs > 900 THEN 1 ELSE 0 END AS it,
  CASE WHEN ipn >= 5 AND ipt >= 5 AND ipf / ipn >= 0.5 THEN 1 ELSE 0 END AS cs,
  CASE WHEN pdev <> device THEN 1 ELSE 0 END AS ds
  FROM speed)
"""

_HITS = """,
hits AS (
  SELECT event_id, entity_id, us, 1 AS pos, 'brute_force' AS rule, printf('%d failed auths in 4320 min', nf::BIGINT) AS detail, 'T1110' AS mitre, least(1.0, nf / 6.0) AS confidence FROM ruled WHERE bf = 1
  UNION ALL
  SELECT event_id, entity_id, us, 2, 'impossible_travel', printf('%.0f km in %.2fh (%.0f km/h)', km, hrs, kmh), 'T1078', least(1.0, kmh / 2700) FROM ruled WHERE it = 1
  UNION ALL
  SELECT event_id, entity_id, us, 3, 'credential_stuffing', printf('%d accounts, %.0f%% failure from IP %s', ipt, 100.0::DOUBLE * ipf / ipn, source_ip), 'T1110.004', least(1.0, ipt / 10.0) FROM ruled WHERE cs = 1
  UNION ALL
  SELECT event_id, entity_id, us, 4, 'device_spoofing', concat('Fingerprint mismatch: expected ', pdev, ', got ', device), 'T1036', 0.8 FROM ruled WHERE ds = 1)
"""

# ---- features: one body each, joined for the whole table ------------------------------------------

_FEATURES = {
    "temporal": "SELECT event_id, round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos,"
    " (isodow(ts) - 1)::DOUBLE AS day_of_week, (isodow(ts) >= 6)::INT::DOUBLE AS is_weekend,"
    " (hour BETWEEN 8 AND 18)::INT::DOUBLE AS is_work_hours, (hour < 6 OR hour > 22)::INT::DOUBLE AS is_off_hours FROM log",
    "raw": "SELECT event_id, duration AS session_duration_raw, bytes::DOUBLE AS bytes_transferred_raw, 0.0::DOUBLE AS command_entropy,"
    " 0.0::DOUBLE AS auth_method_mismatch, 0.0::DOUBLE AS is_new_geo, 0.0::DOUBLE AS protocol_mismatch FROM log",
    "gap": f"SELECT event_id, round(coalesce((us - lag(us) OVER ({_E})) / 1e6, 0.0), 6) AS time_since_last,"
    f" (row_number() OVER ({_E}) - 1)::DOUBLE AS session_frequency_1h FROM log",
    "fails": f"SELECT event_id, round(avg(failed) OVER ({_E} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8) AS auth_failure_rate FROM log",
    "novelty": "SELECT event_id, novel::DOUBLE AS resource_novelty, (sum(novel) OVER (PARTITION BY entity_id ORDER BY us))::DOUBLE AS resource_diversity FROM nov",
    "expansion": f"SELECT event_id, round(CASE WHEN div > 1 THEN 1.0 / div ELSE 0.0 END, 8) AS privilege_expansion_rate, v::DOUBLE AS privilege_expansion_velocity"
    f" FROM (SELECT event_id, (sum(novel) OVER ({_E}))::DOUBLE AS div, sum(novel) OVER ({_E} RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS v FROM nov)",
    "geo": "SELECT event_id, round(v, 3) AS geo_velocity_kmh, (v > 900)::INT::DOUBLE AS impossible_travel_flag, round(d, 3) AS geo_distance_from_primary,"
    " round(0.3 * least(v / 1000, 1.0) + 0.3 * (v > 900)::INT + 0.4 * least(d / 10000, 1.0), 6) AS geo_anomaly_score FROM moved",
    "device": f"SELECT event_id, (sum(m) OVER ({_E}))::DOUBLE AS device_stability_index, (d = 1 AND r > 1)::INT::DOUBLE AS new_device_flag,"
    f" (d = 1 AND r > 1)::INT::DOUBLE AS fingerprint_mismatch FROM (SELECT event_id, entity_id, us,"
    " (row_number() OVER (PARTITION BY entity_id, mac ORDER BY us) = 1)::INT AS m, row_number() OVER (PARTITION BY entity_id, device ORDER BY us) AS d,"
    f" row_number() OVER ({_E}) AS r FROM log)",
    "ip": "SELECT event_id, count(DISTINCT entity_id) OVER (PARTITION BY source_ip ORDER BY us ROWS UNBOUNDED PRECEDING)::DOUBLE AS unique_entities_per_ip FROM log",
    "freq": "SELECT event_id, round(row_number() OVER (PARTITION BY resource ORDER BY us) / row_number() OVER (ORDER BY us), 10) AS resource_freq_encoding,"
    " round(row_number() OVER (PARTITION BY source_ip ORDER BY us) / row_number() OVER (ORDER BY us), 10) AS ip_freq_encoding FROM log",
}

_NOVEL = """,
nov AS (SELECT *, (row_number() OVER (PARTITION BY entity_id, resource ORDER BY us) = 1)::INT AS novel FROM log)
"""
_MOVED = f""",
moved AS (SELECT event_id, {_km('first_value(geo_lat) OVER w', 'first_value(geo_lon) OVER w', 'geo_lat', 'geo_lon')} AS d,
  coalesce({_km('lag(geo_lat) OVER w', 'lag(geo_lon) OVER w', 'geo_lat', 'geo_lon')} / greatest((us - lag(us) OVER w) / 3.6e9, 0.001), 0.0) AS v
  FROM log WINDOW w AS (PARTITION BY entity_id ORDER BY us))
"""
_MEASURED = f"""{_NOVEL}{_MOVED},
measured AS (SELECT l.event_id, l.entity_id, l.entity_type, l.us, l.duration AS v0, l.bytes::DOUBLE AS v1, l.hour AS v2,
  avg(l.failed) OVER (PARTITION BY l.entity_id ORDER BY l.us ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v3,
  (sum(n.novel) OVER (PARTITION BY l.entity_id ORDER BY l.us))::DOUBLE AS v4, m.v AS v5
  FROM log l JOIN nov n USING (event_id) JOIN moved m USING (event_id))
"""
_Z = ["session_duration", "bytes_transferred", "hour", "auth_failure_rate", "resource_diversity", "geo_velocity_kmh"]
_FROZEN = f""",
firsts AS (SELECT entity_type, {', '.join(f'arg_min(v{i}, us) AS f{i}' for i in range(6))}, arg_min(entity_id, us) AS fe, min(us) AS fus FROM measured GROUP BY entity_type),
frozen AS (SELECT m.event_id, m.entity_id, CASE WHEN entity_id = fe AND us > fus THEN 0.05 ELSE 0.0 END AS entity_maturity_weight,
  1.0::DOUBLE AS is_cold_start, {', '.join(f'round((v{i} - f{i}) / 1.01e-6 / 1e6, 3) AS {z}_zscore' for i, z in enumerate(_Z))}, (us = fus)::INT AS acc
  FROM measured m JOIN firsts USING (entity_type))
"""


def _batched(last: str, slices: int = 31) -> str:
    """Slices of a day, unrolled: score against the state before, fold the accepted, go on.

    The fold here is the update rule itself, run by list_reduce over each key's ordered values.
    """
    span = DAY_US
    sql = [f"sliced AS (SELECT *, us - us % {span} AS slice FROM measured)", "ranked AS (SELECT *, dense_rank() OVER (ORDER BY slice) AS b FROM sliced)"]
    state = "struct_pack(m := {m}::DOUBLE, q := {q}::DOUBLE)"
    for b in range(1, slices + 1):
        if b == 1:
            source = "(SELECT *, NULL::BIGINT AS pn, NULL::BIGINT AS cn, " + ", ".join(
                f"NULL::DOUBLE AS pm{i}, NULL::DOUBLE AS pv{i}, NULL::DOUBLE AS cm{i}, NULL::DOUBLE AS cv{i}" for i in range(6)
            ) + " FROM ranked WHERE b = 1)"
        else:
            source = (
                "(SELECT r.*, p.n AS pn, c.n AS cn, "
                + ", ".join(f"p.m{i} AS pm{i}, p.q{i} AS pv{i}, c.m{i} AS cm{i}, c.q{i} AS cv{i}" for i in range(6))
                + f" FROM ranked r LEFT JOIN ent{b - 1} p ON r.entity_id = p.k LEFT JOIN coh{b - 1} c ON r.entity_type = c.k WHERE r.b = {b})"
            )
        z = []
        for i in range(6):
            cm = f"coalesce(cm{i}, v{i})"
            pm = f"coalesce(pm{i}, {cm})"
            cs = f"CASE WHEN cn IS NULL THEN 1.0 ELSE greatest(sqrt(abs(cv{i})), 1e-6) END"
            ps = f"CASE WHEN pn IS NULL THEN {cs} ELSE greatest(sqrt(abs(pv{i})), 1e-6) END"
            z.append(f"(v{i} - (w * {pm} + (1 - w) * {cm})) / (w * {ps} + (1 - w) * {cs} + 1e-8) AS z{i}")
        sql.append(f"s{b} AS (SELECT *, {', '.join(z)} FROM (SELECT *, least(1.0, coalesce(pn, 0) / 20.0) AS w FROM {source}))")
        gate = " AND ".join(f"abs(z{i}) <= 4" for i in range(6))
        sql.append(f"a{b} AS (SELECT *, ({gate})::INT AS acc FROM s{b})")
        for name, key, p in (("ent", "entity_id", "p"), ("coh", "entity_type", "c")):
            folds = []
            for i in range(6):
                seed = state.format(m=f"coalesce(any_value({p}m{i}), first(v{i} ORDER BY us))", q=f"coalesce(any_value({p}v{i}), 0)")
                items = f"list(struct_pack(m := v{i}, q := 0.0::DOUBLE) ORDER BY us)"
                rule = "struct_pack(m := 0.95 * s.m + 0.05 * x.m, q := 0.95 * s.q + 0.05 * (x.m - (0.95 * s.m + 0.05 * x.m)) * (x.m - s.m))"
                folds.append(f"list_reduce(list_prepend({seed}, {items}), lambda s, x: {rule}) AS st{i}")
            fold = (
                f"SELECT {key} AS k, (coalesce(any_value({p}n), 0) + count(*))::BIGINT AS n, {', '.join(folds)} FROM a{b} WHERE acc = 1 GROUP BY {key}"
            )
            flat = f"SELECT k, n, {', '.join(f'st{i}.m AS m{i}, st{i}.q AS q{i}' for i in range(6))} FROM ({fold})"
            old = f" UNION ALL SELECT * FROM {name}{b - 1} WHERE k NOT IN (SELECT {key} FROM a{b} WHERE acc = 1)" if b > 1 else ""
            sql.append(f"{name}{b} AS ({flat}{old})")
    scored = " UNION ALL ".join(f"SELECT event_id, w, acc, {', '.join(f'z{i}' for i in range(6))} FROM a{b}" for b in range(1, slices + 1))
    sql.append(f"scored AS ({scored})")
    body = ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in sql)
    return f"{_LOG}{_MEASURED},\n{body}\n{last}"


_BATCHED_ROWS = (
    "SELECT event_id, round(w, 6) AS entity_maturity_weight, (w < 0.5)::INT::DOUBLE AS is_cold_start, acc::BIGINT AS accepted, "
    + ", ".join(f"round(z{i}, 4) AS {z}_zscore" for i, z in enumerate(_Z))
    + " FROM scored"
)

_CURVE = """,
g AS (SELECT risk, count(*) AS n, sum((label_int > 0)::INT) AS pos FROM log GROUP BY risk),
curve AS (SELECT *, sum(n) OVER (ORDER BY risk DESC) AS cn, sum(pos) OVER (ORDER BY risk DESC) AS cp FROM g)
"""
_CLASSES = f""",
cls AS (SELECT DISTINCT c FROM (SELECT label_int AS c FROM log UNION ALL SELECT pred FROM log)),
sc AS (SELECT {_names('c')} AS class, (SELECT count(*) FROM log WHERE label_int = c AND pred = c) AS tp,
  (SELECT count(*) FROM log WHERE pred = c) AS p, (SELECT count(*) FROM log WHERE label_int = c) AS s FROM cls),
prf AS (SELECT class, s, tp, CASE WHEN p = 0 THEN 0.0 ELSE tp / p END AS precision, CASE WHEN s = 0 THEN 0.0 ELSE tp / s END AS recall,
  CASE WHEN p + s = 0 THEN 0.0 ELSE 2.0 * tp / (p + s) END AS f1 FROM sc),
rep AS (
  SELECT 'precision' AS metric, class, precision::DOUBLE AS value FROM prf UNION ALL SELECT 'recall', class, recall FROM prf
  UNION ALL SELECT 'f1', class, f1 FROM prf UNION ALL SELECT 'support', class, s FROM prf
  UNION ALL SELECT 'precision', 'macro avg', avg(precision) FROM prf UNION ALL SELECT 'recall', 'macro avg', avg(recall) FROM prf
  UNION ALL SELECT 'f1', 'macro avg', avg(f1) FROM prf UNION ALL SELECT 'macro_f1', 'all', avg(f1) FROM prf
  UNION ALL SELECT 'precision', 'weighted avg', sum(precision * s) / sum(s) FROM prf UNION ALL SELECT 'recall', 'weighted avg', sum(recall * s) / sum(s) FROM prf
  UNION ALL SELECT 'f1', 'weighted avg', sum(f1 * s) / sum(s) FROM prf
  UNION ALL SELECT 'support', 'macro avg', sum(s) FROM prf UNION ALL SELECT 'support', 'weighted avg', sum(s) FROM prf
  UNION ALL SELECT 'accuracy', 'all', sum(tp) / sum(s) FROM prf)
"""
_AP = "(SELECT sum(pos * cp / cn) / sum(pos) FROM curve)"
_AUC = "(SELECT sum((n - pos) * (cp - pos + pos / 2)) / (sum(pos) * sum(n - pos)::DOUBLE) FROM curve)"
_K = "greatest(1, floor((SELECT count(*) FROM log) * 0.01))::BIGINT"
_PK = f"(SELECT avg((label_int > 0)::INT) FROM (SELECT label_int FROM log ORDER BY risk DESC, event_id LIMIT {_K}))"
_FPR = "(SELECT coalesce(avg((risk > 50)::INT), 0) FROM log WHERE label_int = 0)"
_FULL_REPORT = f"""{_CURVE}{_CLASSES},
full_rep AS (SELECT * FROM rep UNION ALL SELECT 'precision_at_1pct', 'all', {_PK} UNION ALL SELECT 'pr_auc', 'all', {_AP}
  UNION ALL SELECT 'roc_auc', 'all', {_AUC} UNION ALL SELECT 'false_positive_rate', 'all', {_FPR})
"""

_PROFILE = """,
facts AS (SELECT entity_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span, avg(1 - failed) AS ok, sum(failed) AS f,
  avg((extract(hour FROM ts) BETWEEN 8 AND 18)::INT) AS day, avg(bytes) AS b, count(DISTINCT geo_city) AS c, count(DISTINCT resource) AS r FROM log GROUP BY 1),
oses AS (SELECT entity_id, os, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, os) AS rk FROM log GROUP BY 1, 2),
prof AS (SELECT entity_id, os AS cohort,
  concat(CASE WHEN round(greatest(span // 86400000000, 1) / 365.0, 1) = 0 THEN round((n % 50) / 10.0 + 0.1, 1) ELSE round(greatest(span // 86400000000, 1) / 365.0, 1) END::DOUBLE::VARCHAR, 'y') AS account_age,
  round_even(ok, 2) AS maturity_weight, CASE WHEN ok > 0.8 THEN 'HIGH' WHEN ok > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS maturity_level,
  trunc(least(100.0::DOUBLE, day * 100))::BIGINT AS working_hours, trunc(least(100.0::DOUBLE, b / 50000.0::DOUBLE * 100))::BIGINT AS data_volume,
  least(100, c * 20)::BIGINT AS places, least(100, r * 10)::BIGINT AS resources, least(100, f * 5)::BIGINT AS auth_failures, trunc(least(100.0::DOUBLE, n / 100.0::DOUBLE * 100))::BIGINT AS activity
  FROM facts JOIN oses USING (entity_id) WHERE rk = 1)
"""
_SERIES = """,
ranked AS (SELECT entity_id, bytes, row_number() OVER (PARTITION BY entity_id ORDER BY us) - 1 AS r, count(*) OVER (PARTITION BY entity_id) AS n FROM log),
binned AS (SELECT entity_id, n, greatest((r * 30 + n - 2) // (n - 1) - 1, 0) AS bin, avg(bytes) AS m FROM ranked WHERE n > 1 GROUP BY 1, 2, 3),
normed AS (SELECT entity_id, bin, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS have,
  CASE WHEN max(m) OVER (PARTITION BY entity_id) > min(m) OVER (PARTITION BY entity_id)
    THEN (m - min(m) OVER (PARTITION BY entity_id)) / (max(m) OVER (PARTITION BY entity_id) - min(m) OVER (PARTITION BY entity_id)) * 0.08 ELSE 0.02 END AS x
  FROM binned WINDOW w AS (PARTITION BY entity_id ORDER BY bin)),
series AS (
  SELECT entity_id, i AS point, round(x, 4) AS value FROM normed
  UNION ALL SELECT entity_id, unnest(range(have, 30)), round(x, 4) FROM normed WHERE i = have - 1 AND have < 30
  UNION ALL SELECT entity_id, unnest(range(0, 30)), 0.01 FROM ranked WHERE n = 1)
"""
_PLACE_ROWS = ", ".join(f"({i}, '{c}', {lat}, {lon})" for i, (c, _, lat, lon) in enumerate(PLACES))
_SHOWN = (
    "SELECT CAST(event_id AS VARCHAR) AS event_id, entity_id, us, source_ip, round(geo_lat, 6) AS geo_lat, resource AS resource_accessed, (1 - failed)::BIGINT AS auth_success,"
    " round(duration, 6) AS session_duration, array_to_string(commands, '|') AS commands, os AS device_os, mac AS device_mac, bytes AS bytes_transferred FROM log"
)
_OUT = [("duration", "session_duration"), ("bytes", "bytes_transferred"), ("geo_lat", "geo_lat"), ("nf", "recent_failures"), ("coalesce(kmh, 0)", "travel_kmh")]


def _tail(i: int) -> str:
    left, right = f"-ln(l{i} / total)", f"-ln((total - l{i} + e{i}) / total)"
    pick = f"CASE WHEN sk{i} < 0 THEN {left} WHEN sk{i} > 0 THEN {right} ELSE {left} + {right} END"
    return f"greatest({left}, {right}, {pick})"


def _moment(i: int) -> str:
    return f"(SELECT sum(pow(c{i} - mu, 3)) FROM o, (SELECT avg(c{i}) AS mu FROM o)) AS sk{i}"


_ECOD = (
    "{log}{rules}, o AS (SELECT event_id, "
    + ", ".join(f"({e})::DOUBLE AS c{i}" for i, (e, _) in enumerate(_OUT))
    + " FROM ruled), sk AS (SELECT "
    + ", ".join(_moment(i) for i in range(5))
    + "), t AS (SELECT event_id, count(*) OVER ()::DOUBLE AS total, "
    + ", ".join(f"count(*) OVER (ORDER BY c{i} RANGE UNBOUNDED PRECEDING) AS l{i}, count(*) OVER (PARTITION BY c{i}) AS e{i}" for i in range(5))
    + " FROM o) SELECT event_id, round("
    + " + ".join(_tail(i) for i in range(5))
    + ", 4) AS ecod_score FROM t, sk"
)


def _fitted_tail(i: int) -> str:
    left = f"-ln(greatest(l{i} / total, 1 / (total + 1)))"
    right = f"-ln(greatest((total - l{i} + e{i}) / total, 1 / (total + 1)))"
    pick = f"CASE WHEN sk{i} < 0 THEN {left} WHEN sk{i} > 0 THEN {right} ELSE {left} + {right} END"
    return f"greatest({left}, {right}, {pick})"


_ECOD_FITTED = (
    "{log}{rules}, o AS (SELECT event_id, label_int = 0 AS fits, "
    + ", ".join(f"({e})::DOUBLE AS c{i}" for i, (e, _) in enumerate(_OUT))
    + " FROM ruled), sk AS (SELECT "
    + ", ".join(f"(SELECT sum(pow(c{i} - mu, 3)) FROM o, (SELECT avg(c{i}) AS mu FROM o WHERE fits) WHERE fits) AS sk{i}" for i in range(5))
    + "), t AS (SELECT event_id, (count(*) FILTER (fits) OVER ())::DOUBLE AS total, "
    + ", ".join(f"count(*) FILTER (fits) OVER (ORDER BY c{i} RANGE UNBOUNDED PRECEDING) AS l{i}, count(*) FILTER (fits) OVER (PARTITION BY c{i}) AS e{i}" for i in range(5))
    + " FROM o) SELECT event_id, round("
    + " + ".join(_fitted_tail(i) for i in range(5))
    + ", 4) AS ecod_score FROM t, sk"
)


def _joined(parts: list[str]) -> str:
    first, *rest = parts
    subs = f"({_FEATURES[first]}) a0"
    for i, name in enumerate(rest, 1):
        subs += f" JOIN ({_FEATURES[name]}) a{i} USING (event_id)"
    return subs


def _feature(name: str) -> str:
    return f"{_LOG}{_NOVEL}{_MOVED} {_FEATURES[name]}"


def _feature_table() -> str:
    """All features; the row bodies round to their own digits, so rates are rounded again to 6."""
    again = "round(auth_failure_rate, 6) AS auth_failure_rate, round(privilege_expansion_rate, 6) AS privilege_expansion_rate, round(resource_freq_encoding, 6) AS resource_freq_encoding, round(ip_freq_encoding, 6) AS ip_freq_encoding"
    return f"{_LOG}{_MEASURED}{_FROZEN} SELECT * REPLACE ({again}) FROM {_joined(list(_FEATURES))} JOIN (SELECT * EXCLUDE (entity_id, acc) FROM frozen) z USING (event_id)"


def _flawed() -> str:
    checks = [
        ("missing resource_accessed", "n = 8"), ("missing auth_success", "n = 9"), ("entity_type", "n = 1"), ("auth_method", "n = 2"),
        ("source_ip", "n = 3"), ("geo_lat", "n = 4"), ("geo_lon", "n = 5"), ("session_duration", "n = 6"), ("bytes_transferred", "n = 7"),
    ]
    cases = " ".join(f"WHEN {c} THEN '{name}'" for name, c in checks)
    return f"SELECT event_id, CASE {cases} ELSE '' END AS reasons FROM (SELECT event_id, event_id % 50 AS n FROM events)"


_IPS = """WITH x AS (SELECT event_id, event_id % 10 AS n, CAST(event_id % 300 AS VARCHAR) AS k FROM events),
y AS (SELECT event_id, CASE n WHEN 0 THEN '1.2.3.' || k WHEN 1 THEN '001.02.3.' || k WHEN 2 THEN k || '.1.1' WHEN 3 THEN '1.1.1.1.' || k WHEN 4 THEN '1..1.' || k
  WHEN 5 THEN '1.a.1.' || k WHEN 6 THEN k || '.0.0.-1' WHEN 7 THEN '' WHEN 8 THEN ' 1.2.3.' || k ELSE k || '.' || k || '.' || k || '.' || k END AS ip FROM x)
SELECT event_id, ip, CASE WHEN regexp_full_match(ip, '[0-9]+(\\.[0-9]+){3}')
  THEN (list_max(list_transform(string_split(ip, '.'), lambda p: TRY_CAST(p AS INT))) <= 255)::BIGINT ELSE 0 END AS ok FROM y"""

_SIZE = "(SELECT count(*) FROM (SELECT src FROM tr UNION SELECT dst FROM tr))"
_PAIRS = "SELECT event_id, label_int, commands[i] AS src, commands[i + 1] AS dst FROM (SELECT event_id, label_int, commands, unnest(range(1, len(commands))) AS i FROM {t})"


def _drift() -> str:
    """The adaptive window as a recursion over a cohort's buckets: an entry is (n, h, c, s), the oldest first; merge where
    six are of one size, test every end of an entry, drop the oldest while some test says so."""
    at = "list_position(list_transform(w, lambda e: e.s), {s})"
    one = f"struct_pack(n := w[{at}].n + w[{at} + 1].n, h := w[{at}].h + w[{at} + 1].h, c := w[{at}].c + w[{at} + 1].c, s := {{s}} + 1)"
    merged = "SELECT k, b.i, list_append(w, struct_pack(n := b.n, h := b.h, c := 1::BIGINT, s := 0)) AS w FROM walk JOIN buckets b USING (k) WHERE NOT cut AND b.i = walk.i + 1"
    for size in range(6):  # 5 * (1 + 2 + ... + 64) buckets fit
        merge = f"CASE WHEN len(list_filter(w, lambda e: e.s = {{s}})) > 5 THEN list_concat(list_append(w[1 : {at} - 1], {one}), w[{at} + 2 :]) ELSE w END"
        merged = f"SELECT k, i, {merge.replace('{s}', str(size))} AS w FROM ({merged})"
    total = "list_sum(list_transform({w}, lambda e: e.{f}))::DOUBLE"
    n0, h0, n1, h1 = (total.format(w=w, f=f) for w in ("w[1 : j]", "w[j + 1 :]") for f in ("n", "h"))
    n, h = total.format(w="w", f="n"), total.format(w="w", f="h")
    room = f"(1 / {n0} + 1 / {n1})"
    bound = f"sqrt(2 * {room} * ({h} / {n}) * (1 - {h} / {n}) * ln(2 * ln({n}) / 0.001)) + {room} * ln(2 * ln({n}) / 0.001) * 2 / 3"
    cut = f"len(w) > 1 AND len(list_filter(range(1, len(w)), lambda j: {n0} >= 5 AND {n1} >= 5 AND abs({h0} / {n0} - {h1} / {n1}) > {bound})) > 0"
    return f"""{_LOG.replace("WITH base", "WITH RECURSIVE base", 1)},
odd AS (SELECT entity_type AS k, us - us % {6 * HOUR_US} AS t0,
  (label_int > 0 OR (ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-24' AND event_id % 2 = 0))::INT AS x FROM log),
buckets AS (SELECT k, t0, row_number() OVER (PARTITION BY k ORDER BY t0) AS i, count(*)::BIGINT AS n, sum(x)::BIGINT AS h FROM odd GROUP BY k, t0),
walk AS (
  SELECT k, 1::BIGINT AS i, [struct_pack(n := n, h := h, c := 1::BIGINT, s := 0)] AS w, 0::BIGINT AS dropped, false AS cut FROM buckets WHERE i = 1
  UNION ALL
  SELECT k, i, w, dropped, {cut} AS cut FROM (
    SELECT k, i, w[2 :] AS w, dropped + w[1].c AS dropped FROM walk WHERE cut
    UNION ALL
    SELECT k, i, w, 0 FROM ({merged})))
SELECT k AS cohort, 'distribution_shift' AS type, 'Anomaly rate distribution shift detected for cohort ' || chr(39) || k || chr(39) || '. Baseline may need recalibration.' AS message,
  t0 AS bucket_us, dropped, printf('%.6f', {h} / {n}) AS rate
FROM walk JOIN buckets USING (k, i) WHERE dropped > 0 AND NOT cut"""


def _narrations(hits: str) -> str:
    line = "concat('  • ', f, ': ', printf('%+.3f', v), ' (', CASE WHEN v > 0 THEN '↑ increases risk' ELSE '↓ decreases risk' END, ')')"
    trace = "concat('  ⚡ ', rule, ': ', detail, chr(10), '     MITRE ATT&CK: ', mitre)"
    return f"""{hits},
named AS (SELECT event_id, floor(risk)::DOUBLE AS risk, {_names('pred')} AS label FROM log),
parts AS (SELECT event_id, unnest([1, 2, 3]) AS i, unnest(['bytes_transferred_raw', 'hour_sin', 'auth_failure_rate']) AS f,
  unnest([event_id % 64 / 16.0::DOUBLE - 2, 1 - event_id % 64 / 32.0::DOUBLE, event_id % 64 % 4 / 4.0::DOUBLE - 0.5::DOUBLE]) AS v FROM log),
top AS (SELECT event_id, string_agg({line}, chr(10) ORDER BY r) AS factors
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, i) AS r FROM parts) WHERE r <= 2 GROUP BY event_id),
traces AS (SELECT event_id, string_agg({trace}, chr(10) ORDER BY pos) AS trace FROM hits GROUP BY event_id)
SELECT event_id, concat(CASE WHEN risk >= 90 THEN '🔴 CRITICAL' WHEN risk >= 70 THEN '🟠 HIGH' WHEN risk >= 50 THEN '🟡 MEDIUM' ELSE '🟢 LOW' END,
  ' — ', replace(upper(label), '_', ' '), printf(' (risk %.0f/100)', risk), chr(10), chr(10), 'Contributing factors:', chr(10), factors,
  CASE WHEN trace IS NOT NULL THEN concat(chr(10), chr(10), 'Rule engine detections:', chr(10), trace)
    WHEN {_mitre('label')} <> '' THEN concat(chr(10), chr(10), 'MITRE ATT&CK: ', {_mitre('label')}) ELSE '' END) AS text
FROM named JOIN top USING (event_id) LEFT JOIN traces USING (event_id)"""


def oracles() -> dict[str, str]:
    ruled = _LOG + _RULES
    hits = ruled + _HITS
    vocabulary = "[" + ", ".join(f"'{c}'" for c in COMMANDS) + "]"
    features_and_rules = (
        f"SELECT * FROM ({_feature_table()}) f JOIN ({ruled} SELECT event_id, bf::BIGINT AS rule_brute_force, it::BIGINT AS rule_impossible_travel, cs::BIGINT AS rule_credential_stuffing, ds::BIGINT AS rule_device_spoofing,"
        " (bf::INT + it::INT + cs::INT + ds::INT)::BIGINT AS hits FROM ruled) r USING (event_id)"
    )
    zs = ", ".join(f"{z}_zscore" for z in _Z)
    state_rows = (
        "SELECT k AS entity_id, n, "
        + ", ".join(f"round(m{i} + 1e-7, 3) AS {z}_mean, round(sqrt(q{i}) + 1e-7, 3) AS {z}_std" for i, z in enumerate(_Z))
        + " FROM ent31"
    )
    return {
        "rule_brute_force": f"{ruled} SELECT event_id, nf::BIGINT AS recent_failures, bf::BIGINT AS fired FROM ruled",
        "rule_impossible_travel": f"{ruled} SELECT event_id, round(coalesce(kmh, -1), 3) AS travel_kmh, it::BIGINT AS fired FROM ruled",
        "rule_credential_stuffing": f"{ruled} SELECT event_id, ipn::BIGINT AS ip_events, ipf::BIGINT AS ip_failures, ipt::BIGINT AS ip_targets, cs::BIGINT AS fired FROM ruled",
        "rule_device_spoofing": f"{ruled} SELECT event_id, coalesce(pdev, '') AS prev_device, ds::BIGINT AS fired FROM ruled",
        "rule_flags": f"{ruled} SELECT event_id, bf::BIGINT AS rule_brute_force, it::BIGINT AS rule_impossible_travel, cs::BIGINT AS rule_credential_stuffing, ds::BIGINT AS rule_device_spoofing FROM ruled",
        "rule_hits": f"{hits} SELECT event_id, rule, detail, mitre, round(confidence::DOUBLE, 4) AS confidence FROM hits",
        "feat_temporal": _feature("temporal"),
        "feat_raw_values": _feature("raw"),
        "feat_gap_frequency": _feature("gap"),
        "feat_windowed_frequency": f"{_LOG} SELECT event_id, (count(*) OVER ({_E} RANGE BETWEEN {HOUR_US} PRECEDING AND CURRENT ROW) - 1)::DOUBLE AS session_frequency_1h FROM log",
        "feat_auth_failure_rate": _feature("fails"),
        "feat_resource_novelty": _feature("novelty"),
        "feat_privilege_expansion": _feature("expansion"),
        "feat_geo": _feature("geo"),
        "feat_device": _feature("device"),
        "feat_ip_entities": _feature("ip"),
        "feat_freq_encoding": _feature("freq"),
        "feat_command_entropy": f"{_LOG} SELECT event_id, round(-sum(n / 4.0::DOUBLE * log2(n / 4.0::DOUBLE)), 6) + 0.0 AS command_entropy FROM (SELECT event_id, c, count(*) AS n FROM (SELECT event_id, unnest(commands) AS c FROM log) GROUP BY ALL) GROUP BY event_id",
        "feature_table": _feature_table(),
        "features_and_rules": features_and_rules,
        "score_second_half": f"SELECT f.* EXCLUDE (entity_maturity_weight, is_cold_start, {zs}), d.* EXCLUDE (event_id) FROM ({features_and_rules}) f JOIN ({_batched(_BATCHED_ROWS)}) d USING (event_id)"
        " JOIN events e USING (event_id) WHERE e.ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 20 DAY FROM events)",
        "baseline_daily": _batched(_BATCHED_ROWS),
        "validate_events": _flawed(),
        "validate_ipv4": _IPS,
        "validate_labels": "SELECT event_id, 'phishing' AS label, 'label' AS reasons FROM events WHERE event_id % 40 = 0",
        "validate_profiles": f"{_LOG}, s AS (SELECT entity_id, count(DISTINCT regexp_extract(resource, '([0-9]+)$', 1)) AS c, avg(duration) / 8 AS sd FROM log GROUP BY 1)"
        " SELECT entity_id, concat_ws(',', CASE WHEN NOT (sd > 0 AND sd <= 6) THEN 'typical_hour_std' END, CASE WHEN c NOT BETWEEN 3 AND 20 THEN 'resource_set' END) AS reasons FROM s",
        "temporal_split": "SELECT event_id, (ts <= (SELECT min(ts) FROM events) + INTERVAL 20 DAY)::BIGINT AS is_train FROM events",
        "label_join": f"{_LOG}, h AS (SELECT event_id, label_int, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE {_names('label_int')} END AS label FROM log)"
        " SELECT event_id, label, CASE WHEN label = 'other' THEN 0 ELSE label_int END::BIGINT AS label_int, (label <> 'other' AND label_int > 0)::BIGINT AS is_attack FROM h",
        "label_distribution": f"{_LOG} SELECT {_names('label_int')} AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM log), 4) AS pct FROM log GROUP BY 1",
        "stats_of_days": f"{_LOG} SELECT count(*) AS events, count(DISTINCT entity_id) AS entities, count(DISTINCT entity_id) FILTER (entity_type = 'user') AS users,"
        " count(DISTINCT entity_id) FILTER (entity_type = 'edge_device') AS edge_devices, count(DISTINCT entity_id) FILTER (entity_type = 'service_account') AS service_accounts,"
        " strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, round(100.0::DOUBLE * avg((label_int > 0)::INT), 4) AS attack_pct, round(100.0::DOUBLE * avg((label_int = 0)::INT), 4) AS normal_pct, 1::BIGINT AS sketch_is_close FROM log WHERE ts >= DATE '2024-01-06' AND ts < DATE '2024-01-16'",
        "dataset_stats": f"{_LOG} SELECT count(*) AS events, count(DISTINCT entity_id) AS entities, count(DISTINCT entity_id) FILTER (entity_type = 'user') AS users,"
        " count(DISTINCT entity_id) FILTER (entity_type = 'edge_device') AS edge_devices, count(DISTINCT entity_id) FILTER (entity_type = 'service_account') AS service_accounts,"
        " strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, round(100.0::DOUBLE * avg((label_int > 0)::INT), 4) AS attack_pct, round(100.0::DOUBLE * avg((label_int = 0)::INT), 4) AS normal_pct FROM log",
        "severity_buckets": f"{_LOG}, p AS (SELECT *, {_names('pred')} AS name FROM log) SELECT event_id, CASE WHEN risk >= 90 THEN 'CRITICAL' WHEN risk >= 70 THEN 'HIGH' WHEN risk >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity,"
        f" {_mitre('name')} AS mitre, (risk > 80)::BIGINT AS alarm FROM p",
        "class_weights": f"{_LOG}, c AS (SELECT label_int, count(*) AS n FROM log WHERE label_int > 0 GROUP BY 1) SELECT label_int::BIGINT AS label_int, n,"
        " round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE * CASE WHEN label_int IN (5, 7) THEN 2 ELSE 1 END, 6) AS weight FROM c",
        "precision_at_k": f"{_LOG} SELECT {_K} AS k, round({_PK}, 6) AS precision_at_k",
        "average_precision": f"{_LOG}{_CURVE} SELECT round({_AP}, 8) AS average_precision",
        "roc_auc": f"{_LOG}{_CURVE} SELECT round({_AUC}, 8) AS roc_auc",
        "class_report": f"{_LOG}{_CLASSES} SELECT metric, class, round(value, 8) AS value FROM rep",
        "confusion_matrix": f"{_LOG}{_CLASSES} SELECT c::BIGINT AS label_int, {', '.join(f'(SELECT count(*) FROM log WHERE label_int = c AND pred = {i}) AS predicted_{i}' for i in range(8))} FROM cls",
        "false_positive_rate": f"{_LOG} SELECT round({_FPR}, 8) AS false_positive_rate",
        "metrics_report": f"{_LOG}{_FULL_REPORT} SELECT metric, class, round(value, 8) AS value FROM full_rep",
        "report_summary": f"{_LOG}{_FULL_REPORT} SELECT "
        + ", ".join(
            f"(SELECT round(value, 8) FROM full_rep WHERE metric = '{m}' AND class = '{c}') AS {name}"
            for m, c, name in [
                ("accuracy", "all", "accuracy"), ("precision", "macro avg", "macro_precision"), ("recall", "macro avg", "macro_recall"),
                ("macro_f1", "all", "macro_f1"), ("pr_auc", "all", "pr_auc"), ("roc_auc", "all", "roc_auc"), ("precision_at_1pct", "all", "precision_at_1pct"),
            ]
        ),
        "command_decoding": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(event_id % 30 + 1, ',0') WHEN 1 THEN concat(event_id % 30 + 1, ',', list_position({vocabulary}, 'logout')) ELSE '' END AS ids FROM events",
        "markov_transitions": f"{_LOG}, p AS ({_PAIRS.format(t='log')}) SELECT src, dst, count(*) AS n FROM p WHERE label_int = 0 GROUP BY 1, 2",
        "markov_surprise": f"{_LOG}, cut AS (FROM log),"
        f" tr AS (SELECT src, dst, count(*) AS n FROM ({_PAIRS.format(t='(SELECT * FROM log WHERE label_int = 0)')}) GROUP BY 1, 2),"
        f" q AS (SELECT event_id, src, dst FROM ({_PAIRS.format(t='cut')})),"
        f" lp AS (SELECT q.event_id, ln((coalesce(tr.n, 0) + 1e-5) / (coalesce((SELECT sum(n) FROM tr t WHERE t.src = q.src), 0) + 1e-5 * {_SIZE})) AS lp FROM q LEFT JOIN tr USING (src, dst))"
        " SELECT log.event_id, round(coalesce(-avg(lp), 0.0), 6) AS sequence_anomaly_score FROM log LEFT JOIN lp USING (event_id) GROUP BY 1",
        "baseline_sequential": f"{_LOG}{_MEASURED}{_FROZEN} SELECT * EXCLUDE (entity_id, acc) REPLACE (entity_maturity_weight::DOUBLE AS entity_maturity_weight) FROM frozen",
        "baseline_batched": _batched(_BATCHED_ROWS),
        "baseline_state": _batched(state_rows),
        "stream_baseline": _batched(_BATCHED_ROWS),
        "cold_start_entities": f"{_LOG}{_MEASURED}{_FROZEN} SELECT entity_id, sum(acc)::BIGINT AS n FROM frozen GROUP BY 1 HAVING sum(acc) < 20",
        "entity_profile": f"{_LOG}{_PROFILE} SELECT * FROM prof",
        "entity_drift_series": f"{_LOG}{_SERIES} SELECT entity_id, point::BIGINT AS point, value::DOUBLE AS value FROM series",
        "entity_spikes": f"{_LOG}{_SERIES} SELECT entity_id, max(value)::DOUBLE AS value, arg_min(point, (-value, point))::BIGINT AS index FROM series GROUP BY 1 HAVING max(value) > 0.05",
        "requested_profiles": f"{_LOG}{_PROFILE}, want AS (SELECT CAST(n_nationkey * 90 AS VARCHAR) AS entity_id FROM nation)"
        " SELECT entity_id, coalesce(cohort, 'Unknown Cohort') AS cohort, coalesce(account_age, '0.0y') AS account_age, coalesce(maturity_weight, 0.5::DOUBLE) AS maturity_weight, coalesce(maturity_level, 'UNKNOWN') AS maturity_level,"
        " CASE WHEN cohort IS NULL THEN '50,50,50,50,50,50' ELSE concat_ws(',', working_hours, data_volume, places, resources, auth_failures, activity) END AS vector, 30::BIGINT AS points FROM want LEFT JOIN prof USING (entity_id)",
        "kpi_tiles": f"{_LOG}{_CLASSES} SELECT (SELECT count(*) FROM log) AS events_analyzed, (SELECT floor(sum(s) * 0.1)::BIGINT FROM prf WHERE class <> 'normal') AS active_alerts,"
        " round(1 - (SELECT f1 FROM prf WHERE class = 'insider_drift'), 2) AS drift_index",
        "kpi_tiles_24h": "WITH x AS (SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) SELECT n AS events_analyzed, CASE WHEN n > 0 THEN floor(n * 0.0001) ELSE 14 END::BIGINT AS active_alerts, 0.04::DOUBLE AS drift_index FROM x",
        "triage_queue": f"{_LOG}, p AS (SELECT *, {_names('pred')} AS name FROM log WHERE risk >= 70 AND risk < 90 ORDER BY risk DESC, event_id LIMIT 100)"
        " SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, entity_id, source_ip AS origin_ip,"
        " array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS attack_vector,"
        f" regexp_extract({_mitre('name')}, '^(T[0-9.]+)', 1) AS mitre_tag, round(risk, 4) AS risk_score, 'HIGH' AS severity, (risk > 80)::BIGINT AS alarm FROM p",
        "entity_timeline": f"{hits} SELECT r.event_id, strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, r.resource AS resource_accessed, (count(h.rule) > 0)::BIGINT AS anomalous,"
        " coalesce(string_agg(h.rule, ',' ORDER BY h.pos), '') AS rules, coalesce(string_agg('[' || h.mitre || '] ' || h.detail, '; ' ORDER BY h.pos), '') AS trace FROM ruled r LEFT JOIN hits h USING (event_id) WHERE r.entity_id = '7' GROUP BY ALL",
        "event_rate": f"{_LOG} SELECT (us - us % {HOUR_US}) // 1000000 AS window_start, entity_type, count(*) AS events, sum(failed)::BIGINT AS failures FROM log GROUP BY 1, 2",
        "recent_events": f"{_LOG} SELECT event_id, entity_id, round(risk, 4) AS risk_stub FROM log ORDER BY ts DESC, event_id DESC LIMIT 6",
        "unused_resources": f"{_LOG}, cat AS (SELECT DISTINCT resource FROM log), e AS (SELECT DISTINCT entity_id FROM log), used AS (SELECT DISTINCT entity_id, resource FROM log),"
        " m AS (SELECT e.entity_id, cat.resource FROM e, cat WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.entity_id = e.entity_id AND u.resource = cat.resource))"
        " SELECT e.entity_id, coalesce(string_agg(m.resource, ',' ORDER BY m.resource), '') AS unused FROM e LEFT JOIN m USING (entity_id) GROUP BY 1",
        "far_places": f"{_LOG}, home AS (SELECT entity_id, arg_min(geo_lat, us) AS lat, arg_min(geo_lon, us) AS lon FROM log GROUP BY 1), pl(i, city, plat, plon) AS (VALUES {_PLACE_ROWS}),"
        f" d AS (SELECT entity_id, i, city, {_km('lat', 'lon', 'plat', 'plon')} AS km FROM home, pl), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN km >= 9000 THEN 0 ELSE 1 END, CASE WHEN km >= 9000 THEN i ELSE -km END) AS rk FROM d)"
        " SELECT entity_id, city AS far_city, round(km, 3) AS far_km FROM r WHERE rk = 1",
        "geo_speed": f"{_LOG}, d AS (SELECT event_id, event_id % 3 AS h, {_km('geo_lat', 'geo_lon', '10.006', '10.0')} AS km FROM log)"
        " SELECT event_id, round(km, 3) AS km, CASE WHEN h > 0 THEN round(km / h, 3) WHEN km > 0 THEN -1 ELSE 0 END AS kmh FROM d",
        "source_csv": f"{_LOG} {_SHOWN}",
        "source_nested_json": f"{_LOG} {_SHOWN}",
        "ecod_exact": _ECOD.format(log=_LOG, rules=_RULES),
        "ecod_fitted": _ECOD_FITTED.format(log=_LOG, rules=_RULES),
        "clean_matrix": f"{_LOG} SELECT event_id, round(CASE WHEN event_id % 5 = 4 THEN 2 * duration ELSE duration END, 4) AS total FROM log",
        "numeric_columns": f"{_LOG}{_MEASURED}{_FROZEN}, x AS (SELECT * FROM (SELECT event_id, duration AS session_duration_raw, bytes AS bytes_transferred_raw, 0.0 AS command_entropy FROM log)"
        f" JOIN (SELECT event_id, row_number() OVER ({_E}) - 1 AS session_frequency_1h, avg(failed) OVER ({_E} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS auth_failure_rate FROM log) USING (event_id)"
        f" JOIN (SELECT event_id, v AS geo_velocity_kmh FROM moved) USING (event_id) JOIN (SELECT event_id, CASE WHEN div > 1 THEN 1.0 / div ELSE 0 END AS privilege_expansion_rate FROM (SELECT event_id, (sum(novel) OVER ({_E}))::DOUBLE AS div FROM nov)) USING (event_id)"
        f" JOIN (SELECT event_id, sum(novel) OVER ({_E} RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS privilege_expansion_velocity FROM nov) USING (event_id)"
        f" JOIN (SELECT event_id, device_stability_index FROM ({_FEATURES['device']})) USING (event_id) JOIN ({_FEATURES['freq']}) USING (event_id)"
        " JOIN (SELECT * EXCLUDE (entity_id, acc, entity_maturity_weight, is_cold_start) FROM frozen) USING (event_id)),"
        " m AS (SELECT "
        + ", ".join(
            f"avg({c})::DOUBLE AS {c}"
            for c in [
                "session_duration_raw", "bytes_transferred_raw", "command_entropy", "session_frequency_1h", "auth_failure_rate", "geo_velocity_kmh",
                "privilege_expansion_rate", "privilege_expansion_velocity", "device_stability_index", "resource_freq_encoding", "ip_freq_encoding",
                *[f"{z}_zscore" for z in _Z],
            ]
        )
        + " FROM x) SELECT feature, round(mean, 4) AS mean FROM (UNPIVOT m ON COLUMNS(*) INTO NAME feature VALUE mean)",
        "drift_buckets": f"{_LOG} SELECT entity_type AS cohort, us - us % {6 * HOUR_US} AS bucket_us, count(*) AS n, sum((label_int > 0)::INT)::BIGINT AS anomalies FROM log GROUP BY 1, 2",
        "drift_events": _drift(),
        "label_file": f"{_LOG} SELECT event_id::VARCHAR AS event_id, {_names('label_int')} AS label, label_int::BIGINT AS label_int FROM log",
        "contamination_flags": f"{_LOG}, c AS (SELECT quantile_cont(risk, 0.98) AS cut FROM log) SELECT event_id, round(cut, 9) AS cut, (risk > cut)::BIGINT AS flag FROM log, c",
        "joint_labels": f"{_LOG}, p AS (SELECT event_id, risk, list_prepend(1 - risk / 100, list_transform(range(0, 7), lambda i: risk / 100 * CASE WHEN (event_id % 7 + i) % 3 = 0 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END)) AS p FROM log),"
        " q AS (SELECT *, list_position(p, list_max(p)) - 1 AS best FROM p)"
        f" SELECT event_id, round(greatest(0.0, risk / 100 * 100), 6) AS risk, round(list_sum(p) + 1e-9, 6) AS total, best::BIGINT AS predicted_int, {_names('best')} AS predicted FROM q",
        "narrations": _narrations(hits),
        "unused_resource_pairs": f"{_LOG} SELECT e.entity_id, c.resource AS resource_accessed FROM (SELECT DISTINCT entity_id FROM log) e, (SELECT DISTINCT resource FROM log) c"
        " WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.entity_id = e.entity_id AND l.resource = c.resource)",
        "explanation_sums": "SELECT event_id, 1::BIGINT AS gate, 1::BIGINT AS kind FROM events WHERE ts > (SELECT min(ts) FROM events) + INTERVAL 20 DAY",
        "drift_reset": f"{_LOG}, b AS (SELECT entity_type AS cohort, us - us % {6 * HOUR_US} AS bucket_us, count(*) AS n FROM log GROUP BY 1, 2)"
        f" SELECT cohort, sum(n)::BIGINT AS n, count(*) AS buckets FROM b WHERE cohort <> 'user' OR bucket_us >= (SELECT min(bucket_us) FROM b WHERE cohort = 'user') + {15 * DAY_US} GROUP BY 1",
        "stream_previous_event": f"{_LOG} SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(lag(us) OVER ({_E}), 0) AS prev_us, coalesce(lag(device) OVER ({_E}), '') AS prev_device FROM log",
        "stream_failure_counts": f"{_LOG}, w AS (SELECT *, unnest(range(us - us % {12 * HOUR_US} - {36 * HOUR_US}, us + 1, {12 * HOUR_US})) AS s FROM log)"
        f" SELECT s // 1000000 AS window_start, source_ip, count(*) AS events, sum(failed)::BIGINT AS failures, count(DISTINCT entity_id) AS targets FROM w GROUP BY 1, 2",
        "stream_cohort_rates": f"{_LOG} SELECT (us - us % {HOUR_US}) // 1000000 AS window_start, entity_type, count(*) AS events, sum((label_int > 0)::INT)::BIGINT AS anomalies FROM log GROUP BY 1, 2",
    }
