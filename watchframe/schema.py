"""Schemas and fixed values of the access-log domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


GEO = _struct(("city", StringType()), ("country", StringType()), ("lat", DoubleType()), ("lon", DoubleType()))

DEVICE = _struct(
    ("os", StringType()), ("firmware_version", StringType()), ("mac_address", StringType()), ("protocol", StringType())
)

# nested form of an access event
NESTED_EVENT = _struct(
    ("event_id", StringType()),
    ("entity_id", StringType()),
    ("entity_type", StringType()),
    ("timestamp", TimestampType()),
    ("source_ip", StringType()),
    ("geo_location", GEO),
    ("resource_accessed", StringType()),
    ("auth_method", StringType()),
    ("auth_success", BooleanType()),
    ("session_duration", DoubleType()),
    ("command_sequence", ArrayType(StringType())),
    ("device_fingerprint", DEVICE),
    ("bytes_transferred", LongType()),
)

# flat form as stored in CSV; command_sequence is the text of a list there
FLAT_EVENT = _struct(
    ("event_id", StringType()),
    ("entity_id", StringType()),
    ("entity_type", StringType()),
    ("timestamp", TimestampType()),
    ("source_ip", StringType()),
    ("geo_lat", DoubleType()),
    ("geo_lon", DoubleType()),
    ("geo_city", StringType()),
    ("geo_country", StringType()),
    ("resource_accessed", StringType()),
    ("auth_method", StringType()),
    ("auth_success", BooleanType()),
    ("session_duration", DoubleType()),
    ("command_sequence", StringType()),
    ("device_os", StringType()),
    ("device_firmware", StringType()),
    ("device_mac", StringType()),
    ("device_protocol", StringType()),
    ("bytes_transferred", LongType()),
)

LABEL = _struct(("event_id", StringType()), ("label", StringType()))

PROFILE = _struct(
    ("entity_id", StringType()),
    ("entity_type", StringType()),
    ("home_lat", DoubleType()),
    ("home_lon", DoubleType()),
    ("secondary_lat", DoubleType()),
    ("secondary_lon", DoubleType()),
    ("typical_hour_mean", DoubleType()),
    ("typical_hour_std", DoubleType()),
    ("resource_set", ArrayType(StringType())),
    ("session_duration_mean_log", DoubleType()),
    ("session_duration_std_log", DoubleType()),
    ("auth_method", StringType()),
    ("device_os", StringType()),
    ("device_firmware", StringType()),
    ("device_mac", StringType()),
    ("device_protocol", StringType()),
    ("avg_daily_events", DoubleType()),
    ("bytes_mean", LongType()),
    ("bytes_std", LongType()),
    ("typical_commands", ArrayType(StringType())),
)

RULE_HIT = "struct<rule:string,detail:string,mitre:string,confidence:double>"

# ---- fixed values -------------------------------------------------------------------------------

ENTITY_TYPES = ["user", "service_account", "edge_device"]
AUTH_METHODS = ["password", "token", "certificate", "biometric"]

# position in the list is the class number
LABELS = [
    "normal",
    "brute_force",
    "impossible_travel",
    "credential_stuffing",
    "lateral_movement",
    "device_spoofing",
    "low_and_slow",
    "insider_drift",
]

MITRE = {
    "brute_force": "T1110 (Brute Force)",
    "impossible_travel": "T1078 (Valid Accounts — credential misuse)",
    "credential_stuffing": "T1110.004 (Credential Stuffing)",
    "lateral_movement": "T1021 (Remote Services — Lateral Movement)",
    "device_spoofing": "T1036 (Masquerading)",
    "low_and_slow": "T1048 (Exfiltration Over Alternative Protocol)",
    "insider_drift": "T1078 (Valid Accounts — privilege expansion)",
}

# a command's id is its position + 1; 0 means padding or unknown
COMMANDS = [
    "login", "logout", "read_file", "write_file", "delete_file",
    "list_dir", "query_db", "export_data", "create_user", "modify_perms",
    "restart_service", "deploy_app", "rotate_keys", "view_logs",
    "download_report", "upload_data", "run_script", "ssh_connect",
    "rdp_connect", "vpn_connect", "modify_firewall", "backup_db",
    "restore_db", "audit_check", "scan_network", "update_firmware",
    "read_sensor", "write_setpoint", "acknowledge_alarm", "calibrate_device",
]

# reference places: city, country, latitude, longitude; list order decides which far place is first
PLACES = [
    ("New York", "US", 40.7128, -74.0060),
    ("Los Angeles", "US", 34.0522, -118.2437),
    ("Chicago", "US", 41.8781, -87.6298),
    ("Houston", "US", 29.7604, -95.3698),
    ("Toronto", "CA", 43.6532, -79.3832),
    ("Mexico City", "MX", 19.4326, -99.1332),
    ("San Francisco", "US", 37.7749, -122.4194),
    ("Seattle", "US", 47.6062, -122.3321),
    ("London", "GB", 51.5074, -0.1278),
    ("Paris", "FR", 48.8566, 2.3522),
    ("Berlin", "DE", 52.5200, 13.4050),
    ("Amsterdam", "NL", 52.3676, 4.9041),
    ("Madrid", "ES", 40.4168, -3.7038),
    ("Rome", "IT", 41.9028, 12.4964),
    ("Stockholm", "SE", 59.3293, 18.0686),
    ("Zurich", "CH", 47.3769, 8.5417),
    ("Mumbai", "IN", 19.0760, 72.8777),
    ("Delhi", "IN", 28.7041, 77.1025),
    ("Bangalore", "IN", 12.9716, 77.5946),
    ("Tokyo", "JP", 35.6762, 139.6503),
    ("Singapore", "SG", 1.3521, 103.8198),
    ("Shanghai", "CN", 31.2304, 121.4737),
    ("Beijing", "CN", 39.9042, 116.4074),
    ("Seoul", "KR", 37.5665, 126.9780),
    ("Dubai", "AE", 25.2048, 55.2708),
    ("Tel Aviv", "IL", 32.0853, 34.7818),
    ("Bangkok", "TH", 13.7563, 100.5018),
    ("Jakarta", "ID", -6.2088, 106.8456),
    ("Hyderabad", "IN", 17.3850, 78.4867),
    ("Chennai", "IN", 13.0827, 80.2707),
    ("São Paulo", "BR", -23.5505, -46.6333),
    ("Buenos Aires", "AR", -34.6037, -58.3816),
    ("Bogota", "CO", 4.7110, -74.0721),
    ("Lagos", "NG", 6.5244, 3.3792),
    ("Cape Town", "ZA", -33.9249, 18.4241),
    ("Nairobi", "KE", -1.2921, 36.8219),
    ("Sydney", "AU", -33.8688, 151.2093),
    ("Melbourne", "AU", -37.8136, 144.9631),
    ("Auckland", "NZ", -36.8485, 174.7633),
    ("Istanbul", "TR", 41.0082, 28.9784),
    ("Riyadh", "SA", 24.7136, 46.6753),
    ("Boston", "US", 42.3601, -71.0589),
    ("Atlanta", "US", 33.7490, -84.3880),
    ("Denver", "US", 39.7392, -104.9903),
    ("Miami", "US", 25.7617, -80.1918),
    ("Dallas", "US", 32.7767, -96.7970),
    ("Phoenix", "US", 33.4484, -112.0740),
    ("Portland", "US", 45.5152, -122.6784),
    ("Minneapolis", "US", 44.9778, -93.2650),
    ("Washington DC", "US", 38.9072, -77.0369),
]

# the 37 behavioural features, in order
FEATURES = [
    "hour_sin", "hour_cos", "day_of_week", "is_weekend", "is_work_hours", "time_since_last",
    "session_frequency_1h", "auth_failure_rate", "resource_novelty", "resource_diversity",
    "session_duration_raw", "bytes_transferred_raw", "auth_method_mismatch", "command_entropy",
    "unique_entities_per_ip", "is_off_hours", "privilege_expansion_rate",
    "privilege_expansion_velocity", "geo_velocity_kmh", "impossible_travel_flag",
    "geo_distance_from_primary", "is_new_geo", "geo_anomaly_score", "device_stability_index",
    "new_device_flag", "fingerprint_mismatch", "protocol_mismatch", "resource_freq_encoding",
    "ip_freq_encoding", "entity_maturity_weight", "is_cold_start", "session_duration_zscore",
    "bytes_transferred_zscore", "hour_zscore", "auth_failure_rate_zscore",
    "resource_diversity_zscore", "geo_velocity_kmh_zscore",
]

RULES = ["brute_force", "impossible_travel", "credential_stuffing", "device_spoofing"]
RULE_FLAGS = [f"rule_{r}" for r in RULES]

# a feature is numeric (fit for the outlier models) when its name holds one of these
NUMERIC_MARKS = ["raw", "zscore", "freq", "entropy", "rate", "index", "velocity"]


def numeric_features(columns: list[str]) -> list[str]:
    """The continuous features among `columns`, in their order."""
    return [c for c in columns if c in FEATURES and any(m in c for m in NUMERIC_MARKS)]


# ---- label and tag lookups ----------------------------------------------------------------------


def label_to_int(label: Column) -> Column:
    """Class number of a label; an unknown label is 0."""
    pairs = [F.lit(v) for i, name in enumerate(LABELS) for v in (name, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(0))


def int_to_label(number: Column) -> Column:
    """Label of a class number; an unknown number is `normal`."""
    names = F.array(*[F.lit(name) for name in LABELS])
    return F.coalesce(F.get(names, number.cast("int")), F.lit("normal"))


def mitre_of(label: Column) -> Column:
    """Technique tag of an attack label, empty for anything else."""
    pairs = [F.lit(v) for pair in MITRE.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(""))


def severity(risk: Column) -> Column:
    """Severity bucket of a risk score."""
    return (
        F.when(risk >= 90, "CRITICAL").when(risk >= 70, "HIGH").when(risk >= 50, "MEDIUM").otherwise("LOW")
    )
